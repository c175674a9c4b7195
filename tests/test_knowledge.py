"""Readers, configuration, extraction and the knowledge base from end to end."""

import io
import json
import zipfile

import pytest

from quern import config
from quern.knowledge import SCHEMAS, KnowledgeBase
from quern.operators import extraction
from quern.sources import readers


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "b.html").write_text("<p>Fish &amp; chips</p><script>x</script>")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "e.pdf").write_text("no pdf")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("1.xhtml", "<b>One</b>")
        z.writestr("2.html", "<i>Two</i>")
    (tmp_path / "d.epub").write_bytes(buf.getvalue())
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "café � end" and got["b.html"].text == "Fish & chips x" and got["d.epub"].text == "One\n\nTwo"
    assert got["c.xyz"].text is None and "xyz" in got["c.xyz"].error and got["e.pdf"].error
    assert readers.strip_html(None) is None


def test_qna_and_run_logs(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "Who?"}, {"id": "2", "question": "Why?", "answerable": False, "expected_keywords": ["x"]}]))
    got = {r.id: r for r in readers.read_qna(spark, str(tmp_path / "q.json")).collect()}
    assert got["1"].answerable and got["1"].expected_keywords == [] and not got["2"].answerable and got["2"].expected_keywords == ["x"]
    res, agg = spark.createDataFrame([("1", 5)], "q_id string, score int"), spark.createDataFrame([(5.0,)], "mean double")
    log = str(tmp_path / "log")
    readers.write_run_log({"k": 1}, res, agg, log)
    (tmp_path / "log" / "broken.txt").write_text("{oops\n\n")
    assert [(r.q_id, r.score) for r in readers.read_run_log(spark, log, "result", "q_id string, score int").collect()] == [("1", 5)]
    assert [r["mean"] for r in readers.read_run_log(spark, log, "aggregate", "mean double").collect()] == [5.0]


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[retrieval]\ntop_k_chunks = 5\nrrf_k_vec = 7\n")
    c, origin = config.load(str(f), {"retrieval.rrf_k_vec": "9"}, {"QUERN_RETRIEVAL__TOP_K_CHUNKS": "6"})
    assert c.retrieval.top_k_chunks == 6 and c.retrieval.rrf_k_vec == 9
    assert origin == {"retrieval.top_k_chunks": "environment", "retrieval.rrf_k_vec": "override"}
    with pytest.raises(ValueError):
        config.load(None, {"retrieval.nothing": 1}, {})


def test_extract_facts(spark):
    rows = [
        (1, 0, "Ann", "Ann", "PROPN", "nsubj", 1), (1, 1, "saw", "see", "VERB", "ROOT", 1), (1, 2, "Tom", "Tom", "PROPN", "dobj", 1), (1, 3, "boats", "boat", "NOUN", "conj", 2),
        (2, 0, "She", "she", "PRON", "nsubj", 1), (2, 1, "left", "leave", "VERB", "ROOT", 1),
        (3, 0, "Tom", "Tom", "PROPN", "nsubj", 2), (3, 1, "not", "not", "PART", "neg", 2), (3, 2, "slept", "sleep", "VERB", "ROOT", 2),
    ]
    got = sorted(map(tuple, extraction.extract_facts(spark.createDataFrame(rows, extraction.PARSED)).collect()), key=repr)
    assert got == [(1, "Ann", "see", "Tom", True, False), (1, "Ann", "see", "boat", False, False), (3, "Tom", "sleep", None, False, True)]


def test_coref_and_introductions(spark):
    f = spark.createDataFrame([(1, 0, None), (1, 1, "Ann"), (1, 2, None)], "chunk_id long, n int, subject string")
    assert [(r.n, r.subject, r.coref) for r in extraction.carry_subject(f).orderBy("n").collect()] == [(0, None, True), (1, "Ann", False), (2, "Ann", True)]
    text = 'He came. "Dr. Reed, Mr. Tom Bell," said Porter, introducing us. They sat. "x" said he.'
    c = spark.createDataFrame([(1, text), (2, None), (3, "“Ann,” said Bell, introducing me.")], "id long, text string")
    got = {r.chunk_id: r for r in extraction.extract_introductions(c, {"reed": "John Reed"}).collect()}
    assert got[1].agent == "Porter" and got[1].themes == ["John Reed", "Tom Bell"] and got[1].statement == "Porter introduced John Reed and Tom Bell to each other."
    assert got[1].evidence == text[got[1].start_char : got[1].end_char].strip() and got[1].evidence.endswith("introducing us.") and got[3].themes == ["Ann"] and 2 not in got


def test_plain_parser_and_spans(spark):
    s = spark.createDataFrame([(1, "Ann found the lantern in the cellar."), (2, "She left."), (3, None), (4, "Tom opened no door, never opened Bell House.")], "sentence_id long, text string")
    parsed = extraction.parse_sentences(s)
    got = {r.sentence_id: (r.subject, r.predicate, r.object, r.negated) for r in extraction.extract_facts(parsed).collect()}
    assert got[1] == ("Ann", "find", "lantern", False) and 2 not in got and got[4][:2] == ("Tom", "open") and got[4][3]
    assert {r.sentence_id: r.qualifiers for r in extraction.qualifiers(parsed).collect()}[1] == '{"in":"cellar"}'
    assert extraction.trim_span("the old ferry, Captain Bell") == "old ferry" and extraction.trim_span("") == ""


def test_model_propositions(spark):
    from quern.operators import enrichment

    ok = '[{"predicate": "MURDER", "agent": " Ann ", "themes": "Tom", "statement": "Ann killed Tom.", "location": " "}, {"predicate": "fly", "agent": "A", "statement": "s"}, {"predicate": "find", "agent": "", "statement": "s"}, {"predicate": "find", "agent": "B", "themes": ["x", " ", "y"], "statement": "B found x and y."}]'
    df = spark.createDataFrame([(1, f"Sure:\n```json\n{ok}\n```"), (2, '{"predicate": "find", "agent": "A", "statement": "s"}'), (3, "[oops"), (4, None)], "chunk_id long, response string")
    got = sorted((r.chunk_id, r.predicate, r.agent, tuple(r.themes), r.location, r.statement) for r in enrichment.parse_model_propositions(df).collect())
    assert got == [(1, "find", "B", ("x", "y"), None, "B found x and y."), (1, "murder", "Ann", ("Tom",), None, "Ann killed Tom.")]
    made, bridge, entities = enrichment.proposition_rows(enrichment.parse_model_propositions(df.unionByName(df)))
    assert made.count() == 2 and bridge.count() == 5 and {r.canonical_name for r in entities.collect()} == {"Ann", "Tom", "B", "x", "y"}


def test_prompts_and_generation(spark):
    from quern.operators import generation

    q = spark.createDataFrame([("a", "Who?"), ("b", "Why?")], "q_id string, question string")
    made = generation.answer_prompts(q, spark.createDataFrame([("a", '[C1] "Ann did." (x)')], "q_id string, context string"))
    got = {r.q_id: r for r in made.collect()}
    assert got["a"].content.startswith("Context:\n[C1]") and got["a"].prefill and got["b"].content == "Question: Why?" and got["b"].prefill is None
    said = {r.q_id: (r.answer, r.error) for r in generation.generate(made, lambda m: "x" if len(m) == 3 else 1 / 0).collect()}
    assert said["a"] == (generation.PREFILL + "x", None) and said["b"][0] is None and said["b"][1].startswith("ZeroDivisionError")
    p = generation.proposition_prompts(q, spark.createDataFrame([("a", 1, "s" * 500), ("a", 2, "t" * 500)], "q_id string, rank int, statement string"))
    blocks = {r.q_id: r.block for r in p.collect()}
    assert blocks["a"] == "[P1] " + "s" * 500 and blocks["b"] is None
    msgs = generation.chat_messages("Now?", "", [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a" * 5000}] * 2)
    assert [m["role"] for m in msgs] == ["system", "user"]
    assert list(generation.stream([], lambda m: iter(["b", "c"]), "a")) == ["a", "b", "c"]


def test_knowledge_base_answers(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), config.load(None, {"retrieval.max_facts_in_context": 3})[0])
    docs = spark.createDataFrame([("a.txt", "Ann found the red boat in the harbour. She opened the box."), ("b.txt", "Tom visited Bell House."), ("c.txt", '"Dr. Reed, Tom," said Porter, introducing us. We sat.')], "path string, text string")
    counts = kb.ingest_all(docs)
    assert counts["sources"] == 3 and counts["facts"] >= 3 and counts["propositions"] == 1
    again = kb.ingest_all(docs)
    assert again["sources"] == again["facts"] == again["propositions"] == 0
    assert kb.index("chunks").state()["documents"] == 3 and kb.reindex()["chunks"] == 3
    q = spark.createDataFrame([("q", "Who found the red boat?"), ("r", "What did zzz see?")], "q_id string, question string")
    got = {r.q_id: r for r in kb.answer(q).collect()}
    assert "boat" in got["q"].answer and "[C1]" in got["q"].answer and got["q"].footer == "Sources:\n  [C1] → a.txt"
    assert "ranking: " in {r.q_id: r.report for r in kb.explain(q).collect()}["q"]
    model = lambda m: '[{"subject": "Ann", "predicate": "role", "object": "pilot"}]'
    assert kb.enhance(model, ("extraction", "implied"))["extraction"] == 3 and kb.table("chunks").filter("extracted_v = 0").count() == 0
    assert kb.enhance(model, ("extraction", "implied")) == {"extraction": 0, "implied": 0}
    other = KnowledgeBase(spark, str(tmp_path / "other"))
    other.ingest_all(spark.createDataFrame([("d.txt", "The grey lantern hung over the quay.")], "path string, text string"))
    other.export(str(tmp_path / "pack"))
    kb.attach("extra", str(tmp_path / "pack"))
    lamp = spark.createDataFrame([("l", "Where did the grey lantern hang?")], "q_id string, question string")
    assert kb.retrieve(lamp).orderBy("tag").first().source_info == "d.txt"
    with pytest.raises(ValueError):
        kb.attach("none", str(tmp_path / "nowhere"))
    kb.append("aliases", spark.createDataFrame([(1, "twin"), (2, "twin")], SCHEMAS["aliases"]))
    kb.append("entities", spark.createDataFrame([(1, "Twin A", "person", None), (2, "Twin B", "person", None)], SCHEMAS["entities"]))
    assert {r.mention: r.candidates for r in kb.review().collect()}["twin"] == "1:Twin A:person; 2:Twin B:person"
    kb.dismiss("twin")
    assert kb.review().filter("mention = 'twin'").count() == 0
    assert kb.maintain()["chunks"] == 1 and kb.stats()["chunks"] == 3 and kb.proposition(-1) is None
    assert kb.learn_synonyms(0.99).count() == kb.table("predicate_synonyms").count()


def test_replacement_that_was_cut_off_is_finished(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.append("aliases", spark.createDataFrame([(1, "a")], SCHEMAS["aliases"]))
    # as if the job had ended after the old table was dropped
    (tmp_path / "kb" / "aliases.parquet").rename(tmp_path / "kb" / "aliases.parquet.new")
    assert kb.table("aliases").count() == 1
    kb.replace("aliases", kb.table("aliases").filter("false"))
    assert kb.table("aliases").count() == 0


def test_commands(tmp_path, capsys):
    from quern.__main__ import main

    out = str(tmp_path / "c.toml")
    assert main(["config", "init", "--out", out]) == 0 and main(["config", "init", "--out", out]) == 1 and main(["--config", out, "config"]) == 0
    reg = str(tmp_path / "r.json")
    assert main(["packs", "add", reg, "a", "/x"]) == 0 and main(["packs", "remove", reg, "b"]) == 1
    assert json.loads((tmp_path / "r.json").read_text()) == [{"name": "a", "path": "/x"}] and "rrf_k_vec" in capsys.readouterr().out


def test_knowledge_base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.stats()["sources"] == 0
    docs = spark.createDataFrame([("a", "Ann owned the red boat. It sank."), ("b", "Tom slept."), ("c", "Tom slept."), ("d", None)], "path string, text string")
    assert kb.ingest(docs) == {"sources": 2, "chunks": 2}
    assert kb.ingest(docs) == {"sources": 0, "chunks": 0}
    chunk = kb.table("chunks").filter("text like 'Ann%'").first().id
    kb.append("entities", spark.createDataFrame([(1, "Ann", "person", None), (2, "Jarvey", "role", None), (3, "Anne", "person", None)], SCHEMAS["entities"]))
    kb.append("aliases", spark.createDataFrame([(1, "ann"), (3, "anne"), (3, "ann")], SCHEMAS["aliases"]))
    kb.append(
        "facts",
        spark.createDataFrame(
            [(1, chunk, 3, "s", "work_as", None, "jarvey", None, False, 1.0, "llm"), (2, chunk, 2, "s", "means", None, "driver", None, False, 1.0, "llm"), (3, chunk, 3, "s", "role", None, "police doctor", None, False, 1.0, "llm")],
            SCHEMAS["facts"],
        ),
    )
    assert kb.close_facts() == 1 and kb.close_facts() == 0
    kb.merge_entities(spark.createDataFrame([(3, 1)], "drop_id long, keep_id long"))
    assert kb.stats() == {"sources": 2, "chunks": 2, "entities": 2, "aliases": 2, "facts": 4}
    assert kb.prune_facts(["doctor"], ["jarvey"], dry_run=True) == {"bridge": 1, "closure": 1} and kb.stats()["facts"] == 4
    assert kb.prune_facts(["doctor"], ["jarvey"]) == {"bridge": 1, "closure": 1} and kb.stats()["facts"] == 2
    q = spark.createDataFrame([("q", "Who owned the red boat?"), ("r", "")], "q_id string, question string")
    hits = kb.retrieve(q).collect()
    assert [r.q_id for r in hits] == ["q"] and hits[0].chunk_id == chunk and hits[0].tag == "[C1]" and hits[0].source_info == "a"
    assert kb.export(str(tmp_path / "pack"))["chunks"] == 2
