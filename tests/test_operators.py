"""Behaviour of the core operators on small frames."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions.edit import levenshtein_table
from quern.functions.text import normalize_mention
from quern.operators import entities, evaluation, facts, ingest, propositions, retrieval, vectors
from quern.operators.fulltext import bm25
from quern.operators.graph import connected_components
from quern.plans import catalog
from quern.sources import packs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (7, 5), (9, 9), (3, 2), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def _plain_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcñ", max_size=7), min_size=1, max_size=5), st.lists(st.text("abcñ", max_size=7), min_size=1, max_size=5))
def test_edit_distances(a, b):
    table = levenshtein_table(a, b)
    assert table.tolist() == [[_plain_distance(x, y) for y in b] for x in a]


def test_bm25_clamps_idf(spark):
    docs = spark.createDataFrame([(1, "watson watson watson"), (2, "watson and others")], "id long, text string")
    q = spark.createDataFrame([("q", "watson", 1)], "q_id string, term string, weight long")
    got = bm25(q, docs, "id", "text", 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].score > got[1].score > 0


def test_bm25_empty_query(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    q = spark.createDataFrame([], "q_id string, term string, weight long")
    assert bm25(q, docs, "id", "text", 5).count() == 0


def test_mentions_prefer_longer_spans(spark):
    q = spark.createDataFrame([("q", "Where did Dr. Ann Bell's sister live?")], "q_id string, question string")
    a = spark.createDataFrame([(7, "ann bell"), (3, "bell"), (4, "sister"), (2, "sister")], "entity_id long, alias string")
    got = retrieval.mention_scan(q, a).orderBy("position").collect()
    assert [r.entity_id for r in got] == [7, 3, 2]


def test_parse_question(spark):
    q = spark.createDataFrame([(1, "Where did the man live?"), (2, "tell me more"), (3, ""), (4, None)], "q_id int, question string")
    got = {r.q_id: (r.wh_type, r.verb) for r in retrieval.parse_question(q).collect()}
    assert got[1] == ("where", "man") and got[2] == (None, "tell") and got[3] == (None, None)
    more = spark.createDataFrame([(1, "Why did Élodie leave?"), (2, "¿Quién llevaba él?"), (3, "The name of what, then?"), (4, "Who? Whom did 9 see")], "q_id int, question string")
    got = {r.q_id: (r.wh_type, r.verb) for r in retrieval.parse_question(more).collect()}
    # why is no question word; letters with accents count; a question word with a comma still opens the rest
    assert got[1] == (None, "why") and got[2] == (None, "llevaba") and got[3] == (None, "name") and got[4] == ("who", "see")


def test_lookup_scores(spark):
    f = spark.createDataFrame([(1, 10, "own"), (2, 10, "possess"), (3, 11, "own")], "id long, subject_id long, predicate string")
    s = facts.both_directions(spark.createDataFrame([("possess", "own")], "predicate string, synonym string"))
    w = spark.createDataFrame([("q", 10, "own")], "q_id string, entity_id long, verb string")
    assert rows(facts.lookup(w, f, s)) == [("q", 1, 1.0), ("q", 2, 0.8)]


def test_gate_without_mentions_drops_all(spark):
    hits = spark.createDataFrame([("q", 1, 5, None)], "q_id string, id long, subject_id long, object_id long")
    none = spark.createDataFrame([], "q_id string, entity_id long")
    assert facts.relevance_gate(hits, none).count() == 0
    some = spark.createDataFrame([("q", 5)], "q_id string, entity_id long")
    assert rows(facts.relevance_gate(hits, some)) == [("q", 1)]


FACT = "id long, chunk_id long, subject_id long, sentence string, predicate string, object_id long, object_text string, qualifiers string, negated boolean, confidence double, source string"


def test_closure(spark):
    e = spark.createDataFrame([(1, "Hope"), (2, "Jarvey")], "id long, canonical_name string")
    f = spark.createDataFrame(
        [
            (1, 1, 1, "", "work_as", None, "jarvey ", None, False, 0.7, "llm"),
            (2, 1, 2, "", "means", None, "cab driver", None, False, None, "llm"),
            (3, 1, 1, "", "role", None, "Jarvey", None, True, 1.0, "llm"),
        ],
        FACT,
    )
    got = facts.closure(f, e).collect()
    assert [(r.subject_id, r.predicate, r.object_text, r.confidence) for r in got] == [(1, "work_as", "cab driver", 0.63)]
    again = f.unionByName(spark.createDataFrame([(9, 1, 1, "", "work_as", None, "cab driver", None, False, 0.63, "closure")], FACT))
    assert facts.closure(again, e).count() == 0


def test_prune(spark):
    f = spark.createDataFrame(
        [
            (1, 1, 1, "", "role", None, "Police inspector", None, False, 1.0, "svo"),
            (2, 1, 1, "", "work_as", None, "jarvey", None, False, 1.0, "llm"),
            (3, 1, 1, "", "call", None, "x", None, False, 1.0, "closure"),
            (4, 1, 2, "", "work_as", None, "jarvey", None, False, 1.0, "llm"),
        ],
        FACT,
    )
    assert rows(facts.prune(f, ["inspector"], ["jarvey"])) == [(2, "bridge"), (3, "closure")]


def test_fact_dedup_treats_nulls_as_equal(spark):
    f = spark.createDataFrame([(i, 1, 1, "", "be", None, None, None, False, None, "svo") for i in (5, 4)], FACT)
    assert [r.id for r in facts.dedup_facts(f).collect()] == [4]


def _fold(sents, limit, overlap):
    out, cur, chars = [], [], 0
    for s in sents:
        if chars + len(s) > limit and cur:
            out.append(" ".join(x.strip(" ") for x in cur))
            cur = cur[-overlap:] if overlap else []
            chars = sum(map(len, cur))
        cur.append(s)
        chars += len(s)
    return out + ([" ".join(x.strip(" ") for x in cur)] if cur else [])


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunk_fold(spark, overlap):
    rng = random.Random(overlap)
    cases = [[("w" * rng.randint(1, 12)) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))] for _ in range(25)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    got = {r.i: r.c for r in df.select("i", ingest.make_chunks(F.col("s"), 30, overlap).alias("c")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == _fold(c, 30, overlap)


def _sequential(mentions):
    made, out = [], {}
    for m in mentions:
        if not m or m in out:
            continue
        w = set(m.split())
        near = [e for e in made if set(e.split()) <= w or w <= set(e.split())]
        if near:
            out[m] = (near[0], len(near) > 1)
        else:
            made.append(m)
            out[m] = (m, False)
    return out


def test_resolution_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    for _ in range(4):
        ms = [" ".join(rng.sample("abcdef", rng.randint(1, 3))) for _ in range(30)] + ["", None]
        df = spark.createDataFrame(list(zip(ms, range(len(ms)))), "mention string, ordinal int")
        got = {r.mention: (r.entity, r.pending) for r in entities.resolve_mentions(df).collect()}
        assert got == _sequential(ms)


def test_rrf_and_packing(spark):
    lists = spark.createDataFrame(
        [("q", 0, "a", 1, 30), ("q", 0, "b", 2, 30), ("q", 1, "b", 1, 60), ("q", 1, "c", 2, 60)], "q_id string, list_no int, key string, rank int, k int"
    )
    got = retrieval.rrf(lists).orderBy("rank").collect()
    assert [r.key for r in got] == ["b", "a", "c"]
    sized = retrieval.rrf(lists).withColumn("n", F.lit(10))
    assert [r.key for r in retrieval.pack(sized, "n", 25, ["rank"]).orderBy("rank").collect()] == ["b", "a"]


def test_pack_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 50), ("q", 3, 1)], "q_id string, rank int, n int")
    assert [r.rank for r in retrieval.pack(df, "n", 20, ["rank"]).collect()] == [1]


def test_citations(spark):
    df = spark.createDataFrame([("x [C1] y [F2][C1] [P9]",), ("none",), (None,)], "t string")
    got = df.select(retrieval.cited_tags(F.col("t")).alias("c"), retrieval.strip_citations(F.col("t"), F.array(F.lit("[C1]"))).alias("s")).collect()
    assert got[0].c == ["[C1]", "[F2]", "[P9]"] and got[0].s == "x [C1] y [C1] " and got[1].c == [] and got[2].s is None


def test_trim_history_drops_the_odd_tail_and_the_oldest(spark):
    turns = spark.createDataFrame([(1, i, "user", "x" * 10) for i in range(9)], "conv_id int, turn int, role string, content string")
    assert sorted(r.turn for r in retrieval.trim_history(turns, 3, 1024).collect()) == [2, 3, 4, 5, 6, 7]
    assert sorted(r.turn for r in retrieval.trim_history(turns, 3, 6).collect()) == [6, 7]


def test_judge_needs_exact_ids(spark):
    rs = [
        ("a", '```json\n[{"id": "x", "score": 120, "reason": ""}]\n```', ["x"]), ("b", '{"id": "x", "score": 1}', ["x"]),
        ("c", '[{"id": "x", "score": 5}]', ["x", "y"]), ("d", "junk", ["x"]), ("e", None, ["x"]), ("f", '[{"id": "x", "score": "no"}]', ["x"]),
    ]
    df = spark.createDataFrame(rs, "batch_id string, response string, asked array<string>")
    assert rows(evaluation.parse_judge(df)) == [("a", "x", 100, "")]
    two = spark.createDataFrame([("g", '[{"id": "x", "score": 7, "reason": "r"}, {"score": 1}, "junk"]', ["x"])], df.schema)
    assert rows(evaluation.parse_judge(two)) in ([("g", "x", 7, "r")], [])


def test_model_facts(spark):
    rs = [(1, '[{"subject": "A", "predicate": "ROLE", "object": "b"}, {"subject": "A", "predicate": "fly", "object": "b"}]'), (2, '{"subject": "A", "predicate": "role"}'), (3, "[oops")]
    df = spark.createDataFrame(rs, "chunk_id int, response string")
    got = evaluation.parse_model_facts(df, facts.FACT_TAXONOMY).collect()
    assert [(r.chunk_id, r.subject, r.predicate, r.object, r.negated) for r in got] == [(1, "A", "role", "b", False)]


def test_compare_runs(spark):
    a = spark.createDataFrame([("ms", 5.0), ("recall", 0.5), ("gone", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("ms", 4.0), ("recall", 0.4), ("new", 1.0)], "metric string, value double")
    got = {r.metric: r.verdict for r in evaluation.compare_runs(a, b, ["ms"]).collect()}
    assert got == {"ms": "better", "recall": "regress", "gone": None, "new": None}


def test_knn_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    q = df.filter("id < 5").select(F.col("id").alias("q_id"), F.col("vec").alias("qvec"))
    got = vectors.knn(q, df, 4).collect()
    for i in range(5):
        want = np.argsort(np.linalg.norm(x - x[i], axis=1))[:4].tolist()
        assert [r.id for r in sorted((r for r in got if r.q_id == i), key=lambda r: r.rank)] == want


def test_mention_form(spark):
    df = spark.createDataFrame([("Dr. Ann  Bell's",), ("St. Mr",), (None,)], "t string")
    assert [r[0] for r in df.select(normalize_mention(F.col("t"))).collect()] == ["ann bell s", "", ""]


def test_packs(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "id long, text string")
    counts = packs.export_pack({n: one for n in packs.REQUIRED}, str(tmp_path / "p"))
    assert set(counts.values()) == {1} and packs.missing_tables(spark, str(tmp_path / "p")) == []
    assert packs.open_pack(spark, str(tmp_path / "p"))["chunks"].count() == 1
    with pytest.raises(ValueError):
        packs.open_pack(spark, str(tmp_path / "none"))
    reg = str(tmp_path / "r.json")
    packs.register(reg, "a", "/x")
    assert packs.read_registry(reg) == [{"name": "a", "path": "/x"}] and packs.unregister(reg, "a") and not packs.unregister(reg, "a")
    both = packs.attach([("main", one), ("b", one)])
    assert sorted((r.corpus, r.corpus_ord) for r in both.collect()) == [("b", 1), ("main", 0)]


def test_stream_replay_adds_nothing(spark, tmp_path):
    from quern.streaming.ingest import ingest_available

    src = str(tmp_path / "docs.parquet")
    texts = ["a", "b", "a", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    first = ingest_available(spark, src, out)
    assert sorted(r.doc_id for r in first.collect()) == [0, 1, 4]
    import shutil

    shutil.rmtree(out + "/state")
    again = ingest_available(spark, src, out)
    assert sorted(r.doc_id for r in again.collect()) == [0, 1, 4]
    assert spark.read.parquet(out + "/documents").count() == 3 or again.count() == 3


def test_tiles_do_not_change_distances():
    names = ["".join(p) for p in itertools.product("ab", repeat=3)]
    assert (levenshtein_table(names, names, tile=10) == levenshtein_table(names, names)).all()


def test_threshold_search_takes_every_row_as_candidate(spark, folder):
    e = spark.read.parquet(folder + "/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.to_numpy()).astype(np.float64), e.vec_id.to_numpy()
    near = np.sqrt(((x[ids % 50 == 0][:, None] - x[None]) ** 2).sum(axis=2)) < vectors.cosine_threshold(0.2)
    want = {(a, b) for a, row in zip(ids[ids % 50 == 0], near) for b in ids[row] if a != b}
    got = rows(catalog.queries()["cosine_threshold_match"](spark, folder).select("a", "b"))
    assert set(got) == want and len(got) == len(want)
    assert any(a > b for a, b in got)


def test_judge_responses_of_every_run_are_parsed(spark, folder):
    scores = spark.read.parquet(folder + "/question_results.parquet").select("q_id", "run_index", "judge_score").distinct().collect()
    want = [(f"{r.q_id}#{r.run_index}", r.q_id, min(100, (50 if r.judge_score is None else r.judge_score) + 40)) for r in scores]
    assert any(r.run_index > 1 for r in scores)
    assert rows(catalog.queries()["parse_judge"](spark, folder).select("batch_id", "id", "score")) == sorted(want, key=repr)


def test_model_propositions_come_from_the_facts_of_every_source(spark, folder):
    f = spark.read.parquet(folder + "/facts.parquet").filter(F.lower("predicate").isin(propositions.PROPOSITION_TAXONOMY))
    names = spark.read.parquet(folder + "/entities.parquet").filter("trim(canonical_name) <> ''").select(F.col("id").alias("subject_id"), F.trim("canonical_name").alias("subject"))
    want = f.join(names, "subject_id").filter("trim(sentence) <> ''").select("chunk_id", "subject", F.lower("predicate").alias("predicate"), F.trim("sentence").alias("statement"))
    assert f.select("source").distinct().count() > 1
    assert rows(catalog.queries()["parse_model_props"](spark, folder).select("chunk_id", F.col("agent").alias("subject"), "predicate", "statement")) == rows(want)


def test_stored_index_gives_what_a_scan_gives(spark, tmp_path):
    from quern.operators.answering import question_terms
    from quern.operators.fulltext import StoredIndex

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)] + [(200, None)]
    df = spark.createDataFrame(docs, "id long, text string")
    q = question_terms(spark.createDataFrame([(f"q{i}", " ".join(rng.choices([*words, "zzz9"], k=4))) for i in range(15)], "q_id string, question string"), [])
    q = q.unionByName(spark.createDataFrame([("w", "w1", 2)], "q_id string, term string, weight long"))
    want = rows(bm25(q, df, "id", "text", 7))
    index = StoredIndex(spark, str(tmp_path / "index"))
    assert index.search(q, 7).count() == 0
    index.rebuild(df.filter("id < 50"), "id", "text")
    index.append(df.unionByName(spark.createDataFrame([(999, "w1 w2")], df.schema)), "id", "text")
    assert index.state()["documents"] == 122
    index.delete(spark.createDataFrame([(999,)], "id long"))
    assert rows(index.search(q, 7)) == want and len(want) > 50


def test_bm25_in_blocks_against_plain_arithmetic(spark, monkeypatch):
    from quern.operators import fulltext

    monkeypatch.setattr(fulltext, "CELLS", 40)
    monkeypatch.setattr(fulltext, "QUERY_BLOCK", 2)
    rng = random.Random(9)
    docs = [(i, rng.choices("abcdefgh", k=rng.randint(0, 9))) for i in range(50)]
    asked = [(f"q{i}", t, w) for i in range(5) for t, w in {c: rng.randint(1, 3) for c in rng.sample("abcdefghij", 3)}.items()]
    got = bm25(spark.createDataFrame(asked, "q_id string, term string, weight long"), spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "id long, text string"), "id", "text", 4)
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {c: sum(c in t for _, t in docs) for c in "abcdefghij"}
    idf = {c: max(np.log((n - f + 0.5) / (f + 0.5)), 0) or 1e-6 for c, f in df.items()}
    want = []
    for q in sorted({a[0] for a in asked}):
        sc = [(-round(sum(w * idf[t] * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for x, t, w in asked if x == q and t in d), 6), i) for i, d in docs if any(x == q and t in d for x, t, w in asked)]
        want += [(q, i, r) for r, (_, i) in enumerate(sorted(sc)[:4], 1)]
    assert rows(got.select("q_id", "doc_id", "rank")) == sorted(want, key=repr)


def test_bm25_reads_documents_once_for_all_blocks(spark, monkeypatch):
    from quern.operators import fulltext

    made = []
    monkeypatch.setattr(fulltext, "stored", lambda df, real=fulltext.stored: made.append(1) or real(df))
    monkeypatch.setattr(fulltext, "QUERY_BLOCK", 2)
    monkeypatch.setattr(fulltext, "CELLS", 7)
    rng = random.Random(5)
    texts = [rng.choices("abcdefghijklmnop", k=rng.randint(1, 6)) for _ in range(20)]
    docs = [(100 - i, t) for i, t in enumerate(texts * 3)]  # every text stands three times: ties go to the least id
    asked = [(f"q{i}", t, rng.choice([1, 1, 3])) for i in range(9) for t in rng.sample("abcdefghijklmnop", 1 + i % 4)]
    got = bm25(spark.createDataFrame(asked, "q_id string, term string, weight long"), spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "id long, text string"), "id", "text", 4)
    avg = sum(len(t) for _, t in docs) / len(docs)
    df = {c: sum(c in t for _, t in docs) for c in "abcdefghijklmnop"}
    idf = {c: max(np.log((len(docs) - f + 0.5) / (f + 0.5)), 0) or 1e-6 for c, f in df.items()}
    want = []
    for q in sorted({a[0] for a in asked}):
        sc = [(-round(sum(w * idf[t] * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for x, t, w in asked if x == q and t in d), 6), i) for i, d in docs if any(x == q and t in d for x, t, w in asked)]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(sc)[:4], 1)]
    assert rows(got.select("q_id", "doc_id", "score", "rank")) == sorted(want, key=repr)
    assert len(made) == 1
    monkeypatch.setattr(fulltext, "QUERY_BLOCK", 4096)
    many = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("q_id"), F.lit("a").alias("term"), F.lit(1).alias("weight"))
    bm25(many, spark.createDataFrame([(1, "a b")], "id long, text string"), "id", "text", 4)
    assert len(made) == 2


def test_knn_ties_and_many_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "CELLS", 60)
    x = np.random.default_rng(2).normal(size=(30, 4)).round(1)
    x = np.concatenate([np.repeat(x[:1], 25, axis=0), x])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, vec array<double>")
    q = df.filter("id >= 20 and id < 30").select(F.col("id").alias("q_id"), F.col("vec").alias("qvec"))
    got = {}
    for r in vectors.knn(q, df, 5).orderBy("rank").collect():
        got.setdefault(r.q_id, []).append(r.id)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert got == {i: sorted(range(len(x)), key=lambda j: (d[i, j], j))[:5] for i in range(20, 30)}


def test_knn_in_tiles_against_plain_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", (3, 16))
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-9, 1e9):
        x = np.concatenate([rng.normal(size=(150, 5)).round(1), rng.normal(size=(3, 5)) + 1e3]) * scale
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        got = {}
        for r in vectors.knn(df.filter("id >= 140").select(F.col("id").alias("q_id"), F.col("vec").alias("qvec")), df, 4).orderBy("rank").collect():
            got.setdefault(r.q_id, []).append(r.id)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert got == {i: sorted(range(len(x)), key=lambda j: (d[i, j], j))[:4] for i in range(140, 153)}


def test_context_reads_its_chunks_once(spark):
    from quern.operators.answering import context

    chunks = spark.createDataFrame([("a", 1, "[C1]", "x" * 20, "s"), ("a", 2, "[C2]", "y" * 20, None), ("a", 3, "[C3]", "z" * 90, None), ("b", 1, "[C1]", "w" * 200, None)], "q_id string, rank int, tag string, text string, source_info string")
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    facts = spark.createDataFrame([("a", 1, "f" * 20), ("a", 2, "g" * 20), ("a", 3, "h"), ("b", 1, "k" * 80), ("b", 2, "m" * 30)], "q_id string, rank int, line string")
    got = rows(context(chunks.mapInArrow(seen, chunks.schema), facts, 25))
    assert got == [("a", 2, 3, '[C1] "' + "x" * 20 + '" (s)\n\n[C2] "' + "y" * 20 + '"\n\n' + "f" * 20 + "\n\n" + "g" * 20 + "\n\nh"), ("b", 0, 1, "k" * 80)]
    assert ran.value == chunks.count()


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "id long, embedding array<float>")
    new = spark.createDataFrame([(2, [1.0]), (2, [3.0]), (3, [2.0])], old.schema)
    assert rows(vectors.upsert(old, new, "id")) == [(1, [0.0]), (2, [3.0]), (3, [2.0])]


def test_embedding_in_batches(spark):
    class Many:
        calls = 0

        @staticmethod
        def embed_batch(texts):
            return [[3.0, 4.0] for _ in texts] if len(texts) > 1 else [3.0, 4.0]

    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "")], "q string, t string")
    got = vectors.embed(df, "q", "t", Many, batch=2).collect()
    assert [[round(v, 6) for v in r.embedding] for r in got] == [[0.6, 0.8]] * 3 and sorted(r.id for r in got) == ["a", "b", "c"]
    assert all(r.embedding == [3.0, 4.0] for r in vectors.embed(df, "q", "t", Many, normalize=False).collect())


def test_scores_of_answers(spark):
    schema = (
        "q_id string, run_index int, answer string, answerable boolean, keywords array<string>, valid_tags array<string>, expected_facts array<struct<subject:string,predicate:string>>, "
        "fact_hits array<struct<subject:string,predicate:string>>, expected_sources array<string>, chunk_sources array<string>"
    )
    df = spark.createDataFrame(
        [
            ("a", 0, "The Boat [C1] sank [C9]", True, ["boat", "fire"], ["[C1]"], [("ann", "OWN"), ("tom", "own")], [("Ann Bell", "own")], ["Ferry"], ["The ferry book"]),
            ("b", 0, "cannot find it", False, [], [], [], [], [], []), ("c", 0, None, None, [], [], [], [], [], []), ("d", 0, "yes", False, [], [], [], [], ["x"], []),
        ],
        schema,
    )
    got = {r.q_id: tuple(r)[2:] for r in evaluation.score_answers(df).collect()}
    assert got["a"] == (True, False, 0.5, 0.5, 1.0, False) and got["b"] == (False, True, 1.0, 1.0, 1.0, False)
    assert got["c"] == (False, True, 1.0, 1.0, 1.0, False) and got["d"] == (False, True, 1.0, 1.0, 0.0, True)


def test_judging_asks_again_and_needs_all_ids(spark):
    df = spark.createDataFrame([(f"q{i}", "fact", "Who?", True, "Ann [C1]" * 20, ["C1"], i // 30) for i in range(40)], "q_id string, q_type string, question string, answerable boolean, answer string, citations array<string>, run_index int")
    import json as j

    made = evaluation.judge_prompts(df, 1500).collect()
    assert sorted(i for r in made for i in r.asked) == sorted(f"q{i}" for i in range(30)) and all(len(r.prompt) < 2200 for r in made)

    def good(prompt):
        return "```json\n" + j.dumps([{"id": i["id"], "score": 140, "reason": "ok"} for i in j.loads(prompt[prompt.index("\n\n[{") + 2 :])]) + "\n```"

    assert rows(evaluation.run_judge(df, good, 1500)) == sorted([(f"q{i}", 100, "ok") for i in range(30)], key=repr)
    assert evaluation.run_judge(df, lambda p: "no", 1500).count() == 0 and evaluation.run_judge(df, None).count() == 0


def test_aggregate_falls_back_to_all_runs(spark):
    row = ("q", "fact", True, {"gen_ms": 4.0}, (True, True, 1.0, 1.0, 0.5, False), 80, 10.0, 1)
    df = spark.createDataFrame([row], "q_id string, q_type string, answerable boolean, timings map<string,double>, mechanical struct<citation_present:boolean,citation_valid:boolean,keyword_recall:double,fact_hit_rate:double,retrieval_hit_rate:double,hallucination:boolean>, judge_score int, peak_rss_mb double, run_index int")
    got = evaluation.run_aggregate(df).first()
    assert got.n_questions == 1 and got.mean_gen_ms == 4.0 and got.mean_fact_ms == 0.0 and got.median_judge_score == 80
    assert "n_questions" in evaluation.report(got.asDict()) and evaluation.changed_settings({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}) == {"b": (2, 3), "c": (None, 4)}


def test_measure_logs_even_on_failure(tmp_path):
    log = tmp_path / "m.jsonl"
    with pytest.raises(RuntimeError), evaluation.Measure("x", str(log)):
        raise RuntimeError
    assert '"error": "RuntimeError"' in log.read_text()
