"""Queries over runs and answers: citations, scores, judging, model output, prompts, skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import terms
from quern.operators import enrichment as en
from quern.operators import evaluation as ev
from quern.operators import extraction as ex
from quern.operators import facts as fx
from quern.operators import propositions as props
from quern.operators import retrieval as rt
from quern.plans.base_queries import KNOWN, MENTION
from quern.plans.registry import query, sql_list
from quern.plans.retrieval_queries import INFO, PACK, PHRASES, _chunk_hits, _facts, facts_sql, questions, ranking_sql, terms_sql
from quern.runtime import read_table as read


@query("SELECT q_id, run_index, array_to_string(tags, ' ') AS tags FROM (SELECT DISTINCT q_id, run_index, answer, list_filter(t, lambda x, i: list_position(t, x) = i) AS tags FROM (SELECT q_id, run_index, answer, regexp_extract_all(answer, '\\[[FCP][0-9]+\\]') AS t FROM question_results WHERE answer IS NOT NULL))")
def cited_tags(spark, d):
    r = read(spark, d, "question_results").filter("answer is not null").select("q_id", "run_index", "answer").distinct()
    return r.select("q_id", "run_index", F.concat_ws(" ", rt.cited_tags(F.col("answer"))).alias("tags"))


@query("SELECT q_id, run_index, regexp_replace(answer, '\\[[FP][0-9]+\\]', '', 'g') AS answer FROM (SELECT DISTINCT q_id, run_index, answer FROM question_results WHERE answer IS NOT NULL)")
def strip_citations(spark, d):
    r = read(spark, d, "question_results").filter("answer is not null").select("q_id", "run_index", "answer").distinct()
    valid = F.filter(rt.cited_tags(F.col("answer")), lambda t: t.startswith("[C"))
    return r.select("q_id", "run_index", rt.strip_citations(F.col("answer"), valid).alias("answer"))


@query(f"SELECT DISTINCT q_id, run_index, ({' OR '.join(f'''contains(lower(answer), '{p}')''' for p in rt.REFUSAL_PHRASES)}) AS refused FROM question_results WHERE answer IS NOT NULL")
def is_refusal(spark, d):
    r = read(spark, d, "question_results").filter("answer is not null")
    return r.select("q_id", "run_index", rt.is_refusal(F.col("answer")).alias("refused")).distinct()


_AGG = ", ".join(
    f"round(avg(CASE WHEN q_type = '{t}' THEN judge_score END), 6) AS mean_judge_{t}" for t in ("fact", "paraphrase", "multi_hop", "negative")
)


@query(
    f"""SELECT count(DISTINCT q_id) AS n_questions, round(coalesce(avg(mechanical.keyword_recall), 0), 6) AS mean_keyword_recall, round(coalesce(avg(mechanical.fact_hit_rate), 0), 6) AS mean_fact_hit_rate,
round(coalesce(avg(mechanical.retrieval_hit_rate), 0), 6) AS mean_retrieval_hit_rate, round(coalesce(avg(CASE WHEN answerable THEN mechanical.citation_present::INT END), 0), 6) AS citation_present_rate,
round(coalesce(avg(CASE WHEN answerable THEN mechanical.citation_valid::INT END), 0), 6) AS citation_valid_rate, sum(CASE WHEN mechanical.hallucination THEN 1 ELSE 0 END)::BIGINT AS hallucination_count,
round(coalesce(avg(coalesce(timings['gen_ms'], 0)), 0), 6) AS mean_gen_ms, round(coalesce(avg(coalesce(timings['fact_ms'], 0)), 0), 6) AS mean_fact_ms,
round(coalesce(avg(peak_rss_mb), 0), 6) AS mean_peak_rss_mb, round(avg(judge_score), 6) AS mean_judge_score, round(median(judge_score), 6) AS median_judge_score, {_AGG} FROM question_results
WHERE run_index = 0 OR NOT EXISTS (SELECT 1 FROM question_results WHERE run_index = 0)"""
)
def run_aggregate(spark, d):
    return ev.run_aggregate(read(spark, d, "question_results"))


@query(
    """WITH t AS (SELECT run_index, unnest(map_entries(timings)) AS k FROM question_results WHERE run_index IN (0, 1)),
a AS (SELECT k.key AS metric, round(avg(k.value), 6) AS value FROM t WHERE run_index = 0 GROUP BY k.key), b AS (SELECT k.key AS metric, round(avg(k.value), 6) AS value FROM t WHERE run_index = 1 GROUP BY k.key)
SELECT coalesce(a.metric, b.metric) AS metric, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta,
CASE WHEN b.value - a.value IS NULL THEN NULL WHEN round(b.value - a.value, 6) = 0 THEN 'equal' WHEN b.value < a.value THEN 'better' ELSE 'regress' END AS verdict FROM a FULL JOIN b ON a.metric = b.metric"""
)
def compare_runs(spark, d):
    t = read(spark, d, "question_results").filter("run_index in (0, 1)").select("run_index", F.explode("timings").alias("metric", "value"))

    def run(n):
        return t.filter(F.col("run_index") == n).groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))

    names = ["parse_ms", "fact_ms", "vec_ms", "fts_ms", "fusion_ms", "gen_ms"]
    return ev.compare_runs(run(0), run(1), names)


@query("SELECT DISTINCT q_id || '#' || run_index AS batch_id, q_id AS id, least(100, greatest(0, coalesce(judge_score, 50) + 40))::INT AS score, coalesce(judge_reason, '') AS reason FROM question_results")
def parse_judge(spark, d):
    r = read(spark, d, "question_results").select("q_id", "run_index", "judge_score", "judge_reason").distinct()
    item = F.to_json(F.array(F.struct(F.col("q_id").alias("id"), (F.coalesce("judge_score", F.lit(50)) + 40).alias("score"), F.coalesce("judge_reason", F.lit("")).alias("reason"))))
    rows = r.select(F.concat("q_id", F.lit("#"), F.col("run_index").cast("string")).alias("batch_id"), F.concat(F.lit("```json\n"), item, F.lit("\n```")).alias("response"), F.array("q_id").alias("asked"))
    return ev.parse_judge(rows).distinct()


@query()
def judge_scores(spark, d):
    """Every question's first run put to a judge that gives full marks to answers with a citation."""
    def judge(prompt):
        import json

        return json.dumps([{"id": i["id"], "score": 100 if i.get("citations_used") else 0, "reason": "by its citations"} for i in json.loads(prompt[prompt.index("\n\n[{") + 2 :])])

    return ev.run_judge(read(spark, d, "question_results"), judge)


@query(
    f"SELECT chunk_id, subject, lower(predicate) AS predicate, coalesce(object_text, '') AS object, trim(coalesce(sentence, '')) AS sentence, negated FROM (SELECT f.chunk_id, s.canonical_name AS subject, f.predicate, f.object_text, f.sentence, f.negated FROM facts f JOIN entities s ON s.id = f.subject_id) WHERE lower(predicate) IN ({sql_list(fx.FACT_TAXONOMY)}) AND trim(subject) <> ''"
)
def parse_model_facts(spark, d):
    """A model's facts read back: every fact of the table stands as one answer, its predicate in capitals, inside a code fence."""
    named = fx.with_names(read(spark, d, "facts"), read(spark, d, "entities"))
    item = F.to_json(F.array(F.struct(F.col("subject_name").alias("subject"), F.upper("predicate").alias("predicate"), F.coalesce("object_text", F.lit("")).alias("object"), "sentence", "negated")))
    rows = named.select("chunk_id", F.concat(F.lit("Here:\n```json\n"), item, F.lit("\n```")).alias("response"))
    got = ev.parse_model_facts(rows, fx.FACT_TAXONOMY)
    return got.select("chunk_id", "subject", "predicate", "object", F.coalesce("sentence", F.lit("")).alias("sentence"), "negated")


@query(
    f"SELECT chunk_id, lower(predicate) AS predicate, trim(subject_name) AS agent, CASE WHEN trim(coalesce(object_name, object_text, '')) = '' THEN '' ELSE trim(coalesce(object_name, object_text)) END AS themes, trim(sentence) AS statement FROM (SELECT f.*, s.canonical_name AS subject_name, o.canonical_name AS object_name FROM facts f JOIN entities s ON s.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id) "
    f"WHERE lower(predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)}) AND trim(subject_name) <> '' AND trim(coalesce(sentence, '')) <> ''"
)
def parse_model_props(spark, d):
    """A model's propositions read back: every fact stands as one answer, its object as the list of themes."""
    named = fx.with_names(read(spark, d, "facts"), read(spark, d, "entities"))
    theme = F.coalesce("object_name", "object_text")
    item = F.to_json(F.array(F.struct(F.upper("predicate").alias("predicate"), F.col("subject_name").alias("agent"), F.filter(F.array(theme), lambda t: t.isNotNull()).alias("themes"), F.col("sentence").alias("statement"))))
    got = en.parse_model_propositions(named.select("chunk_id", item.alias("response")))
    return got.select("chunk_id", "predicate", "agent", F.array_join("themes", "; ").alias("themes"), "statement")


@query(
    """WITH RECURSIVE b AS (SELECT source_id, list(length(text) ORDER BY id) AS s FROM chunks GROUP BY source_id),
f AS (SELECT source_id, s, 1 AS i, 0 AS bin, s[1]::BIGINT AS used, CAST('0' AS VARCHAR) AS bins FROM b UNION ALL
SELECT source_id, s, i + 1, CASE WHEN used + s[i + 1] > 5000 AND used > 0 THEN bin + 1 ELSE bin END, CASE WHEN used + s[i + 1] > 5000 AND used > 0 THEN s[i + 1] ELSE used + s[i + 1] END,
bins || ',' || CAST(CASE WHEN used + s[i + 1] > 5000 AND used > 0 THEN bin + 1 ELSE bin END AS VARCHAR) FROM f WHERE i < len(s))
SELECT CAST(source_id AS VARCHAR) AS batch_id, bins FROM f WHERE i = len(s)"""
)
def split_payload(spark, d):
    c = read(spark, d, "chunks").groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.length("text").alias("n")))), lambda x: x["n"].cast("long")).alias("sizes"))
    out = ev.split_bins(c.select(F.col("source_id").cast("string").alias("batch_id"), "sizes"), 5000)
    return out.select("batch_id", F.concat_ws(",", F.transform("bins", lambda b: b.cast("string"))).alias("bins"))


VALID = "valid AS (SELECT q_id, list(tag) AS tags FROM (SELECT q_id, '[C' || rank || ']' AS tag FROM packed UNION ALL SELECT q_id, '[F' || rank || ']' FROM answer_facts) GROUP BY q_id)"
PLACES = "places AS (SELECT q_id, max(CASE WHEN contains(lower(info), 'night') THEN 1 ELSE 0 END)::DOUBLE AS hit FROM packed WHERE info IS NOT NULL GROUP BY q_id)"
EXPECTED = """expected AS (SELECT m.q_id, lower(e.canonical_name) AS subject FROM mentions m JOIN entities e ON e.id = m.entity_id WHERE m.position = 1 AND e.canonical_name IS NOT NULL),
met AS (SELECT x.q_id, max(CASE WHEN contains(lower(n.subject_name), x.subject) AND lower(n.predicate) = 'work_as' THEN 1 ELSE 0 END)::DOUBLE AS hit FROM expected x LEFT JOIN answer_facts a ON a.q_id = x.q_id LEFT JOIN named n ON n.id = a.id GROUP BY x.q_id)"""


@query(
    f"WITH {facts_sql(4)}, {ranking_sql(12)}, {PACK}, {VALID}, {PLACES}, {EXPECTED}, r AS (SELECT DISTINCT q_id, run_index, answer, answerable, question FROM question_results), "
    f"t AS (SELECT r.*, list_distance_tags, coalesce(v.tags, []) AS valid, k FROM (SELECT *, list_distinct(regexp_extract_all(coalesce(answer, ''), '\\[[FCP][0-9]+\\]')) AS list_distance_tags, list_filter({terms_sql('question')}, lambda w: length(w) > 6) AS k FROM r) r LEFT JOIN valid v ON v.q_id = r.q_id) "
    "SELECT t.q_id, run_index, len(list_distance_tags) > 0 AS citation_present, len(list_filter(list_distance_tags, lambda x: NOT list_contains(valid, x))) = 0 AS citation_valid, "
    "round(CASE WHEN coalesce(len(k), 0) = 0 THEN 1 ELSE len(list_filter(k, lambda w: contains(lower(coalesce(answer, '')), w)))::DOUBLE / len(k) END, 6) AS keyword_recall, "
    "round(coalesce(met.hit, 1), 6) AS fact_hit_rate, round(coalesce(places.hit, 0), 6) AS retrieval_hit_rate, "
    f"NOT coalesce(answerable, true) AND NOT ({' OR '.join(f"contains(lower(coalesce(answer, '')), '{p}')" for p in rt.REFUSAL_PHRASES)}) AS hallucination FROM t LEFT JOIN met ON met.q_id = t.q_id LEFT JOIN places ON places.q_id = t.q_id"
)
def score_mechanical(spark, d):
    """Answers against what their retrieval held: the question's longer words as keywords, the first mention's trade as expected fact, the
    night ferry as expected source."""
    r = read(spark, d, "question_results").select("q_id", "run_index", "answer", "answerable", "question").distinct()
    hits, chunks = _facts(spark, d), _chunk_hits(spark, d)
    tags = chunks.select("q_id", "tag").unionByName(hits.select("q_id", "tag")).groupBy("q_id").agg(F.collect_set("tag").alias("valid_tags"))
    places = chunks.filter("source_info is not null").groupBy("q_id").agg(F.collect_set("source_info").alias("chunk_sources"))
    entities = read(spark, d, "entities").filter("canonical_name is not null").select(F.col("id").alias("entity_id"), "canonical_name")
    first = rt.mention_scan(questions(spark, d), read(spark, d, "aliases")).filter("position = 1").join(entities, "entity_id")
    expected = first.groupBy("q_id").agg(F.collect_list(F.struct(F.lower("canonical_name").alias("subject"), F.lit("work_as").alias("predicate"))).alias("expected_facts"))
    named = fx.with_names(read(spark, d, "facts"), read(spark, d, "entities")).select("id", "subject_name", "predicate")
    held = hits.join(named, "id").groupBy("q_id").agg(F.collect_list(F.struct(F.col("subject_name").alias("subject"), "predicate")).alias("fact_hits"))
    rows = r.withColumn("keywords", F.filter(terms(F.col("question")), lambda w: F.length(w) > 6)).withColumn("expected_sources", F.array(F.lit("night")))
    for part in (tags, places, expected, held):
        rows = rows.join(part, "q_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("valid_tags", "chunk_sources", "expected_facts", "fact_hits")}
    return ev.score_answers(rows.withColumns(empty)).distinct()


@query(
    """WITH t AS (SELECT q_id AS conv_id, min(run_index) AS turn, coalesce(min(answer), '') AS content FROM question_results GROUP BY q_id, run_index),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t),
p AS (SELECT *, i // 2 AS pair, count(*) OVER (PARTITION BY conv_id, i // 2) AS m FROM n),
l AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY pair DESC) AS back FROM p WHERE m = 2),
c AS (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY back RANGE UNBOUNDED PRECEDING) AS chars FROM l WHERE back <= 3)
SELECT conv_id, turn, content FROM c WHERE chars <= 400"""
)
def trim_history(spark, d):
    r = read(spark, d, "question_results").groupBy(F.col("q_id").alias("conv_id"), F.col("run_index").alias("turn")).agg(F.coalesce(F.min("answer"), F.lit("")).alias("content"))
    return rt.trim_history(r.withColumn("role", F.lit("user")), 3, 100).select("conv_id", "turn", "content")


_TEMPLATES = {"take": "What did X take?", "observe": "What did X observe?", "enter": "Where did X enter?", "be": "What was X?", "possess": "What did X possess?", "say": "What did X say?", "find": "What did X find?", "give": "What did X give?", "see": "What did X see?", "know": "What did X know?"}
_CASES = " ".join(f"WHEN '{p}' THEN '{t.split('X')[0]}' || s.canonical_name || '{t.split('X')[1]}'" for p, t in _TEMPLATES.items())


@query(
    f"""WITH r AS (SELECT f.id, s.canonical_name AS subject, f.predicate, coalesce(f.object_text, '') AS object, {INFO} AS source, CASE f.predicate {_CASES} ELSE 'What did ' || s.canonical_name || ' ' || f.predicate || '?' END AS question,
row_number() OVER (ORDER BY md5(f.id || '#7'), f.id) AS n FROM facts f JOIN entities s ON s.id = f.subject_id LEFT JOIN chunks c ON c.id = f.chunk_id LEFT JOIN sources o ON o.id = c.source_id
WHERE (o.title ILIKE '%night%' OR o.path ILIKE '%night%') AND f.confidence >= 0.8)
SELECT 'q' || lpad(n::VARCHAR, 3, '0') AS item, question, object AS keyword, lower(subject) AS subject, predicate, source FROM r WHERE n <= 20"""
)
def qna_skeleton(spark, d):
    """Twenty draft questions from the facts of the sources about the night ferry, in a seeded order."""
    return ev.skeleton(*[read(spark, d, t) for t in ("facts", "entities", "chunks", "sources")], "night", 20, 7)


@query(
    f"WITH {KNOWN}, k AS (SELECT string_agg(canonical_name, ', ' ORDER BY n DESC, id) AS names FROM known) SELECT c.id, CASE WHEN names IS NULL THEN '' ELSE 'Known entities in this corpus (prefer these canonical names):' || chr(10) || names || chr(10) || chr(10) END || 'Text:' || chr(10) || c.text AS prompt FROM chunks c, k WHERE c.text IS NOT NULL"
)
def prompt_build(spark, d):
    """The extraction prompt of every chunk."""
    names = en.known_names(read(spark, d, "entities"), read(spark, d, "facts"))
    texts = read(spark, d, "chunks").filter("text is not null").select(F.col("id").alias("q_id"), "text")
    return en.prompts("extraction", texts, names).select(F.col("q_id").cast("long").alias("id"), F.col("content").alias("prompt"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def stream_ingest_dedup(spark, d):
    from quern.streaming.ingest import ingest_available

    return ingest_available(spark, f"{d}/documents.parquet")


@query()
def extract_propositions(spark, d):
    """Introductions in direct speech: those of the chunks, and one spoken for every fact that introduces an entity."""
    named = fx.with_names(read(spark, d, "facts").filter("predicate = 'introduce' and object_id is not null"), read(spark, d, "entities"))
    spoken = F.concat(F.lit('It was late. "'), "subject_name", F.lit(', Mr. '), "object_name", F.lit('," said Porter, introducing us. They sat down.'))
    rows = named.select((-F.col("id")).alias("id"), spoken.alias("text"))
    return ex.extract_introductions(read(spark, d, "chunks").select("id", "text").unionByName(rows))


@query()
def extract_facts(spark, d):
    """Facts read from the sentences of all facts by the plain parser."""
    sentences = read(spark, d, "facts").filter("sentence is not null").select(F.col("id").alias("sentence_id"), F.col("sentence").alias("text"))
    parsed = ex.parse_sentences(sentences)
    return ex.extract_facts(parsed).join(ex.qualifiers(parsed), "sentence_id", "left")


@query(
    f"WITH {PHRASES}, l AS (SELECT h.entity_id, c.ordinal, c.id, c.text FROM ranked h JOIN chunks c ON c.id = h.chunk_id), g AS (SELECT entity_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ordinal NULLS FIRST, id) AS t, first(id ORDER BY ordinal NULLS FIRST, id) AS first_chunk FROM l GROUP BY entity_id) SELECT entity_id, first_chunk, substr(t, 1, 4000) AS context FROM g"
)
def entity_context(spark, d):
    names = read(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    return ex.entity_context(names, read(spark, d, "chunks").filter("text is not null"))


@query(
    "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < sqrt(2 * (1 - 0.2))"
)
def cosine_threshold_match(spark, d):
    from quern.operators import vectors as vec

    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.filter("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("qvec"))
    return vec.within(q, e, vec.cosine_threshold(0.2)).select(F.col("q_id").alias("a"), F.col("id").alias("b"))


@query(
    f"""WITH names AS (SELECT e.canonical_name AS name FROM entities e JOIN facts f ON f.subject_id = e.id WHERE lower(f.predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)}) UNION SELECT e.canonical_name FROM entities e JOIN facts f ON f.object_id = e.id WHERE lower(f.predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)}))
SELECT name AS canonical, alias FROM (SELECT name, lower(name) AS alias FROM names UNION SELECT name, {MENTION.format('name')} FROM names) WHERE name IS NOT NULL AND alias <> ''"""
)
def prop_entities(spark, d):
    """The entities that propositions make where none has their name: one per canonical name, with its aliases."""
    named = fx.with_names(read(spark, d, "facts"), read(spark, d, "entities")).filter(F.lower("predicate").isin(props.PROPOSITION_TAXONOMY))
    return props.ensure_entities(named.select(F.explode(F.array("subject_name", "object_name")).alias("name"))).select("canonical", "alias")
