"""Queries of retrieval: parsing, ranking, fusion, facts, contexts and propositions for whole batches of questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.text import ACCENTED, FOLDED, PROPOSITION_STOPWORDS, QUERY_STOPWORDS
from quern.operators import answering as an
from quern.operators import facts as fx
from quern.operators import propositions as props
from quern.operators import retrieval as rt
from quern.operators import vectors as vec
from quern.operators.fulltext import bm25
from quern.plans.base_queries import DOCUMENT, MENTION, NAMED, SYNONYM_SQL, USABLE, synonyms
from quern.plans.registry import query, sql_list
from quern.runtime import read_table as read

QUESTIONS = "questions AS (SELECT q_id, min(question) AS question FROM question_results WHERE question IS NOT NULL GROUP BY q_id)"
TERMS = f"list_filter(regexp_split_to_array(translate(lower({{0}}), '{ACCENTED}', '{FOLDED}'), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda t: t <> '')"
TERMS = TERMS.replace("{{L}}", "{L}").replace("{{N}}", "{N}")
CHUNK_DOCS = "SELECT id AS doc_id, text FROM chunks"
FACT_DOCS = f"SELECT id AS doc_id, {DOCUMENT.replace('AS document', 'AS text')} FROM named"
MINTED = f"{FACT_DOCS} WHERE source IN ('llm', 'closure') AND predicate IN ({sql_list(fx.ANSWER_PREDICATES)})"
PROPS = f"SELECT id, subject_id, object_id, lower(predicate) AS predicate, sentence FROM facts WHERE lower(predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)})"
PROP_DOCS = f"SELECT id AS doc_id, sentence AS text FROM ({PROPS})"


def terms_sql(column: str) -> str:
    return TERMS.replace("{0}", column)


def query_terms_sql(stop: list[str]) -> str:
    return f"qt AS (SELECT q_id, term, count(*) AS weight FROM (SELECT q_id, unnest({terms_sql('question')}) AS term FROM questions) WHERE length(term) > 2 AND term NOT IN ({sql_list(stop)}) GROUP BY q_id, term)"


def bm25_sql(docs: str, k: int, name: str = "hits", p: str = "", qt: str = "qt") -> str:
    """CTEs that end in (q_id, doc_id, score, rank) from docs (doc_id, text) and qt; p sets their names apart."""
    idf = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    return f"""{p}tok AS (SELECT doc_id, {terms_sql("coalesce(text, '')")} AS t FROM ({docs})),
{p}st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}tok),
{p}post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM {p}tok) GROUP BY doc_id, dl, term),
{p}df AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}idf AS (SELECT term, CASE WHEN {idf} <= 0 THEN 1e-6::DOUBLE ELSE {idf} END AS idf FROM {p}df, {p}st),
{p}sc AS (SELECT q.q_id, x.doc_id, round(sum(q.weight * i.idf * x.tf * 2.2::DOUBLE / (x.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * x.dl / s.avgdl))), 6) AS score
  FROM {qt} q JOIN {p}idf i ON i.term = q.term JOIN {p}post x ON x.term = q.term, {p}st s GROUP BY q.q_id, x.doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM {p}sc) WHERE rank <= {k})"""


def questions(spark, d):
    return read(spark, d, "question_results").filter("question is not null").groupBy("q_id").agg(F.min("question").alias("question"))


@query(f"WITH {QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)} SELECT q_id, term, weight FROM qt")
def query_terms(spark, d):
    return an.question_terms(questions(spark, d))


@query(f"WITH {QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {bm25_sql(CHUNK_DOCS, 12)} SELECT q_id, doc_id, score, rank::INT AS rank FROM hits")
def bm25_chunks(spark, d):
    return bm25(an.question_terms(questions(spark, d)), read(spark, d, "chunks"), "id", "text", 12)


def _fact_docs(spark, d, minted=False):
    return fx.fact_documents(fx.with_names(read(spark, d, "facts"), read(spark, d, "entities")), minted)


@query(f"WITH {NAMED}, {QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {bm25_sql(FACT_DOCS, 10)} SELECT q_id, doc_id, score, rank::INT AS rank FROM hits")
def bm25_facts(spark, d):
    return bm25(an.question_terms(questions(spark, d)), _fact_docs(spark, d), "id", "document", 10)


@query(f"WITH {NAMED}, {QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {bm25_sql(MINTED, 10)} SELECT q_id, doc_id, score, rank::INT AS rank FROM hits")
def bm25_facts_routed(spark, d):
    return bm25(an.question_terms(questions(spark, d)), _fact_docs(spark, d, minted=True), "id", "document", 10)


@query(f"WITH {QUESTIONS}, {query_terms_sql(PROPOSITION_STOPWORDS)}, {bm25_sql(PROP_DOCS, 30)} SELECT q_id, doc_id, score, rank::INT AS rank FROM hits")
def bm25_props(spark, d):
    p = props.from_facts(read(spark, d, "facts"))
    return bm25(an.question_terms(questions(spark, d), PROPOSITION_STOPWORDS), p, "prop_id", "statement", 30)


@query(f"WITH {QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {bm25_sql(CHUNK_DOCS, 12)} SELECT q_id, doc_id, score, rank::INT AS rank FROM hits")
def stored_index_search(spark, d):
    """bm25_chunks from a stored inverted index that was built, extended and cut again."""
    from quern.operators.fulltext import StoredIndex
    from quern.runtime import checkpoint_dir, folder_path

    index = StoredIndex(spark, folder_path(f"{checkpoint_dir(spark)}/index-chunks-{abs(hash(d))}"))
    chunks = read(spark, d, "chunks").select("id", "text")
    index.rebuild(read(spark, d, "chunks").filter("source_id > 1").select("id", "text"), "id", "text")
    index.append(chunks.unionByName(spark.createDataFrame([(-1, "a passage that is cut out again")], "id long, text string")), "id", "text")
    index.delete(spark.createDataFrame([(-1,)], "id long"))
    return index.search(an.question_terms(questions(spark, d)), 12)


WH = sql_list(rt.WH_WORDS)
PARSE = f"""parsed AS (SELECT q_id, list_filter(a, lambda x: x IN ({WH}))[1] AS wh_type,
  list_filter(CASE WHEN len(list_filter(a, lambda x: x IN ({WH}))) = 0 THEN w ELSE w[(pos + 1):len(w)] END,
    lambda x: regexp_full_match(x, '\\p{{L}}+') AND x NOT IN ({sql_list(rt.VERB_STOPS + rt.WH_WORDS)}))[1] AS verb
  FROM (SELECT q_id, a, w, coalesce(list_position(list_transform(w, lambda x: x IN ({WH})), true), 0) AS pos FROM
   (SELECT q_id, list_transform(b, lambda w: regexp_replace(w, '^[?]+|[?]+$', '', 'g')) AS a, list_transform(b, lambda w: regexp_replace(w, '^[?.,!;:]+|[?.,!;:]+$', '', 'g')) AS w FROM
    (SELECT q_id, list_filter(regexp_split_to_array(lower(question), '[ \\t\\n\\r]+'), lambda w: w <> '') AS b FROM questions))))"""


@query(f"WITH {QUESTIONS}, {PARSE} SELECT q_id, wh_type, verb FROM parsed")
def parse_question(spark, d):
    return rt.parse_question(questions(spark, d))


WORDS = "words AS (SELECT q_id, list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM questions)"
TITLES = "('mr', 'mrs', 'ms', 'dr', 'prof', 'sir', 'lady', 'lord', 'miss', 'saint', 'st')"


def mentions_sql(span: str, aliases: str) -> str:
    return f"""{WORDS},
spans AS (SELECT q_id, 3 - n AS tier, s - 1 AS start, array_to_string({span}, ' ') AS alias
  FROM words, range(1, 4) r(n), unnest(range(1, greatest(1, len(w) - n + 2))) u(s) WHERE s + n - 1 <= len(w)),
one AS (SELECT alias, min(entity_id) AS entity_id FROM ({aliases}) GROUP BY alias),
hit AS (SELECT q_id, entity_id, min(tier * 100000 + start) AS pos FROM spans JOIN one ON one.alias = spans.alias WHERE spans.alias <> '' GROUP BY q_id, entity_id),
mentions AS (SELECT q_id, entity_id, row_number() OVER (PARTITION BY q_id ORDER BY pos, entity_id)::INT AS position FROM hit)"""


MENTIONS = mentions_sql(f"list_filter(w[s:s + n - 1], lambda x: x NOT IN {TITLES})", "SELECT alias, entity_id FROM aliases")
PROP_ALIASES = f"SELECT id AS entity_id, lower(canonical_name) AS alias FROM entities UNION SELECT id, {MENTION.format('canonical_name')} FROM entities"
PLAIN_MENTIONS = mentions_sql("w[s:s + n - 1]", PROP_ALIASES)


@query(f"WITH {QUESTIONS}, {MENTIONS} SELECT q_id, entity_id, position FROM mentions")
def mention_scan(spark, d):
    return rt.mention_scan(questions(spark, d), read(spark, d, "aliases"))


@query(f"WITH {QUESTIONS}, {PLAIN_MENTIONS} SELECT q_id, entity_id, position FROM mentions")
def prop_mention_scan(spark, d):
    return rt.plain_mentions(questions(spark, d), props.entity_aliases(read(spark, d, "entities")))


def exact_sql(fit: str) -> str:
    """CTE exact (q_id, id, score) from parsed, mentions and the fit facts."""
    return f"""wanted AS (SELECT p.q_id, m.entity_id, p.verb FROM parsed p JOIN mentions m ON m.q_id = p.q_id WHERE p.verb IS NOT NULL),
asked AS (SELECT q_id, entity_id, verb AS predicate, 1.0::DOUBLE AS score FROM wanted UNION ALL SELECT q_id, entity_id, synonym, 0.8::DOUBLE FROM wanted JOIN both_syn ON both_syn.predicate = verb),
fit AS (SELECT * FROM named WHERE {USABLE} {fit}),
exact AS (SELECT a.q_id, f.id, max(a.score) AS score FROM asked a JOIN fit f ON f.subject_id = a.entity_id AND f.predicate = a.predicate GROUP BY a.q_id, f.id)"""


@query(f"WITH {SYNONYM_SQL}, {NAMED}, {QUESTIONS}, {PARSE}, {MENTIONS}, {exact_sql('')} SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id)::INT AS rank FROM exact")
def fact_lookup(spark, d):
    q = questions(spark, d)
    mentions = rt.mention_scan(q, read(spark, d, "aliases"))
    wanted = rt.parse_question(q).filter("verb is not null").join(mentions, "q_id").select("q_id", "entity_id", "verb")
    fit = fx.usable(fx.with_names(read(spark, d, "facts"), read(spark, d, "entities")))
    found = fx.lookup(wanted, fit, fx.both_directions(synonyms(spark)))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return found.select("q_id", "id", "score", F.row_number().over(order).alias("rank"))


GATE = "EXISTS (SELECT 1 FROM mentions m WHERE m.q_id = {0}.q_id AND (m.entity_id = f.subject_id OR m.entity_id = f.object_id))"


@query(f"WITH {NAMED}, {QUESTIONS}, {MENTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {bm25_sql(FACT_DOCS, 10)} SELECT DISTINCT h.q_id, h.doc_id AS id FROM hits h JOIN facts f ON f.id = h.doc_id WHERE {GATE.format('h')}")
def relevance_gate(spark, d):
    q = questions(spark, d)
    hits = bm25(an.question_terms(q), _fact_docs(spark, d), "id", "document", 10).select("q_id", F.col("doc_id").alias("id"))
    rows = hits.join(read(spark, d, "facts").select("id", "subject_id", "object_id"), "id")
    return fx.relevance_gate(rows, rt.mention_scan(q, read(spark, d, "aliases")))


#: A retrieval that takes facts from model output and coreference, four of them at most.
SETTINGS = an.Settings(fact_sources="minted+coref", max_facts_in_context=4)
MODE = "AND source IN ('llm', 'coref')"


def facts_sql(cap: int) -> str:
    """CTEs up to answer_facts (q_id, id, score, rank): lookup, then full text over the minted index, gated."""
    return f"""{SYNONYM_SQL}, {NAMED}, {QUESTIONS}, {PARSE}, {MENTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {exact_sql(MODE)}, {bm25_sql(MINTED, 10, 'fh', 'f_')},
newf AS (SELECT q_id, doc_id AS id, row_number() OVER (PARTITION BY q_id ORDER BY rank) - 1 AS place FROM fh WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.q_id = fh.q_id AND e.id = fh.doc_id)),
bothf AS (SELECT q_id, id, score, 0 AS list_no, 0 AS place FROM exact UNION ALL SELECT n.q_id, n.id, 0.7::DOUBLE - 0.01::DOUBLE * n.place, 1, n.place FROM newf n JOIN fit ON fit.id = n.id WHERE fit.subject_name <> lower(fit.subject_name)),
gated AS (SELECT b.* FROM bothf b JOIN facts f ON f.id = b.id WHERE {GATE.format('b')}),
answer_facts AS (SELECT * FROM (SELECT q_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, list_no, place, id) AS rank FROM gated) WHERE rank <= {cap})"""


def _facts(spark, d, settings=SETTINGS):
    return an.fact_hits(questions(spark, d), read(spark, d, "facts"), read(spark, d, "entities"), read(spark, d, "aliases"), fx.both_directions(synonyms(spark)), settings)


@query(f"WITH {facts_sql(4)} SELECT q_id, id, score, rank::INT AS rank, '[F' || rank || ']' AS tag FROM answer_facts")
def answer_facts(spark, d):
    return _facts(spark, d)


QV = """bits AS (SELECT q_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS i, CASE WHEN ('0x' || substr(md5(w), 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM
  (SELECT q_id, unnest(list_filter(regexp_split_to_array(lower(question), '[ \\t\\n\\r]+'), lambda w: w <> '')) AS w FROM questions)),
qv AS (SELECT q_id, list(CASE WHEN n = 0 THEN 0 ELSE (s / n)::FLOAT::DOUBLE END ORDER BY i) AS v FROM (SELECT q_id, i, s, sqrt(sum(s * s) OVER (PARTITION BY q_id)) AS n FROM
  (SELECT g.q_id, g.i, coalesce(sum(b.s), 0)::DOUBLE AS s FROM (SELECT q_id, unnest(range(0, 64)) AS i FROM questions) g LEFT JOIN bits b ON b.q_id = g.q_id AND b.i = g.i GROUP BY g.q_id, g.i)) GROUP BY q_id)"""


def usable_sql(name: str, table: str, key: str) -> str:
    return f"""{name} AS (SELECT key, list_transform(e, lambda x: x / n) AS v FROM (SELECT {key} AS key, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM {table}
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0))"""


def near_sql(name: str, vectors: str, k: int) -> str:
    return f"""{name} AS (SELECT q_id, key, d, rank FROM (SELECT q_id, key, d, row_number() OVER (PARTITION BY q_id ORDER BY d, key) AS rank FROM
  (SELECT q_id, key, list_distance(qv.v, x.v) AS d FROM qv, {vectors} x)) WHERE rank <= {k})"""


def ranking_sql(k: int, blend: bool = False, qt: str = "qt") -> str:
    """CTEs up to rrf (q_id, key, score, blended, rank), from questions and qt."""
    first = "blended DESC, " if blend else ""
    return f"""{QV}, {usable_sql('vc', 'vec_chunks', 'chunk_id')}, {near_sql('vn', 'vc', k)}, {bm25_sql(CHUNK_DOCS, k, 'ch', 'c_', qt)},
lists AS (SELECT q_id, key, 0 AS list_no, rank, 30 AS k, greatest(0, 1 - d) AS v, 0::DOUBLE AS t FROM vn
  UNION ALL SELECT q_id, doc_id, 1, rank, 60, 0, greatest(0, 1 - (rank - 1) / (count(*) OVER (PARTITION BY q_id))::DOUBLE) FROM ch),
fused AS (SELECT q_id, key, round(sum(1.0::DOUBLE / (k + rank)), 8) AS score, min(list_no * 1000000 + rank) AS first, round(0.5::DOUBLE * max(v) + 0.5::DOUBLE * max(t), 6) AS blended FROM lists GROUP BY q_id, key),
rrf AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {first}score DESC, first, key) AS rank FROM fused)"""


BASE = f"{QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)}"
INFO = "coalesce(nullif(title, ''), nullif(regexp_extract(path, '[^/]+$'), ''))"
PACK = f"""packed AS (SELECT * FROM (SELECT q_id, key, score, rank, text, {INFO} AS info, sum(length(text)) OVER (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used
  FROM rrf JOIN chunks c ON c.id = key LEFT JOIN sources s ON s.id = c.source_id) WHERE used <= 7200)"""


def _stored_vectors(spark, d):
    return vec.usable(read(spark, d, "vec_chunks"), "chunk_id")


def _ranking(spark, d, settings=SETTINGS):
    return an.chunk_ranking(questions(spark, d), read(spark, d, "chunks"), _stored_vectors(spark, d), settings)


def _chunk_hits(spark, d):
    return an.chunk_hits(_ranking(spark, d), read(spark, d, "chunks"), read(spark, d, "sources"), SETTINGS.context_token_budget)


@query(f"WITH {QUESTIONS}, {QV}, {usable_sql('vc', 'vec_chunks', 'chunk_id')}, {near_sql('vn', 'vc', 12)} SELECT q_id, key AS chunk_id, round(d, 5) AS distance, rank::INT AS rank FROM vn")
def vec_search_question(spark, d):
    near = vec.knn(an.question_vectors(questions(spark, d)), _stored_vectors(spark, d), 12)
    return near.select("q_id", F.col("id").alias("chunk_id"), F.round("distance", 5).alias("distance"), "rank")


@query(f"WITH {BASE}, {ranking_sql(12)} SELECT q_id, key, score, rank::INT AS rank FROM rrf")
def rrf_fuse(spark, d):
    return _ranking(spark, d).select("q_id", "key", "score", "rank")


@query(f"WITH {BASE}, {ranking_sql(24, blend=True)} SELECT q_id, key, round(blended, 5) AS blended, rank::INT AS rank FROM rrf")
def blend_rerank(spark, d):
    settings = an.Settings(rerank_mode="blend")
    return _ranking(spark, d, settings).select("q_id", "key", F.round("blended", 5).alias("blended"), "rank")


@query(f"WITH {BASE}, {ranking_sql(12)}, {PACK} SELECT q_id, key AS chunk_id, '[C' || rank || ']' AS tag, score, info AS source_info FROM packed")
def hybrid_retrieve(spark, d):
    return _chunk_hits(spark, d).select("q_id", "chunk_id", "tag", "score", "source_info")


QUALIFIERS = """CASE WHEN f.qualifiers IS NULL OR len(json_keys(f.qualifiers)) = 0 THEN '' ELSE ' (' || array_to_string(list_transform(json_keys(f.qualifiers), lambda k: k || ': ' || json_extract_string(f.qualifiers, '$."' || k || '"')), ', ') || ')' END"""
CONTEXT = f"""lines AS (SELECT * FROM (SELECT q_id, 0 AS part, rank, line, sum(length(line)) OVER (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM
  (SELECT q_id, rank, '[C' || rank || '] "' || text || '"' || coalesce(' (' || info || ')', '') AS line FROM packed)) WHERE used <= 7200),
before AS (SELECT q_id, max(used) AS b FROM lines GROUP BY q_id),
flines AS (SELECT a.q_id, a.rank, '[F' || a.rank || '] ' || f.subject_name || ' — ' || f.predicate || CASE WHEN f.negated THEN ' [NOT]' ELSE '' END
  || coalesce(' — ' || coalesce(nullif(f.object_name, ''), nullif(f.object_text, '')), '') || {QUALIFIERS} || chr(10) || '     "' || coalesce(f.sentence, '') || '"' || coalesce(' (' || {INFO} || ')', '') AS line
  FROM answer_facts a JOIN named f ON f.id = a.id JOIN chunks c ON c.id = f.chunk_id LEFT JOIN sources s ON s.id = c.source_id),
parts AS (SELECT q_id, part, rank, line FROM lines UNION ALL SELECT q_id, 1, rank, line FROM (SELECT l.q_id, rank, line, coalesce(b, 0) + sum(length(line)) OVER (PARTITION BY l.q_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM flines l LEFT JOIN before ON before.q_id = l.q_id) WHERE used <= 7200)"""


def _contexts(spark, d):
    tables = [read(spark, d, t) for t in ("facts", "entities", "chunks", "sources")]
    return an.context(_chunk_hits(spark, d), an.fact_lines(_facts(spark, d), *tables), SETTINGS.context_token_budget)


@query(f"WITH {facts_sql(4)}, {ranking_sql(12)}, {PACK}, {CONTEXT} SELECT q_id, count(*) FILTER (part = 0) AS n_chunks, count(*) FILTER (part = 1) AS n_facts, string_agg(line, chr(10) || chr(10) ORDER BY part, rank) AS context FROM parts GROUP BY q_id")
def context_pack(spark, d):
    return _contexts(spark, d)


@query(f"WITH {facts_sql(4)}, {ranking_sql(12)}, {PACK}, {CONTEXT}, ctx AS (SELECT q_id, string_agg(line, chr(10) || chr(10) ORDER BY part, rank) AS context FROM parts GROUP BY q_id) SELECT q.q_id, CASE WHEN trim(coalesce(context, '')) = '' THEN 'Question: ' || question ELSE 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer with inline citations ([C#] or [F#]):' END AS content FROM questions q LEFT JOIN ctx ON ctx.q_id = q.q_id")
def answer_prompt(spark, d):
    from quern.operators.generation import answer_prompts

    return answer_prompts(questions(spark, d), _contexts(spark, d)).select("q_id", "content")


@query(
    f"WITH {facts_sql(4)}, {ranking_sql(12)}, {PACK}, shown AS (SELECT q_id, 0 AS part, rank, '  [C' || rank || '] → ' || coalesce(info, 'unknown source') AS line FROM packed UNION ALL "
    f"SELECT a.q_id, 1, a.rank, '  [F' || a.rank || '] → ' || coalesce({INFO}, 'unknown source') || ' (fact: ' || f.subject_name || ' — ' || f.predicate || ')' FROM answer_facts a JOIN named f ON f.id = a.id JOIN chunks c ON c.id = f.chunk_id LEFT JOIN sources s ON s.id = c.source_id) "
    "SELECT q_id, 'Sources:' || chr(10) || string_agg(line, chr(10) ORDER BY part, rank) AS footer FROM shown GROUP BY q_id"
)
def sources_footer(spark, d):
    from quern.operators.generation import footers

    chunk_rows = _chunk_hits(spark, d).select("q_id", "tag", "source_info", F.lit(0).alias("part"), "rank")
    tags = chunk_rows.select("q_id", "tag", "part", "rank").unionByName(_facts(spark, d).select("q_id", "tag", F.lit(1).alias("part"), "rank"))
    hydrated = fx.hydrate(*[read(spark, d, t) for t in ("facts", "entities", "chunks", "sources")])
    return footers(tags, chunk_rows, _facts(spark, d).join(hydrated, "id"))


def _fact_vectors(spark, d):
    """Facts under the stored vector of their chunk, as no table holds vectors of facts."""
    v = _stored_vectors(spark, d).withColumnRenamed("id", "chunk_id")
    return read(spark, d, "facts").select("id", "chunk_id").join(v, "chunk_id").select("id", "vec")


def _near_facts(spark, d, k):
    q = questions(spark, d)
    return vec.knn(an.question_vectors(q), _fact_vectors(spark, d), k)


FV = f"{NAMED}, {QUESTIONS}, {query_terms_sql(QUERY_STOPWORDS)}, {QV}, {usable_sql('vc', 'vec_chunks', 'chunk_id')}, fv AS (SELECT f.id AS key, x.v FROM facts f JOIN vc x ON x.key = f.chunk_id)"
CLEAN = "name IS NOT NULL AND name <> lower(name) AND length(name) <= 60 AND position(',' IN name) = 0 AND position(chr(10) IN name) = 0"
NAMES = f"""names AS (SELECT DISTINCT q_id, name FROM (SELECT h.q_id, x.subject_name AS name FROM fn h JOIN named x ON x.id = h.key UNION ALL SELECT h.q_id, x.object_name FROM fn h JOIN named x ON x.id = h.key) WHERE {CLEAN})"""


@query(f"WITH {FV}, {near_sql('fn', 'fv', 2)}, {NAMES} SELECT q_id, string_agg(name, ' ' ORDER BY name) AS names FROM names GROUP BY q_id")
def expand_names(spark, d):
    named = fx.with_names(read(spark, d, "facts"), read(spark, d, "entities")).select("id", "subject_name", "object_name")
    n = _near_facts(spark, d, 2).join(named, "id").select("q_id", F.explode(F.array("subject_name", "object_name")).alias("name"))
    return an.clean_names(n).groupBy("q_id").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("names"))


@query(
    f"WITH {FV}, {near_sql('fn', 'fv', 2)}, {NAMES}, more AS (SELECT q_id, term, count(*) AS weight FROM (SELECT q_id, unnest({terms_sql('name')}) AS term FROM names) WHERE length(term) > 2 AND term NOT IN ({sql_list(QUERY_STOPWORDS)}) GROUP BY q_id, term), "
    f"wide AS (SELECT q_id, term, sum(weight)::BIGINT AS weight FROM (SELECT * FROM qt UNION ALL SELECT * FROM more) GROUP BY q_id, term), {bm25_sql(CHUNK_DOCS, 12, 'hits', 'w_', 'wide')} SELECT q_id, doc_id, score, rank::INT AS rank FROM hits"
)
def expand_query(spark, d):
    more = an.expansion_terms(_near_facts(spark, d, 2), read(spark, d, "facts"), read(spark, d, "entities"), 2)
    wide = an.question_terms(questions(spark, d)).unionByName(more).groupBy("q_id", "term").agg(F.sum("weight").alias("weight"))
    return bm25(wide, read(spark, d, "chunks"), "id", "text", 12)


@query(f"WITH {FV}, {near_sql('fn', 'fv', 10)} SELECT h.q_id, h.key AS id, round(greatest(0, 0.6::DOUBLE - 0.05::DOUBLE * h.d), 5) AS score FROM fn h JOIN named x ON x.id = h.key WHERE {USABLE} AND subject_name <> lower(subject_name)")
def vec_fact_surface(spark, d):
    fit = fx.proper_subjects(fx.usable(fx.with_names(read(spark, d, "facts"), read(spark, d, "entities")))).select("id")
    near = _near_facts(spark, d, 10).join(fit, "id", "left_semi")
    return near.select("q_id", "id", F.round(F.greatest(F.lit(0.0), 0.6 - 0.05 * F.col("distance")), 5).alias("score"))


PHRASES = (
    f"names AS (SELECT id AS entity_id, {terms_sql('canonical_name')} AS t FROM entities WHERE canonical_name IS NOT NULL), n AS (SELECT entity_id, ' ' || array_to_string(t, ' ') || ' ' AS phrase, ' ' || array_to_string(t, '  ') || ' ' AS inside, t FROM names WHERE len(t) > 0), "
    f"c AS (SELECT id, ' ' || array_to_string({terms_sql('text')}, ' ') || ' ' AS line, {terms_sql('text')} AS t FROM chunks WHERE text IS NOT NULL), w AS (SELECT id, unnest(list_distinct(t)) AS term FROM c), "
    "h AS (SELECT n.entity_id, c.id AS chunk_id, len(c.t) AS dl, (length(replace(c.line, ' ', '  ')) - length(replace(replace(c.line, ' ', '  '), n.inside, ''))) // length(n.inside) AS tf FROM n JOIN w ON w.term = n.t[len(n.t)] JOIN c ON c.id = w.id WHERE contains(c.line, n.phrase)), "
    "s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM c), f AS (SELECT entity_id, count(*) AS df FROM h GROUP BY entity_id), "
    "sc AS (SELECT h.entity_id, chunk_id, round(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)), 6) AS score FROM h JOIN f ON f.entity_id = h.entity_id, s), "
    "ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 8)"
)


@query(f"WITH {PHRASES} SELECT entity_id, chunk_id, score, rank::INT AS rank FROM ranked")
def phrase_chunks(spark, d):
    from quern.operators.extraction import phrase_hits

    names = read(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    return phrase_hits(names, read(spark, d, "chunks").filter("text is not null"), 8).select("entity_id", "chunk_id", "score", "rank")


# the questions of the runs, and one about the home of every entity
ASKED = "questions AS (SELECT q_id, min(question) AS question FROM question_results WHERE question IS NOT NULL GROUP BY q_id UNION ALL SELECT 'e' || id, 'What is the location of ' || canonical_name || '?' FROM entities WHERE canonical_name IS NOT NULL)"


def proposition_questions(spark, d):
    own = read(spark, d, "entities").filter("canonical_name is not null")
    about = own.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("q_id"), F.concat(F.lit("What is the location of "), "canonical_name", F.lit("?")).alias("question"))
    return questions(spark, d).unionByName(about)


def _map_sql(name: str, table: dict[str, str]) -> str:
    return f"{name}(word, predicate) AS (VALUES " + ", ".join(f"('{k}', '{p}')" for k, v in table.items() for p in v.split()) + ")"


PROP_HITS = f"""{ASKED}, {PARSE}, {PLAIN_MENTIONS}, {_map_sql('vm', props.VERB_PREDICATES)}, {_map_sql('nm', props.NOUN_PREDICATES)},
tries AS (SELECT q_id, verb AS predicate FROM parsed WHERE verb IS NOT NULL UNION SELECT q_id, predicate FROM parsed JOIN vm ON vm.word = verb
  UNION SELECT x.q_id, predicate FROM (SELECT q_id, unnest(w) AS word FROM words) x JOIN nm ON nm.word = x.word JOIN parsed p ON p.q_id = x.q_id WHERE NOT (x.word IN ({sql_list(props.CONDITIONAL_NOUNS)}) AND p.verb IS NOT NULL)),
qt AS (SELECT DISTINCT q_id, term, 1 AS weight FROM (SELECT q_id, unnest({terms_sql('question')}) AS term FROM questions WHERE q_id IN (SELECT q_id FROM tries) UNION ALL SELECT q_id, unnest({terms_sql("replace(predicate, '_', ' ')")}) FROM tries) WHERE length(term) > 2 AND term NOT IN ({sql_list(PROPOSITION_STOPWORDS)})),
{bm25_sql(PROP_DOCS, 30)},
p AS ({PROPS}),
b AS (SELECT id, subject_id AS e FROM p UNION SELECT id, object_id FROM p WHERE object_id IS NOT NULL),
en AS (SELECT DISTINCT m.q_id, b.id FROM mentions m JOIN b ON b.e = m.entity_id WHERE m.q_id IN (SELECT q_id FROM tries)),
ft AS (SELECT q_id, doc_id AS id, greatest(0, 1 - (rank - 1) / (count(*) OVER (PARTITION BY q_id))::DOUBLE) AS t FROM hits),
cand AS (SELECT q_id, id FROM ft UNION SELECT q_id, id FROM en),
s AS (SELECT c.q_id, c.id, round(coalesce(ft.t, 0) + 0.25::DOUBLE + CASE WHEN en.id IS NULL THEN 0 ELSE 0.1::DOUBLE END, 6) AS score FROM cand c JOIN p ON p.id = c.id
  JOIN tries y ON y.q_id = c.q_id AND y.predicate = p.predicate LEFT JOIN ft ON ft.q_id = c.q_id AND ft.id = c.id LEFT JOIN en ON en.q_id = c.q_id AND en.id = c.id),
prop_hits AS (SELECT q_id, id AS prop_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3 AND score >= 0.05)"""


def _proposition_hits(spark, d):
    p = props.from_facts(read(spark, d, "facts"))
    return an.proposition_hits(proposition_questions(spark, d), p, props.entity_aliases(read(spark, d, "entities")))


@query(f"WITH {PROP_HITS} SELECT q_id, prop_id, score, rank::INT AS rank FROM prop_hits")
def retrieve_propositions(spark, d):
    return _proposition_hits(spark, d)


@query(
    f"WITH {PROP_HITS}, l AS (SELECT q_id, rank, '[P' || rank || '] ' || coalesce(sentence, '') AS line FROM prop_hits h JOIN p ON p.id = h.prop_id), "
    "u AS (SELECT *, sum(length(line)) OVER (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM l), g AS (SELECT q_id, string_agg(line, chr(10) ORDER BY rank) AS block FROM u WHERE used <= 800 GROUP BY q_id) "
    "SELECT q.q_id, block, block IS NOT NULL AS has_facts FROM questions q LEFT JOIN g ON g.q_id = q.q_id"
)
def prop_prompt(spark, d):
    from quern.operators.generation import proposition_prompts

    p = props.from_facts(read(spark, d, "facts")).select("prop_id", "statement")
    made = proposition_prompts(proposition_questions(spark, d), _proposition_hits(spark, d).join(p, "prop_id"))
    return made.select("q_id", "block", F.col("block").isNotNull().alias("has_facts"))
