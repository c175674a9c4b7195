"""Queries over sources, chunks, entities and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import normalize_mention as mention_form
from quern.functions.text import source_info as shown_source
from quern.operators import entities as ents
from quern.operators import facts as fx
from quern.operators import ingest as ing
from quern.operators import propositions as props
from quern.operators import vectors as vec
from quern.plans.registry import query, sql_list
from quern.runtime import read_table as read

NAMED = """named AS (SELECT f.*, s.canonical_name AS subject_name, o.canonical_name AS object_name
  FROM facts f JOIN entities s ON s.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id)"""
MENTION = (
    "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[.,;:!?\"''`]', ' ', 'g'), '[ \\t\\n\\r]+'), "
    "lambda w: w <> '' AND w NOT IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'sir', 'lady', 'lord', 'miss', 'saint', 'st')), ' ')"
)
USABLE = "(object_text IS NOT NULL OR object_id IS NOT NULL) AND length(subject_name) <= 60 AND position(',' IN subject_name) = 0 AND position(chr(10) IN subject_name) = 0"


def _named(spark, d):
    return fx.with_names(read(spark, d, "facts"), read(spark, d, "entities"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return read(spark, d, "documents").filter("text is not null").select("doc_id", ing.content_hash(F.col("text")).alias("sha256"))


@query("SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY id) n FROM sources) WHERE n = 1")
def source_dedup(spark, d):
    return ing.first_by(read(spark, d, "sources"), ["sha256"], ["id"]).select("id", "path")


@query("SELECT id, source_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY id) n FROM chunks) WHERE n = 1")
def chunk_dedup(spark, d):
    return ing.first_by(read(spark, d, "chunks"), ["sha256"], ["id"]).select("id", "source_id", "ordinal")


@query(
    "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, subject_id, predicate, object_text, qualifiers ORDER BY id) n FROM facts) WHERE n = 1"
)
def fact_dedup(spark, d):
    return fx.dedup_facts(read(spark, d, "facts")).select("id")


@query(
    "SELECT prop_id, chunk_id, predicate FROM (SELECT id AS prop_id, chunk_id, lower(predicate) AS predicate, row_number() OVER "
    f"(PARTITION BY chunk_id, lower(predicate), sentence ORDER BY id) n FROM facts WHERE lower(predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)})) WHERE n = 1"
)
def proposition_dedup(spark, d):
    p = props.from_facts(read(spark, d, "facts"))
    return ing.first_by(p, ["chunk_id", "predicate", "statement"], ["prop_id"]).select("prop_id", "chunk_id", "predicate")


@query(f"WITH {NAMED} SELECT id, subject_name, predicate FROM named WHERE {USABLE}")
def fact_usable_filter(spark, d):
    return fx.usable(_named(spark, d)).select("id", "subject_name", "predicate")


@query(f"WITH {NAMED} SELECT id, subject_name FROM named WHERE subject_name <> lower(subject_name)")
def proper_noun_filter(spark, d):
    return fx.proper_subjects(_named(spark, d)).select("id", "subject_name")


@query("SELECT id, source, confidence FROM facts WHERE source IN ('llm', 'coref')")
def fact_source_filter(spark, d):
    return fx.by_source(read(spark, d, "facts"), "minted+coref").select("id", "source", "confidence")


@query(f"SELECT id, lower(predicate) AS predicate FROM facts WHERE lower(predicate) IN ({sql_list(fx.FACT_TAXONOMY)})")
def taxonomy_gate(spark, d):
    p = F.lower("predicate")
    return read(spark, d, "facts").filter(p.isin(fx.FACT_TAXONOMY)).select("id", p.alias("predicate"))


@query("SELECT id, coalesce(nullif(title, ''), nullif(regexp_extract(path, '[^/]+$'), '')) AS source_info FROM sources")
def source_info(spark, d):
    return read(spark, d, "sources").select("id", shown_source(F.col("title"), F.col("path")).alias("source_info"))


@query("SELECT id, title FROM sources WHERE title ILIKE '%night%' OR path ILIKE '%night%'")
def source_contains(spark, d):
    s = read(spark, d, "sources")
    return s.filter(F.col("title").ilike("%night%") | F.col("path").ilike("%night%")).select("id", "title")


@query("SELECT f.id FROM facts f JOIN chunks c ON c.id = f.chunk_id JOIN sources s ON s.id = c.source_id WHERE s.title IS NOT NULL AND s.title <> '' AND s.author IS NULL")
def source_restrict(spark, d):
    keep = read(spark, d, "sources").filter("title is not null and title <> '' and author is null").select(F.col("id").alias("source_id"))
    chunks = read(spark, d, "chunks").join(keep, "source_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return read(spark, d, "facts").join(chunks, "chunk_id", "left_semi").select("id")


@query("SELECT id, source_id FROM chunks WHERE extracted_v = 0 OR extracted_v IS NULL")
def unextracted_chunks(spark, d):
    return read(spark, d, "chunks").filter("extracted_v = 0 or extracted_v is null").select("id", "source_id")


@query(
    "SELECT id, canonical_name FROM entities WHERE length(canonical_name) BETWEEN 3 AND 40 AND canonical_name <> lower(canonical_name) "
    "AND NOT regexp_matches(canonical_name, '[\\n|(]') AND canonical_name NOT LIKE '\\_%' ESCAPE '\\'"
)
def proper_entities(spark, d):
    return ents.proper_names(read(spark, d, "entities")).select("id", "canonical_name")


@query(
    f"SELECT id, canonical_name FROM entities WHERE lower(trim(canonical_name)) IN ({sql_list(props.PRONOUNS)}) OR length(trim(canonical_name)) < 3 "
    "OR canonical_name = lower(canonical_name)"
)
def junk_prop_entities(spark, d):
    return props.junk_entities(read(spark, d, "entities")).select("id", "canonical_name")


@query(
    f"WITH {NAMED} SELECT n.id, n.subject_name, n.object_name, coalesce(nullif(s.title, ''), nullif(regexp_extract(s.path, '[^/]+$'), '')) AS source_info "
    "FROM named n JOIN chunks c ON c.id = n.chunk_id LEFT JOIN sources s ON s.id = c.source_id"
)
def fact_hydrate(spark, d):
    rows = fx.hydrate(*[read(spark, d, t) for t in ("facts", "entities", "chunks", "sources")])
    return rows.select("id", "subject_name", "object_name", "source_info")


DOCUMENT = "concat_ws(' ', subject_name, replace(predicate, '_', ' '), coalesce(object_name, object_text, ''), coalesce(sentence, '')) AS document"


@query(f"WITH {NAMED} SELECT id, {DOCUMENT} FROM named")
def fact_documents(spark, d):
    return fx.fact_documents(_named(spark, d))


@query(f"WITH {NAMED} SELECT id, {DOCUMENT} FROM named WHERE source IN ('llm', 'closure') AND predicate IN ({sql_list(fx.ANSWER_PREDICATES)})")
def fact_documents_minted(spark, d):
    return fx.fact_documents(_named(spark, d), minted=True)


@query(
    """WITH means AS (SELECT f.subject_id, lower(e.canonical_name) AS surface, f.object_text AS synonym FROM facts f JOIN entities e ON e.id = f.subject_id
  WHERE f.predicate IN ('means', 'mean') AND f.object_text IS NOT NULL AND NOT f.negated),
rest AS (SELECT f.* FROM facts f JOIN entities e ON e.id = f.subject_id WHERE f.predicate NOT IN ('means', 'mean') AND NOT f.negated),
hits AS (SELECT r.id, m.synonym FROM rest r JOIN means m ON m.subject_id = r.object_id
  UNION SELECT r.id, m.synonym FROM rest r JOIN means m ON m.surface = trim(lower(r.object_text))
  WHERE r.object_text <> '' AND (r.object_id IS NULL OR r.object_id NOT IN (SELECT subject_id FROM means))),
made AS (SELECT r.id AS from_id, r.chunk_id, r.subject_id, r.predicate, h.synonym AS object_text, r.confidence,
  row_number() OVER (PARTITION BY r.subject_id, r.predicate, h.synonym ORDER BY r.id) n
  FROM hits h JOIN rest r ON r.id = h.id WHERE (r.object_text IS NULL OR r.object_text <> h.synonym)
  AND NOT EXISTS (SELECT 1 FROM facts x WHERE x.subject_id = r.subject_id AND x.predicate = r.predicate AND x.object_text = h.synonym))
SELECT from_id, chunk_id, subject_id, predicate, object_text, round(CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0::DOUBLE ELSE confidence END * 0.9::DOUBLE, 3)::DOUBLE AS confidence FROM made WHERE n = 1"""
)
def closure_facts(spark, d):
    return fx.closure(read(spark, d, "facts"), read(spark, d, "entities"))


SIGNALS, BRIDGES = ["lantern", "doctor", "sailor"], ["the trunk", "the market", "the attic"]
_FOUND = " OR ".join(f"contains(lower(coalesce(object_text, '')), '{s}')" for s in SIGNALS)


@query(
    f"""WITH bad AS (SELECT DISTINCT subject_id FROM facts WHERE predicate IN ({sql_list(fx.ROLE_PREDICATES)}) AND source IN ('llm', 'svo', 'coref')
  AND NOT negated AND ({_FOUND}))
SELECT id, 'bridge' AS kind FROM facts WHERE source IN ('llm', 'coref') AND lower(coalesce(object_text, '')) IN ({sql_list(BRIDGES)}) AND subject_id IN (SELECT subject_id FROM bad)
UNION ALL SELECT id, 'closure' FROM facts WHERE source = 'closure' AND subject_id IN (SELECT subject_id FROM bad)"""
)
def prune_facts(spark, d):
    return fx.prune(read(spark, d, "facts"), SIGNALS, BRIDGES)


@query("SELECT id, CASE WHEN confidence = 1.0 THEN 'svo' WHEN confidence = 0.6 THEN 'coref' WHEN confidence = 0.7 THEN 'llm' ELSE source END AS source FROM facts")
def source_backfill(spark, d):
    c = F.col("confidence")
    return read(spark, d, "facts").select("id", F.when(c == 1.0, "svo").when(c == 0.6, "coref").when(c == 0.7, "llm").otherwise(F.col("source")).alias("source"))


@query(
    "SELECT 'sources' AS name, count(*) AS n FROM sources UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'entities', count(*) FROM entities "
    "UNION ALL SELECT 'aliases', count(*) FROM aliases UNION ALL SELECT 'facts', count(*) FROM facts"
)
def kb_stats(spark, d):
    parts = [read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("sources", "chunks", "entities", "aliases", "facts")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


DEGREE = "degree AS (SELECT e.id, e.canonical_name, e.kind, count(f.id) AS n FROM entities e LEFT JOIN facts f ON f.subject_id = e.id GROUP BY e.id, e.canonical_name, e.kind)"


@query(f"WITH {DEGREE} SELECT id, canonical_name, n FROM degree ORDER BY n DESC, id LIMIT 10")
def top_entities(spark, d):
    return ents.degree(read(spark, d, "entities"), read(spark, d, "facts")).orderBy(F.desc("n"), "id").limit(10).select("id", "canonical_name", "n")


KNOWN = f"""{DEGREE}, top AS (SELECT * FROM degree ORDER BY n DESC, id LIMIT 50),
known AS (SELECT id, canonical_name, n FROM top WHERE length(canonical_name) <= 40 AND canonical_name <> lower(canonical_name) AND position(chr(10) IN canonical_name) = 0 AND position(',' IN canonical_name) = 0 ORDER BY n DESC, id LIMIT 25)"""


@query(f"WITH {KNOWN} SELECT id, canonical_name FROM known")
def known_entities(spark, d):
    name = F.col("canonical_name")
    top = ents.degree(read(spark, d, "entities"), read(spark, d, "facts")).orderBy(F.desc("n"), "id").limit(50)
    clean = top.filter((F.length(name) <= 40) & (name != F.lower(name)) & ~name.contains("\n") & ~name.contains(","))
    return clean.orderBy(F.desc("n"), "id").limit(25).select("id", "canonical_name")


@query("SELECT DISTINCT predicate FROM facts")
def distinct_predicates(spark, d):
    return read(spark, d, "facts").select("predicate").distinct()


@query(
    f"""WITH c AS (SELECT count(*) AS n_chunks, count(DISTINCT sha256) AS n_new, count(*) - count(DISTINCT sha256) AS n_known, sum(length(text))::BIGINT AS chars FROM chunks),
s AS (SELECT count(*) AS n_sentences FROM (SELECT unnest(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\u0001', 'g'), '\u0001'), lambda s: s <> '')) FROM chunks)),
f AS (SELECT count(*) AS n_facts, count(*) FILTER (source = 'coref') AS n_coref, count(*) FILTER (object_id IS NULL AND object_text IS NULL) AS n_without_object FROM facts),
e AS (SELECT count(DISTINCT id) AS n_entities FROM entities), a AS (SELECT count(*) AS n_aliases FROM (SELECT DISTINCT entity_id, alias FROM aliases))
SELECT *, n_aliases - n_entities AS n_linked FROM c, s, f, e, a"""
)
def ingest_stats(spark, d):
    return ing.counters(read(spark, d, "chunks"), read(spark, d, "facts"), read(spark, d, "entities"), read(spark, d, "aliases"))


@query(f"SELECT id, {MENTION.format('canonical_name')} AS mention FROM entities WHERE canonical_name IS NOT NULL")
def normalize_mention(spark, d):
    return read(spark, d, "entities").filter("canonical_name is not null").select("id", mention_form(F.col("canonical_name")).alias("mention"))


@query(
    f"SELECT DISTINCT entity_id, alias FROM (SELECT id AS entity_id, {MENTION.format('canonical_name')} AS alias FROM entities UNION "
    "SELECT id, lower(canonical_name) FROM entities) WHERE alias <> ''"
)
def entity_aliases(spark, d):
    return props.entity_aliases(read(spark, d, "entities"))


MERGES = "k AS (SELECT id, min(id) OVER (PARTITION BY lower(canonical_name)) AS keep_id FROM entities WHERE canonical_name IS NOT NULL), m AS (SELECT DISTINCT id AS drop_id, keep_id FROM k WHERE id <> keep_id)"


def _merges(spark, d):
    e = read(spark, d, "entities").filter("canonical_name is not null")
    least = e.groupBy(F.lower("canonical_name").alias("k")).agg(F.min("id").alias("keep_id"))
    return e.select(F.col("id").alias("drop_id"), F.lower("canonical_name").alias("k")).join(least, "k").filter("drop_id <> keep_id").select("drop_id", "keep_id").distinct()


@query(
    f"""WITH {MERGES} SELECT f.id, coalesce(s.keep_id, f.subject_id) AS subject_id, coalesce(o.keep_id, f.object_id) AS object_id FROM facts f
LEFT JOIN m s ON s.drop_id = f.subject_id LEFT JOIN m o ON o.drop_id = f.object_id"""
)
def merge_entities(spark, d):
    return ents.merge(read(spark, d, "facts"), _merges(spark, d)).select("id", "subject_id", "object_id")


@query(f"WITH {MERGES} SELECT DISTINCT coalesce(m.keep_id, a.entity_id) AS entity_id, a.alias FROM aliases a LEFT JOIN m ON m.drop_id = a.entity_id")
def merge_aliases(spark, d):
    return ents.merge_aliases(read(spark, d, "aliases"), _merges(spark, d))


@query(
    f"""WITH {MERGES}, r AS (SELECT f.id, coalesce(s.keep_id, f.subject_id) AS s, coalesce(o.keep_id, f.object_id) AS o FROM facts f LEFT JOIN m s ON s.drop_id = f.subject_id LEFT JOIN m o ON o.drop_id = f.object_id)
SELECT keep_id, count(DISTINCT r.id) AS n_facts, (SELECT count(*) FROM vec_entities v WHERE v.entity_id NOT IN (SELECT drop_id FROM m)) AS vectors_left FROM (SELECT DISTINCT keep_id FROM m) k JOIN r ON r.s = keep_id OR r.o = keep_id GROUP BY keep_id"""
)
def merge_effects(spark, d):
    m = _merges(spark, d)
    left = ents.without_merged(read(spark, d, "vec_entities"), "entity_id", m).agg(F.count("*").alias("vectors_left"))
    return ents.touched(ents.merge(read(spark, d, "facts"), m), m).join(F.broadcast(left))  # one row


PENDING = """a AS (SELECT alias FROM aliases WHERE alias IS NOT NULL GROUP BY alias HAVING count(DISTINCT entity_id) > 1),
p AS (SELECT DISTINCT x.alias AS mention, x.entity_id FROM aliases x JOIN a ON a.alias = x.alias)"""


@query(f"WITH {PENDING} SELECT mention, string_agg(p.entity_id || ':' || coalesce(e.canonical_name, '') || ':' || coalesce(e.kind, ''), '; ' ORDER BY p.entity_id) AS candidates FROM p JOIN (SELECT DISTINCT id, canonical_name, kind FROM entities) e ON e.id = p.entity_id GROUP BY mention")
def pending_links(spark, d):
    return ents.pending_details(ents.pending(read(spark, d, "aliases")), read(spark, d, "entities"))


@query(f"WITH {PENDING}, {MERGES} SELECT DISTINCT mention FROM p WHERE mention NOT IN (SELECT mention FROM p WHERE entity_id IN (SELECT drop_id FROM m UNION SELECT keep_id FROM m))")
def pending_dismiss(spark, d):
    """The ambiguous mentions that a merge leaves open."""
    m = _merges(spark, d)
    return ents.dismiss(ents.pending(read(spark, d, "aliases")), m.select("drop_id").union(m.select("keep_id"))).select("mention")


@query(
    f"SELECT DISTINCT prop_id, entity_id, role FROM (SELECT id AS prop_id, subject_id AS entity_id, 'agent' AS role FROM facts WHERE lower(predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)}) "
    f"UNION ALL SELECT id, object_id, 'theme' FROM facts WHERE lower(predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)})) WHERE entity_id IS NOT NULL"
)
def proposition_roles(spark, d):
    return props.roles(props.from_facts(read(spark, d, "facts")))


@query(
    f"SELECT f.id AS prop_id, e.canonical_name AS agent FROM facts f JOIN entities e ON e.id = f.subject_id WHERE lower(f.predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)})"
)
def prop_agent(spark, d):
    r = props.roles(props.from_facts(read(spark, d, "facts"))).filter("role = 'agent'")
    e = read(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("agent"))
    return r.join(e, "entity_id").select("prop_id", "agent")


@query(
    f"""WITH p AS (SELECT id, subject_id, object_id, confidence FROM facts WHERE lower(predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)})),
b AS (SELECT id AS prop_id, subject_id AS entity_id, 'agent' AS role FROM p UNION SELECT id, object_id, 'theme' FROM p WHERE object_id IS NOT NULL),
pairs AS (SELECT DISTINCT subject_id, object_id FROM facts WHERE object_id IS NOT NULL AND subject_id <> object_id AND predicate = 'introduce'),
w AS (SELECT subject_id || '-' || object_id AS group_id, subject_id AS entity_id, true AS first FROM pairs UNION ALL SELECT subject_id || '-' || object_id, object_id, false FROM pairs),
h AS (SELECT w.group_id, b.prop_id, max(CASE WHEN w.first AND b.role = 'agent' THEN 1 ELSE 0 END)::INT AS is_agent FROM b JOIN w ON w.entity_id = b.entity_id
GROUP BY w.group_id, b.prop_id HAVING count(DISTINCT b.entity_id) >= 2)
SELECT group_id, prop_id, is_agent, row_number() OVER (PARTITION BY group_id ORDER BY is_agent DESC, confidence DESC NULLS LAST, prop_id)::INT AS rank FROM h JOIN p ON p.id = h.prop_id"""
)
def props_all_entities(spark, d):
    f = read(spark, d, "facts")
    pairs = f.filter("object_id is not null and subject_id <> object_id and predicate = 'introduce'").select("subject_id", "object_id").distinct()
    gid = F.concat_ws("-", "subject_id", "object_id").alias("group_id")
    wanted = pairs.select(gid, F.col("subject_id").alias("entity_id"), F.lit(True).alias("first")).unionByName(
        pairs.select(gid, F.col("object_id").alias("entity_id"), F.lit(False).alias("first"))
    )
    p = props.from_facts(f)
    return props.holding_all(props.roles(p), p, wanted).select("group_id", "prop_id", F.col("is_agent").cast("int").alias("is_agent"), "rank")


@query(
    f"""WITH good AS (SELECT id, canonical_name FROM entities WHERE NOT (lower(trim(canonical_name)) IN ({sql_list(props.PRONOUNS)}) OR length(trim(canonical_name)) < 3 OR canonical_name = lower(canonical_name))),
agents AS (SELECT DISTINCT g.id, lower(g.canonical_name) AS k FROM good g JOIN facts f ON f.subject_id = g.id WHERE lower(f.predicate) IN ({sql_list(props.PROPOSITION_TAXONOMY)}))
SELECT DISTINCT p.id AS prop_entity_id, a.alias FROM agents p JOIN entities e ON lower(e.canonical_name) = p.k JOIN aliases a ON a.entity_id = e.id"""
)
def prop_alias_sync(spark, d):
    e = read(spark, d, "entities")
    agents = props.from_facts(read(spark, d, "facts")).select(F.col("agent").alias("id")).distinct()
    good = e.join(props.junk_entities(e).select("id"), "id", "left_anti").join(agents, "id", "left_semi")
    keyed = good.select(F.col("id").alias("prop_entity_id"), F.lower("canonical_name").alias("k"))
    same = e.select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("k"))
    return keyed.join(same, "k").join(read(spark, d, "aliases"), "entity_id").select("prop_entity_id", "alias").distinct()


@query(
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c.extracted_v IS NULL THEN 'never' WHEN c.extracted_v = 0 THEN 'backlog' ELSE 'done' END AS kind FROM chunks c) GROUP BY kind"
)
def extraction_state(spark, d):
    v = F.col("extracted_v")
    return read(spark, d, "chunks").groupBy(F.when(v.isNull(), "never").when(v == 0, "backlog").otherwise("done").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\u0001', 'g'), '\u0001'), lambda s: s <> '') AS s FROM chunks".replace("SELECT id,", "SELECT id AS chunk_id, unnest(").replace(" AS s FROM", ") AS sentence FROM"))
def split_sentences(spark, d):
    c = read(spark, d, "chunks")
    return c.select(F.col("id").alias("chunk_id"), F.explode(ing.plain_sentences(F.col("text"))).alias("sentence"))


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1\u0001', 'g'), '\u0001'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL),
fold AS (SELECT doc_id, a, 1 AS i, 0::BIGINT AS n, CAST([] AS VARCHAR[]) AS cur, 0::BIGINT AS chars, CAST(NULL AS VARCHAR) AS closed FROM s
  UNION ALL
  SELECT doc_id, a, i + 1,
    CASE WHEN chars + length(a[i]) > 2048 AND len(cur) > 0 THEN n + 1 ELSE n END,
    CASE WHEN chars + length(a[i]) > 2048 AND len(cur) > 0 THEN list_append(cur[len(cur):len(cur)], a[i]) ELSE list_append(cur, a[i]) END,
    CASE WHEN chars + length(a[i]) > 2048 AND len(cur) > 0 THEN length(cur[len(cur)]) + length(a[i]) ELSE chars + length(a[i]) END,
    CASE WHEN chars + length(a[i]) > 2048 AND len(cur) > 0 THEN array_to_string(list_transform(cur, lambda x: trim(x)), ' ') END
  FROM fold WHERE i <= len(a))
SELECT doc_id, (n - 1)::INT AS ordinal, closed AS text FROM fold WHERE closed IS NOT NULL
UNION ALL SELECT doc_id, n::INT, array_to_string(list_transform(cur, lambda x: trim(x)), ' ') FROM fold WHERE i = len(a) + 1 AND len(cur) > 0"""
)
def make_chunks(spark, d):
    c = read(spark, d, "documents").filter("text is not null")
    chunks = ing.make_chunks(ing.plain_sentences(F.col("text")))
    return c.select("doc_id", F.posexplode(chunks).alias("ordinal", "text"))


@query(
    "SELECT id, chunk_id, last_value(CASE WHEN source <> 'coref' THEN subject_id END IGNORE NULLS) OVER (PARTITION BY chunk_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS subject_id FROM facts"
)
def coref_last_subject(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "facts").select("id", "chunk_id", F.last(F.when(F.col("source") != "coref", F.col("subject_id")), ignorenulls=True).over(w).alias("subject_id"))


SYNONYMS = [("located_at", "reside_at"), ("resides_at", "live"), ("possess", "own"), ("work_as", "profession"), ("call", "named_after"), ("means", "mean"), ("employ", "work_as"), ("kept", "work_as"), ("inspector", "found"), ("why", "cause_of"), ("passengers", "role"), ("far", "located_at"), ("happened", "possess")]
SYNONYM_SQL = "syn(predicate, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + "), both_syn AS (SELECT predicate, synonym FROM syn UNION SELECT synonym, predicate FROM syn)"


def synonyms(spark):
    return spark.createDataFrame(SYNONYMS, "predicate string, synonym string")


@query(f"WITH {SYNONYM_SQL} SELECT predicate, synonym FROM both_syn")
def synonyms_bidirectional(spark, d):
    return fx.both_directions(synonyms(spark))


@query(
    """SELECT q_id, id, round(d, 6) AS distance, rank::INT AS rank FROM (SELECT q.vec_id AS q_id, v.vec_id AS id,
  list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
)
def knn_batch(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.filter("id % 50 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("qvec"))
    return vec.knn(q, e, 5).select("q_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query(
    """SELECT id, round(d, 6) AS distance FROM (SELECT v.vec_id AS id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d FROM embeddings v,
  (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY d, id LIMIT 10)"""
)
def knn_l2(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.orderBy("id").limit(1).select(F.col("vec").alias("qvec"))
    near = e.join(F.broadcast(q)).select("id", vec.l2(F.col("vec"), F.col("qvec")).alias("x"))  # one query row
    return near.orderBy("x", "id").limit(10).select("id", F.round("x", 6).alias("distance"))


@query(
    """WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: 0.0) AS z FROM embeddings GROUP BY label),
m AS (SELECT label, list(v ORDER BY i) AS vec FROM (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT a.label AS a, b.label AS b, round(1 - pow(list_distance(a.vec, b.vec), 2) / 2, 6) AS similarity FROM m a JOIN m b ON a.label < b.label WHERE list_distance(a.vec, b.vec) < sqrt(2 * (1 - 0.5))"""
)
def synonym_pairs(spark, d):
    e = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v")).groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vec")
    )
    a, b = m.select(F.col("label").alias("a"), F.col("vec").alias("va")), m.select(F.col("label").alias("b"), F.col("vec").alias("vb"))
    j = a.join(b, F.col("a") < F.col("b")).withColumn("d", vec.l2(F.col("va"), F.col("vb")))
    return j.filter(F.col("d") < vec.cosine_threshold(0.5)).select("a", "b", F.round(1 - F.col("d") * F.col("d") / 2, 6).alias("similarity"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(list_zip(m, e), lambda p: p[1] * p[2])) / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS along FROM (SELECT vec_id, e, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM
 (SELECT a.vec_id, a.embedding::DOUBLE[] AS e, list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE + p[2]::DOUBLE) / 2) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1))"""
)
def vector_blend(spark, d):
    """The blend of each vector with the next one, measured along the first: every number of the blend counts."""
    e = read(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = e.join(b, "vec_id").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), vec.blend(F.col("embedding"), F.col("other")).alias("m"))
    along = F.aggregate(F.zip_with("m", "e", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return both.select("vec_id", F.round(along, 6).alias("along"))


@query(
    "SELECT chunk_id, len(embedding)::INT AS dim FROM (SELECT * FROM vec_chunks v WHERE chunk_id NOT IN (SELECT entity_id FROM vec_entities) UNION ALL SELECT entity_id, embedding FROM vec_entities) WHERE embedding IS NOT NULL"
)
def vec_upsert(spark, d):
    new = read(spark, d, "vec_entities").select(F.col("entity_id").alias("chunk_id"), "embedding")
    return vec.upsert(read(spark, d, "vec_chunks"), new, "chunk_id").filter("embedding is not null").select("chunk_id", F.size("embedding").alias("dim"))


@query()
def embed_text(spark, d):
    return vec.embed(read(spark, d, "sources").filter("title is not null"), "id", "title")


@query("SELECT corpus, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'main' AS corpus, text FROM chunks UNION ALL SELECT 'pack_0', text FROM documents WHERE text IS NOT NULL) GROUP BY corpus")
def pack_union(spark, d):
    from quern.sources.packs import attach

    main = read(spark, d, "chunks").select("id", "text")
    other = read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text")
    return attach([("main", main), ("pack_0", other)]).groupBy("corpus").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query()
def resolve_entities(spark, d):
    m = read(spark, d, "entities").select(mention_form(F.col("canonical_name")).alias("mention"), F.col("id").alias("ordinal"))
    return ents.resolve_mentions(m)
