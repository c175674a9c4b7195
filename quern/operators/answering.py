"""Retrieval for a batch of questions: chunks by vectors and full text, facts by lookup and full text, propositions, packed contexts.

Every step takes and gives rows keyed by q_id, so one job answers all questions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import PROPOSITION_STOPWORDS, query_terms, source_info
from quern.operators import facts as fx
from quern.operators import propositions as props
from quern.operators import retrieval as rt
from quern.operators.fulltext import bm25
from quern.operators.vectors import embed, hash_embedding, knn
from quern.runtime import durable


@dataclass(frozen=True)
class Settings:
    """What a retrieval takes in; the defaults are those of the configuration."""

    vec_top_k: int = 12
    fts_top_k: int = 12
    vec_rrf_k: int = 30
    rrf_k: int = 60
    context_token_budget: int = 1800
    fact_fts_top_k: int = 10
    max_facts_in_context: int = 0
    fact_sources: str = "all"
    fact_vec_mode: str = "off"
    fact_vec_top_k: int = 10
    fact_expand_names: int = 2
    rerank_mode: str = "off"
    rerank_pool: int = 24


def question_terms(questions: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """q_id, term, weight of a full-text query; a word said twice weighs twice."""
    words = questions.select("q_id", F.explode(query_terms(F.col("question"), stop)).alias("term"))
    return words.groupBy("q_id", "term").agg(F.count("*").alias("weight"))


def question_vectors(questions: DataFrame, embedder=hash_embedding) -> DataFrame:
    """q_id, qvec: every question's vector, of length one."""
    return embed(questions, "q_id", "question", embedder).select(F.col("id").alias("q_id"), F.col("embedding").cast("array<double>").alias("qvec"))


def vector_hits(qvecs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """q_id, key, rank, part: the k nearest of the usable stored vectors; part = greatest(0, 1 - distance)."""
    return knn(qvecs, vectors, k).select("q_id", F.col("id").alias("key"), "rank", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("part"))


def text_hits(terms: DataFrame, documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """q_id, key, rank, part: the k best by BM25; part falls from 1 by the place among the question's hits."""
    hits = bm25(terms, documents, id_col, text_col, k)
    n = F.count("*").over(Window.partitionBy("q_id"))
    return hits.select("q_id", F.col("doc_id").alias("key"), "rank", F.greatest(F.lit(0.0), 1 - (F.col("rank") - 1) / n).alias("part"))


def fuse(vector: DataFrame, text: DataFrame, settings: Settings) -> DataFrame:
    """q_id, key, score, rank: reciprocal rank fusion of both lists; with the blend mode ordered by the mean of both parts instead.

    Ties keep the order in which keys are first met, vectors first.
    """
    lists = vector.select("q_id", "key", F.lit(0).alias("list_no"), "rank", F.lit(settings.vec_rrf_k).alias("k"), F.col("part").alias("v"), F.lit(0.0).alias("t")).unionByName(
        text.select("q_id", "key", F.lit(1).alias("list_no"), "rank", F.lit(settings.rrf_k).alias("k"), F.lit(0.0).alias("v"), F.col("part").alias("t"))
    )
    fused = lists.groupBy("q_id", "key").agg(
        F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 8).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"),
        F.round(0.5 * F.max("v") + 0.5 * F.max("t"), 6).alias("blended"),
    )
    first = [F.desc("blended")] if settings.rerank_mode == "blend" else []
    order = Window.partitionBy("q_id").orderBy(*first, F.desc("score"), "first", "key")
    return fused.select("q_id", "key", "score", "blended", F.row_number().over(order).alias("rank"))


def chunk_ranking(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, settings: Settings, embedder=hash_embedding, extra_terms: DataFrame | None = None) -> DataFrame:
    """q_id, key (chunk), score, blended, rank of all questions; extra_terms (q_id, term, weight) widen the full-text query."""
    pool = settings.rerank_pool
    k_vec, k_text = (settings.vec_top_k, settings.fts_top_k) if settings.rerank_mode == "off" else (pool, pool)
    terms = question_terms(questions)
    if extra_terms is not None:
        terms = terms.unionByName(extra_terms).groupBy("q_id", "term").agg(F.sum("weight").alias("weight"))
    return fuse(vector_hits(question_vectors(questions, embedder), vectors, k_vec), text_hits(terms, chunks, "id", "text", k_text), settings)


def chunk_hits(ranking: DataFrame, chunks: DataFrame, sources: DataFrame, token_budget: int) -> DataFrame:
    """q_id, chunk_id, rank, tag, score, text, source_info: ranked chunks up to the first whose text would pass the budget."""
    # only lengths meet all ranked chunks; texts are joined to those that stay
    sizes = chunks.select(F.col("id").alias("key"), F.length("text").alias("chars"), "source_id")
    places = sources.select(F.col("id").alias("source_id"), "title", "path")
    rows = rt.pack(ranking.join(sizes, "key"), "chars", token_budget * 4, ["rank"]).join(chunks.select(F.col("id").alias("key"), "text"), "key")
    return rows.join(places, "source_id", "left").select(
        "q_id", F.col("key").alias("chunk_id"), "rank", F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("]")).alias("tag"), "score", "text",
        source_info(F.col("title"), F.col("path")).alias("source_info"),
    )


def fact_hits(
    questions: DataFrame, facts: DataFrame, entities: DataFrame, aliases: DataFrame, synonyms: DataFrame, settings: Settings, cap: int | None = None
) -> DataFrame:
    """q_id, id, score, rank, tag: facts for the answers.

    Looked up by the question's verb and mentions (1.0, by a synonym 0.8), then found by full text (0.7 less 0.01 a
    place, counted before unfit ones are dropped).  Where the mode admits only some sources, a fact must bear a mentioned entity.
    """
    # small tables (a few rows a question) that several steps need are written once
    mentions = durable(rt.mention_scan(questions, aliases))
    allowed = fx.with_names(fx.by_source(facts, settings.fact_sources), entities)
    fit = fx.usable(allowed)
    wanted = rt.parse_question(questions).filter("verb is not null").join(mentions, "q_id").select("q_id", "entity_id", "verb")
    exact = durable(fx.lookup(wanted, fit, synonyms))
    routed = settings.fact_sources != "all"
    documents = fx.fact_documents(fx.with_names(facts, entities), minted=routed)
    found = bm25(question_terms(questions), documents, "id", "document", settings.fact_fts_top_k).select("q_id", F.col("doc_id").alias("id"), F.col("rank").alias("place"))
    new = found.join(exact.select("q_id", "id"), ["q_id", "id"], "left_anti")
    new = new.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("place")) - 1)
    shown = new.join(fx.proper_subjects(fit).select("id"), "id", "left_semi")
    both = exact.select("q_id", "id", "score", F.lit(0).alias("list_no"), F.lit(0).alias("place")).unionByName(
        shown.select("q_id", "id", (0.7 - 0.01 * F.col("place")).alias("score"), F.lit(1).alias("list_no"), F.col("place"))
    )
    if routed:
        both = durable(both)
        ends = both.join(facts.select("id", "subject_id", "object_id"), "id")
        both = both.join(fx.relevance_gate(ends, mentions), ["q_id", "id"], "left_semi")
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "list_no", "place", "id")
    ranked = both.select("q_id", "id", F.round("score", 6).alias("score"), F.row_number().over(order).alias("rank"))
    most = settings.max_facts_in_context if cap is None else cap
    return ranked.filter(F.col("rank") <= most).withColumn("tag", F.concat(F.lit("[F"), F.col("rank").cast("string"), F.lit("]")))


def shown_qualifiers(column: Column) -> Column:
    """ (name: value, ...) of a JSON object of qualifiers, or nothing."""
    entries = F.map_entries(F.from_json(column, T.MapType(T.StringType(), T.StringType())))
    listed = F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, F.concat(F.lit(" ("), listed, F.lit(")"))).otherwise(F.lit(""))


def fact_lines(hits: DataFrame, facts: DataFrame, entities: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """q_id, rank, line: the facts as they stand in a context."""
    rows = hits.join(fx.hydrate(facts, entities, chunks, sources), "id")
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    object_ = F.coalesce(F.nullif("object_name", F.lit("")), F.nullif("object_text", F.lit("")))
    line = F.concat(
        "tag", F.lit(" "), "subject_name", F.lit(" — "), "predicate", F.when(F.col("negated"), F.lit(" [NOT]")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" — "), object_), F.lit("")), shown_qualifiers(F.col("qualifiers")), F.lit('\n     "'), shown("sentence"), F.lit('"'),
        F.coalesce(F.concat(F.lit(" ("), "source_info", F.lit(")")), F.lit("")),
    )
    return rows.select("q_id", "rank", line.alias("line"))


def context(chunks_: DataFrame, facts_: DataFrame, token_budget: int) -> DataFrame:
    """q_id, n_chunks, n_facts, context: chunks first, then facts, each up to its first line that would pass the budget.

    chunks_: as chunk_hits gives them; facts_: q_id, rank, line.
    """
    quoted = F.concat("tag", F.lit(' "'), "text", F.lit('"'), F.coalesce(F.concat(F.lit(" ("), "source_info", F.lit(")")), F.lit("")))
    first = rt.pack(chunks_.select("q_id", "rank", quoted.alias("line")).withColumn("chars", F.length("line")), "chars", token_budget * 4, ["rank"])
    # one window over both, as a second use of the chunks would search them again
    lines = first.select("q_id", F.lit(0).alias("part"), "rank", "line", "chars").unionByName(facts_.select("q_id", F.lit(1).alias("part"), "rank", "line", F.length("line").alias("chars")))
    rows = rt.pack(lines, "chars", token_budget * 4, ["part", "rank"])
    g = rows.groupBy("q_id").agg(
        F.count(F.when(F.col("part") == 0, 1)).alias("n_chunks"), F.count(F.when(F.col("part") == 1, 1)).alias("n_facts"),
        F.sort_array(F.collect_list(F.struct("part", "rank", "line"))).alias("l"),
    )
    return g.select("q_id", "n_chunks", "n_facts", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))


def expansion_terms(vector_facts: DataFrame, facts: DataFrame, entities: DataFrame, names: int) -> DataFrame:
    """q_id, term, weight: words of the subject and object names of each question's first vector hits (q_id, id, rank)."""
    top = vector_facts.filter(F.col("rank") <= names).select("q_id", "id")
    named = fx.with_names(facts, entities).select("id", "subject_name", "object_name")
    n = clean_names(top.join(named, "id").select("q_id", F.explode(F.array("subject_name", "object_name")).alias("name")).distinct())
    return n.select("q_id", F.explode(query_terms(F.col("name"))).alias("term")).groupBy("q_id", "term").agg(F.count("*").alias("weight"))


def clean_names(rows: DataFrame) -> DataFrame:
    """Rows whose name can stand in a query: it has a capital, at most 60 characters, no comma and no line break."""
    name = F.col("name")
    return rows.filter(name.isNotNull() & (name != F.lower(name)) & (F.length(name) <= 60) & ~name.contains(",") & ~name.contains("\n"))


def wanted_predicates(questions: DataFrame) -> DataFrame:
    """q_id, predicate: what a proposition that answers the question may state.

    The verb and what it stands for; the nouns that name a relation, some of them only where there is no verb.
    """
    parsed = rt.parse_question(questions).filter("verb is not null").select("q_id", "verb")
    verbs = _pairs(questions, props.VERB_PREDICATES, "verb")
    nouns = _pairs(questions, props.NOUN_PREDICATES, "word")
    words = F.filter(F.split(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}_\s]", " "), r"[ \t\n\r]+"), lambda w: w != "")
    said = questions.select("q_id", F.explode(F.array_distinct(words)).alias("word")).join(F.broadcast(nouns), "word")  # a fixed table
    said = said.join(parsed, "q_id", "left").filter(~(F.col("word").isin(props.CONDITIONAL_NOUNS) & F.col("verb").isNotNull()))
    return (
        parsed.select("q_id", F.col("verb").alias("predicate"))
        .unionByName(parsed.join(F.broadcast(verbs), "verb").select("q_id", "predicate"))  # a fixed table
        .unionByName(said.select("q_id", "predicate")).distinct()
    )


def _pairs(like: DataFrame, table: dict[str, str], name: str) -> DataFrame:
    rows = [(k, p) for k, v in table.items() for p in v.split()]
    return like.sparkSession.createDataFrame(rows, f"{name} string, predicate string")


def proposition_hits(
    questions: DataFrame, propositions: DataFrame, aliases: DataFrame, k: int = 3, pool: int = 30, least: float = 0.05, vectors: DataFrame | None = None, embedder=hash_embedding
) -> DataFrame:
    """q_id, prop_id, score, rank: the k best propositions that state a wanted predicate.

    Candidates bear a mentioned entity, or are among the `pool` best by full text or by vectors (id, vec) where given.  Their
    score is that of the vectors, else that of full text, with 0.25 for the predicate and 0.10 for an entity.
    """
    wanted = durable(wanted_predicates(questions))
    asked = questions.join(wanted.select("q_id").distinct(), "q_id", "left_semi")
    said = asked.select("q_id", F.explode(query_terms(F.col("question"), PROPOSITION_STOPWORDS)).alias("term"))
    implied = wanted.select("q_id", F.explode(query_terms(F.regexp_replace("predicate", "_", " "), PROPOSITION_STOPWORDS)).alias("term"))
    terms = durable(said.unionByName(implied).distinct().withColumn("weight", F.lit(1)))
    text = text_hits(terms, propositions, "prop_id", "statement", pool).select("q_id", F.col("key").alias("prop_id"), F.col("part").alias("t"))
    bearing = rt.plain_mentions(asked, aliases).join(props.roles(propositions), "entity_id").select("q_id", "prop_id").distinct().withColumn("e", F.lit(0.1))
    both = text.join(bearing, ["q_id", "prop_id"], "full")
    if vectors is not None:
        near = knn(question_vectors(asked, embedder), vectors, pool)
        near = near.select("q_id", F.col("id").alias("prop_id"), F.greatest(F.lit(0.0), 1 - F.col("distance") / 2).alias("v"))
        both = both.join(near, ["q_id", "prop_id"], "full")
    base = F.coalesce("v" if vectors is not None else "t", F.lit(0.0))
    stated = both.join(propositions.select("prop_id", "predicate"), "prop_id").join(wanted, ["q_id", "predicate"], "left_semi")
    scored = stated.withColumn("score", F.round(base + 0.25 + F.coalesce("e", F.lit(0.0)), 6))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "prop_id")
    return scored.select("q_id", "prop_id", "score", F.row_number().over(order).alias("rank")).filter((F.col("rank") <= k) & (F.col("score") >= least))


def retrieve(tables: dict[str, DataFrame], questions: DataFrame, settings: Settings = Settings(), embedder=hash_embedding) -> dict[str, DataFrame]:
    """The whole retrieval: chunks, facts and context of every question, and the stages they come from.

    tables: chunks, sources, facts, entities, aliases, synonyms, vec_chunks (id, vec) and, for the vector modes of facts, vec_facts (id, vec).
    """
    facts, entities = tables["facts"], tables["entities"]
    hits = fact_hits(questions, facts, entities, tables["aliases"], tables["synonyms"], settings)
    extra = None
    stages: dict[str, DataFrame] = {}
    if settings.fact_vec_mode != "off":
        near = knn(question_vectors(questions, embedder), tables["vec_facts"], settings.fact_vec_top_k)
        near = near.join(hits.select("q_id", "id"), ["q_id", "id"], "left_anti")
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id")))
        stages["vector_facts"] = near
        if settings.fact_vec_mode == "expand":
            extra = expansion_terms(near, facts, entities, settings.fact_expand_names)
        else:
            hits = surfaced(hits, near, facts, entities, settings)
    ranking = chunk_ranking(questions, tables["chunks"], tables["vec_chunks"], settings, embedder, extra)
    shown = chunk_hits(ranking, tables["chunks"], tables["sources"], settings.context_token_budget)
    lines = fact_lines(hits, facts, entities, tables["chunks"], tables["sources"])
    return {**stages, "facts": hits, "ranking": ranking, "chunks": shown, "context": context(shown, lines, settings.context_token_budget)}


def surfaced(hits: DataFrame, near: DataFrame, facts: DataFrame, entities: DataFrame, settings: Settings) -> DataFrame:
    """Facts with those that only vectors found, scored greatest(0, 0.6 - 0.05 distance), ranked and capped again."""
    fit = fx.proper_subjects(fx.usable(fx.with_names(facts, entities))).select("id")
    more = near.join(fit, "id", "left_semi").select("q_id", "id", F.round(F.greatest(F.lit(0.0), 0.6 - 0.05 * F.col("distance")), 6).alias("score"), (F.col("rank") + 1_000_000).alias("rank"))
    both = hits.select("q_id", "id", "score", "rank").unionByName(more)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "rank")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.max_facts_in_context)
    return ranked.withColumn("tag", F.concat(F.lit("[F"), F.col("rank").cast("string"), F.lit("]")))


def explain(stages: dict[str, DataFrame]) -> DataFrame:
    """q_id, report: what each stage of a retrieval found for each question, one line a stage."""
    parts = []
    for n, name in enumerate(sorted(stages)):
        df = stages[name]
        if "rank" not in df.columns:
            continue
        key = next(c for c in ("chunk_id", "key", "id") if c in df.columns)
        line = F.concat(F.lit(f"{name}: "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("x")))), lambda s: s["x"].cast("string")), ", "))
        parts.append(df.groupBy("q_id").agg(line.alias("line")).withColumn("n", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("q_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("report"))
