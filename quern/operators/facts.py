"""Subject-predicate-object facts: filters, hydration, documents, lookup, closure and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import source_info

# Predicates that model output may bear.
FACT_TAXONOMY = (
    "profession occupation role identity alias_of title means located_at resides_at relationship_to affiliation leader_of "
    "introduce murder cause_of named_after work_as reside_at mean call be possess sign employ found"
).split()
# Predicates that answer questions by themselves.
ANSWER_PREDICATES = (
    "profession occupation role identity alias_of title means mean located_at resides_at reside_at relationship_to affiliation "
    "leader_of introduce murder cause_of named_after work_as"
).split()
# Sources admitted by each retrieval mode.
SOURCE_MODES = {"all": None, "minted": ["llm"], "minted+coref": ["llm", "coref"]}
ROLE_PREDICATES = ["title", "profession", "role", "occupation", "work_as"]


def with_names(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with subject_name (inner) and object_name (left)."""
    subjects = entities.select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("subject_name"))
    objects = entities.select(F.col("id").alias("object_id"), F.col("canonical_name").alias("object_name"))
    return facts.join(subjects, "subject_id").join(objects, "object_id", "left")


def usable(named: DataFrame) -> DataFrame:
    """Facts with an object and a subject name that can be shown: at most 60 characters, no comma, no line break."""
    name = F.col("subject_name")
    return named.filter("object_text is not null or object_id is not null").filter(
        (F.length(name) <= 60) & ~name.contains(",") & ~name.contains("\n")
    )


def proper_subjects(named: DataFrame) -> DataFrame:
    """Facts whose subject's name has a capital."""
    return named.filter(F.col("subject_name") != F.lower("subject_name"))


def by_source(facts: DataFrame, mode: str) -> DataFrame:
    allowed = SOURCE_MODES[mode]
    return facts if allowed is None else facts.filter(F.col("source").isin(allowed))


def hydrate(facts: DataFrame, entities: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with names and the source that a citation shows."""
    places = chunks.select(F.col("id").alias("chunk_id"), "source_id").join(
        sources.select(F.col("id").alias("source_id"), "title", "path"), "source_id", "left"
    )
    return (
        with_names(facts, entities)
        .join(places, "chunk_id")
        .withColumn("source_info", source_info(F.col("title"), F.col("path")))
    )


def fact_documents(named: DataFrame, minted: bool = False) -> DataFrame:
    """id, document: what full-text search and embeddings index of a fact."""
    rows = named
    if minted:
        rows = rows.filter(F.col("source").isin("llm", "closure") & F.col("predicate").isin(ANSWER_PREDICATES))
    return rows.select(
        "id",
        F.concat_ws(
            " ", "subject_name", F.regexp_replace("predicate", "_", " "),
            F.coalesce("object_name", "object_text", F.lit("")), F.coalesce("sentence", F.lit("")),
        ).alias("document"),
    )


def lookup(wanted: DataFrame, facts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """q_id, fact id, score: facts of the mentioned subjects with the wanted predicate (1.0) or a synonym of it (0.8).

    wanted: q_id, entity_id, verb.  synonyms: predicate, synonym, in both directions.
    """
    exact = wanted.select("q_id", "entity_id", F.col("verb").alias("predicate"), F.lit(1.0).alias("score"))
    near = wanted.join(synonyms.withColumnRenamed("predicate", "verb"), "verb").select(
        "q_id", "entity_id", F.col("synonym").alias("predicate"), F.lit(0.8).alias("score")
    )
    asked = exact.unionByName(near).groupBy("q_id", "entity_id", "predicate").agg(F.max("score").alias("score"))
    return asked.join(facts.withColumnRenamed("subject_id", "entity_id"), ["entity_id", "predicate"]).groupBy("q_id", "id").agg(
        F.max("score").alias("score")
    )


def both_directions(synonyms: DataFrame) -> DataFrame:
    return synonyms.select("predicate", "synonym").union(synonyms.select("synonym", "predicate")).distinct()


def dedup_facts(facts: DataFrame) -> DataFrame:
    """The first fact of each (chunk, subject, predicate, object text, qualifiers); nulls are equal to nulls."""
    order = Window.partitionBy("chunk_id", "subject_id", "predicate", "object_text", "qualifiers").orderBy("id")
    return facts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def relevance_gate(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """Hits (q_id, id, subject_id, object_id) whose subject or object was mentioned (q_id, entity_id)."""
    m = mentions.select("q_id", "entity_id").distinct()
    subject = hits.join(m.withColumnRenamed("entity_id", "subject_id"), ["q_id", "subject_id"], "left_semi")
    object_ = hits.join(m.withColumnRenamed("entity_id", "object_id"), ["q_id", "object_id"], "left_semi")
    return subject.select("q_id", "id").union(object_.select("q_id", "id")).distinct()


def closure(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """New facts X-predicate-Z from X-predicate-Y and Y-means-Z, one hop.

    An object entity with meanings takes precedence over the surface text; negated facts and
    facts that exist already are left out; of equal results the one from the least fact id stays.
    """
    names = entities.select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("subject_name"))
    named = facts.join(names, "subject_id").filter("not negated")
    means = named.filter("predicate in ('means', 'mean') and object_text is not null")
    by_id = means.select(F.col("subject_id").alias("object_id"), F.col("object_text").alias("synonym"))
    by_name = means.select(F.lower("subject_name").alias("surface"), F.col("object_text").alias("synonym"))
    rest = named.filter("predicate not in ('means', 'mean')")
    first = rest.join(by_id, "object_id").select("id", "synonym")
    second = (
        rest.filter("object_text is not null and object_text <> ''")
        .join(by_id.select("object_id").distinct(), "object_id", "left_anti")
        .withColumn("surface", F.trim(F.lower("object_text")))
        .join(by_name, "surface")
        .select("id", "synonym")
    )
    made = rest.join(first.unionByName(second).distinct(), "id").filter("object_text is null or synonym <> object_text")
    fresh = made.join(
        facts.select("subject_id", "predicate", F.col("object_text").alias("synonym")).distinct(), ["subject_id", "predicate", "synonym"], "left_anti"
    )
    order = Window.partitionBy("subject_id", "predicate", "synonym").orderBy("id")
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0.0, F.lit(1.0)).otherwise(F.col("confidence"))
    return (
        fresh.withColumn("n", F.row_number().over(order))
        .filter("n = 1")
        .select(
            F.col("id").alias("from_id"), "chunk_id", "subject_id", "predicate", F.col("synonym").alias("object_text"),
            F.round(conf * 0.9, 3).alias("confidence"),
        )
    )


def prune(facts: DataFrame, signals: list[str], bridge_terms: list[str]) -> DataFrame:
    """id, kind (bridge or closure) of facts to delete: subjects whose roles hold a signal lose their
    bridge-term facts, and all their closure facts."""
    text = F.lower(F.coalesce("object_text", F.lit("")))
    roles = facts.filter(F.col("predicate").isin(ROLE_PREDICATES) & F.col("source").isin("llm", "svo", "coref") & ~F.col("negated"))
    found = F.lit(False)
    for s in signals:
        found = found | text.contains(s)
    subjects = roles.filter(found).select("subject_id").distinct()
    bridge = facts.filter(F.col("source").isin("llm", "coref") & text.isin(bridge_terms)).withColumn("kind", F.lit("bridge"))
    derived = facts.filter("source = 'closure'").withColumn("kind", F.lit("closure"))
    return bridge.unionByName(derived).join(subjects, "subject_id", "left_semi").select("id", "kind")
