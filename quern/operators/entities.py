"""Entities: degree, merging, and exact distributed resolution of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import durable


def degree(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """id, canonical_name, kind, n: how many facts have the entity as subject, 0 included."""
    n = facts.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    return entities.join(n, "id", "left").select("id", "canonical_name", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def proper_names(entities: DataFrame) -> DataFrame:
    """Entities whose name can stand in a prompt: 3 to 40 characters, a capital, no line break, bar or bracket."""
    name = F.col("canonical_name")
    return entities.filter(
        F.length(name).between(3, 40) & (name != F.lower(name)) & ~name.rlike(r"[\n|(]") & ~name.startswith("_")
    )


def merge(facts: DataFrame, merges: DataFrame) -> DataFrame:
    """Facts with merged ids rewritten (merges: drop_id, keep_id)."""
    s = merges.select(F.col("drop_id").alias("subject_id"), F.col("keep_id").alias("keep_s"))
    o = merges.select(F.col("drop_id").alias("object_id"), F.col("keep_id").alias("keep_o"))
    return (
        facts.join(s, "subject_id", "left").join(o, "object_id", "left")
        .withColumn("subject_id", F.coalesce("keep_s", "subject_id")).withColumn("object_id", F.coalesce("keep_o", "object_id"))
        .drop("keep_s", "keep_o")
    )


def merge_aliases(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases moved to the entities that stay, repeated ones once."""
    a = aliases.join(merges.select(F.col("drop_id").alias("entity_id"), "keep_id"), "entity_id", "left")
    return a.select(F.coalesce("keep_id", "entity_id").alias("entity_id"), "alias").distinct()


def without_merged(rows: DataFrame, key: str, merges: DataFrame) -> DataFrame:
    """Rows (vectors, entities) of the entities that stay."""
    return rows.join(merges.select(F.col("drop_id").alias(key)).distinct(), key, "left_anti")


def touched(facts: DataFrame, merges: DataFrame) -> DataFrame:
    """keep_id, n_facts: how many facts have a merged entity as subject or object afterwards."""
    ends = facts.select("id", F.explode(F.array("subject_id", "object_id")).alias("keep_id")).filter("keep_id is not null").distinct()
    return ends.join(merges.select("keep_id").distinct(), "keep_id", "left_semi").groupBy("keep_id").agg(F.count("*").alias("n_facts"))


def pending(aliases: DataFrame) -> DataFrame:
    """mention, entity_ids: mentions that may mean more than one entity, the candidates in the order of their ids."""
    known = aliases.filter("alias is not null").select(F.col("alias").alias("mention"), "entity_id").distinct()
    return known.groupBy("mention").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids")).filter(F.size("entity_ids") > 1)


def pending_details(links: DataFrame, entities: DataFrame) -> DataFrame:
    """mention, candidates: id, name and kind of each candidate in order; candidates that no longer exist are passed over."""
    rows = links.select("mention", F.posexplode("entity_ids").alias("n", "id")).join(entities.select("id", "canonical_name", "kind").distinct(), "id")
    shown = F.concat_ws(":", F.col("id").cast("string"), F.coalesce("canonical_name", F.lit("")), F.coalesce("kind", F.lit("")))
    g = rows.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("n", shown.alias("s")))).alias("l"))
    return g.select("mention", F.array_join(F.transform("l", lambda x: x["s"]), "; ").alias("candidates"))


def dismiss(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links none of whose candidates is among ids (one column)."""
    hit = links.select("mention", F.explode("entity_ids").alias("id")).join(ids.toDF("id").distinct(), "id", "left_semi").select("mention").distinct()
    return links.join(hit, "mention", "left_anti")


def resolve_mentions(mentions: DataFrame, max_rounds: int = 50) -> DataFrame:
    """mention, entity (the mention that created it), pending: the outcome of resolving mentions one after the other.

    mentions: mention (normalised), ordinal; the first ordinal of a mention counts.  A mention links to
    an earlier entity whose words contain its own or are contained in them; with several such it
    links to the earliest and is pending; with none it creates an entity.  The set of creators is the
    first maximal independent set in the order of ordinals: in each round a mention whose earlier
    neighbours are all settled is settled.  Candidate edges are made from the rarest word of the
    smaller set, so a frequent word doesn't multiply them.
    """
    first = durable(
        mentions.filter("mention is not null and mention <> ''").groupBy("mention").agg(F.min("ordinal").alias("ordinal"))
        .withColumn("words", F.array_distinct(F.split("mention", " ")))
    )
    words = first.select("mention", "ordinal", F.explode("words").alias("word"))
    rarity = words.groupBy("word").agg(F.count("*").alias("df"))
    rarest = words.join(rarity, "word").groupBy("mention", "ordinal").agg(F.min(F.struct("df", "word")).alias("r")).select(
        F.col("mention").alias("small"), F.col("ordinal").alias("small_at"), F.col("r.word").alias("word")
    )
    sets = first.select("mention", "words")
    pairs = (
        rarest.join(words.select(F.col("mention").alias("large"), F.col("ordinal").alias("large_at"), "word"), "word").filter("small <> large")
        .join(sets.select(F.col("mention").alias("small"), F.col("words").alias("ws")), "small")
        .join(sets.select(F.col("mention").alias("large"), F.col("words").alias("wl")), "large")
        .filter(F.size(F.array_except("ws", "wl")) == 0)
    )
    early = F.col("small_at") < F.col("large_at")
    edges = durable(
        pairs.select(
            F.when(early, F.col("small")).otherwise(F.col("large")).alias("earlier"), F.when(early, F.col("large")).otherwise(F.col("small")).alias("later"),
        ).distinct()
    )
    state = durable(first.select("mention", F.lit(None).cast("boolean").alias("creates")))
    for _ in range(max_rounds):
        seen = edges.join(state.select(F.col("mention").alias("earlier"), F.col("creates").alias("c")), "earlier").groupBy(F.col("later").alias("mention")).agg(
            F.max(F.coalesce(F.col("c"), F.lit(False)).cast("int")).alias("any_in"), F.max(F.col("c").isNull().cast("int")).alias("open")
        )
        state = durable(
            state.join(seen, "mention", "left").select(
                "mention",
                F.coalesce("creates", F.when(F.coalesce("any_in", F.lit(0)) == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True)).alias("creates"),
            )
        )
        if state.filter("creates is null").isEmpty():
            break
    else:
        raise RuntimeError("resolution did not settle")
    creators = state.filter("creates").select(F.col("mention").alias("earlier"))
    at = first.select(F.col("mention").alias("earlier"), F.col("ordinal").alias("at"))
    linked = edges.join(creators, "earlier").join(at, "earlier").join(
        state.filter("not creates").select(F.col("mention").alias("later")), "later"
    ).groupBy(F.col("later").alias("mention")).agg(F.min(F.struct("at", "earlier")).alias("e"), F.count("*").alias("n"))
    return state.filter("creates").select("mention", F.col("mention").alias("entity"), F.lit(False).alias("pending")).unionByName(
        linked.select("mention", F.col("e.earlier").alias("entity"), (F.col("n") > 1).alias("pending"))
    )
