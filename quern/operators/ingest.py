"""Idempotent ingest: content hashes, chunk folding, deduplication, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key; null keys are equal to each other."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, stored: DataFrame, key: str, order: list) -> DataFrame:
    """Incoming rows whose key is neither stored nor met earlier among them."""
    return first_by(incoming, [key], order).join(stored.select(key).distinct(), key, "left_anti")


def plain_sentences(text: Column) -> Column:
    """The default splitter: after a full stop, question or exclamation mark and white space."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(parts, lambda s: s != "")


def make_chunks(sentences: Column, max_chars: int = 2048, overlap: int = 1) -> Column:
    """Greedy chunks of a sentence array: a chunk closes before the sentence that would pass max_chars, and the
    next begins with the last `overlap` sentences.  The result is an array of texts.

    A fold without Python.  Sizes count the sentences as they are; texts join them trimmed, by one blank.
    """
    state = "struct<done:array<string>,cur:array<string>,chars:int>"
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("cur"), F.lit(0).alias("chars")).cast(state)

    def text(cur):
        return F.concat_ws(" ", F.transform(cur, lambda s: F.trim(s)))

    def step(acc, s):
        full = (acc["chars"] + F.length(s) > max_chars) & (F.size(acc["cur"]) > 0)
        kept = F.slice(acc["cur"], F.greatest(F.size(acc["cur"]) - (overlap - 1), F.lit(1)), overlap) if overlap else empty
        kept_chars = F.aggregate(kept, F.lit(0), lambda n, x: n + F.length(x))
        return F.when(
            full,
            F.struct(
                F.concat(acc["done"], F.array(text(acc["cur"]))).alias("done"), F.concat(kept, F.array(s)).alias("cur"), (kept_chars + F.length(s)).alias("chars")
            ).cast(state),
        ).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(s)).alias("cur"), (acc["chars"] + F.length(s)).alias("chars")).cast(state)
        )

    return F.aggregate(sentences, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(text(acc["cur"])))).otherwise(acc["done"]))


def counters(chunks: DataFrame, facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row of what an ingest made: chunks (new, known), sentences, facts, entities, aliases, and mentions linked to entities that were there."""
    c = chunks.agg(
        F.count("*").alias("n_chunks"), F.countDistinct("sha256").alias("n_new"), (F.count("*") - F.countDistinct("sha256")).alias("n_known"),
        F.sum(F.length("text")).cast("long").alias("chars"), F.coalesce(F.sum(F.size(plain_sentences(F.col("text")))), F.lit(0)).cast("long").alias("n_sentences"),
    )
    without = F.col("object_id").isNull() & F.col("object_text").isNull()
    f = facts.agg(F.count("*").alias("n_facts"), F.count(F.when(F.col("source") == "coref", 1)).alias("n_coref"), F.count(F.when(without, 1)).alias("n_without_object"))
    e = entities.agg(F.countDistinct("id").alias("n_entities"))
    a = aliases.select("entity_id", "alias").distinct().agg(F.count("*").alias("n_aliases"))
    # four frames of one row each
    return c.join(F.broadcast(f)).join(F.broadcast(e)).join(F.broadcast(a)).withColumn("n_linked", F.col("n_aliases") - F.col("n_entities"))
