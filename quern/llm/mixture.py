"""Mixing sources to target shares of the total size in tokens, with capped repeats.

Every document is hashed into one of the blocks of its source; a source has at least `least_blocks`
blocks and as many more as keep a block at about `block_rows` documents, so the plan is made from
block sums and no task orders more than a block.  A source whose quota exceeds its size is
passed over more than once; the last pass takes whole blocks in random order and a part of one
more.  The block draws of all sources are divided among the output shards by a splitting tree:
each node draws from the multivariate hypergeometric distribution how many of each source's
draws go to its left half, down to single shards, so every shard gets exact quotas and a fair mix.
Shards then draw disjoint blocks of each source's permutation and shuffle their rows locally; their number
follows from the tokens wanted.  Whether a source reaches its share is read off the draw: it fell short if every one of its
documents was drawn as often as allowed and their tokens are still fewer than wanted.

Cases: documents without text have no tokens and are left out; labels are compared without case
and outer blanks; a null or blank source belongs to no target and isn't part of the total;
sources without a target count in the total but aren't drawn; a target without documents gets
nothing and is reported; repeated target rows for one label are added up (the least max_repeats
holds); null shares and repeats count as 0; empty tables give no rows.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.runtime import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_SIZES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("tokens", T.LongType()),
    ]
)


def label_of(column: str):
    return F.lower(F.trim(F.col(column)))


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, label, tokens of every document with a source; the tokenizer file lies at the same path on every executor."""
    ready: list = []

    def count(batch):
        if not ready:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
            ready.append(t)
        texts = batch.column(2).to_pylist()
        sizes = [0] * len(texts)
        for s in range(0, len(texts), 64):
            part = [t or "" for t in texts[s : s + 64]]
            for k, e in enumerate(ready[0].encode_batch_fast(part, add_special_tokens=False)):
                sizes[s + k] = len(e)
        return {"doc_id": batch.column(0), "label": batch.column(1), "tokens": sizes}

    rows = documents.select(F.col("doc_id").cast("long"), label_of("source").alias("label"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.filter("label is not null and label <> ''"), _SIZES, count)


def clean_targets(targets: DataFrame) -> DataFrame:
    """label, source (as first written), target_share, max_repeats: one row per label."""
    rows = targets.select(
        label_of("source").alias("label"), "source",
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats"),
    )
    return (
        rows.filter("label is not null and label <> ''")
        .groupBy("label")
        .agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )


def plan_shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its size, the tokens wanted of it, and the most that it can give."""
    by_label = sizes.groupBy("label").agg(F.sum("tokens").alias("size"), F.count("*").alias("documents"))
    total = by_label.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    return (
        clean_targets(targets)
        .join(by_label, "label", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "label", "source", "target_share", "max_repeats",
            F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("documents", F.lit(0)).alias("documents"),
            (F.col("target_share") * F.col("total")).alias("wanted"),
            (F.coalesce("size", F.lit(0)) * F.col("max_repeats")).cast("double").alias("capacity"),
        )
    )


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: a splitting tree over the draws, exact in every row sum's share and every column sum."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = int(have.sum()) * (mid - lo) // (hi - lo)
        take = rng.multivariate_hypergeometric(have, left, method="marginals") if have.sum() else have * 0
        split(lo, mid, take)
        split(mid, hi, have - take)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def draw_mixture(
    sizes: DataFrame, targets: DataFrame, shards: int | None = None, least_blocks: int = 64, block_rows: int = 100_000,
    shard_tokens: int = 1 << 28, seed: int = 11,
) -> DataFrame:
    """shard, position key, label, doc_id, pass, tokens: the mixture, sorted within its shards.

    shards: by default as many as hold shard_tokens tokens each, at least 8.
    """
    spark = sizes.sparkSession
    sizes = durable(sizes.filter("tokens > 0"))
    # one row per target reaches the driver
    plan = {r["label"]: r for r in plan_shares(sizes, targets).collect()}
    known = spark.createDataFrame([(k, max(least_blocks, -(-r["documents"] // block_rows))) for k, r in plan.items()], "label string, blocks long")
    sized = sizes.join(F.broadcast(known), "label").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")).cast("int")).drop("blocks")
    shards = shards or max(8, -(-int(sum(min(r["wanted"], r["capacity"]) for r in plan.values())) // shard_tokens))
    # one row per block reaches the driver
    sums: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("label", "block").agg(F.sum("tokens").alias("n")).collect():
        sums.setdefault(r["label"], {})[r["block"]] = r["n"]
    rng = np.random.default_rng(seed)
    labels = sorted(sums)
    draws: list[list[tuple[int, int, int]]] = []  # per label: (pass, block, tokens to take or -1 for all)
    for label in labels:
        size = sum(sums[label].values())
        quota = min(plan[label]["wanted"], plan[label]["capacity"])
        full, rest = divmod(int(round(quota)), size) if size else (0, 0)
        own = [(p, b, -1) for p in range(full) for b in sums[label]]
        if rest and full < plan[label]["max_repeats"]:
            for b in rng.permutation(sorted(sums[label])).tolist():
                n = sums[label][b]
                if n <= rest:
                    own.append((full, b, -1))
                    rest -= n
                else:
                    own.append((full, b, rest))
                    break
        draws.append([own[i] for i in rng.permutation(len(own))])
    counts = split_quotas(np.array([len(d) for d in draws], dtype=np.int64), shards, rng) if draws else np.zeros((shards, 0), dtype=np.int64)
    rows = []
    for k, label in enumerate(labels):
        at = 0
        for shard in range(shards):
            for p, b, take in draws[k][at : at + int(counts[shard, k])]:
                rows.append((label, int(b), int(p), int(take), shard))
            at += int(counts[shard, k])
    mapping = spark.createDataFrame(rows, "label string, block int, pass int, take long, shard int")
    # the mapping has one row per draw of a block; beyond a million of them (about 40 MB) it is joined by shuffle
    drawn = sized.join(F.broadcast(mapping) if len(rows) <= 1_000_000 else mapping, ["label", "block"])
    order = Window.partitionBy("label", "block", "pass").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    part = drawn.filter("take >= 0").withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    part = part.filter(F.col("before") + F.col("tokens") / 2 <= F.col("take")).drop("before")
    mixed = drawn.filter("take < 0").unionByName(part)
    key = F.xxhash64(F.lit(seed + 2), "doc_id", "pass")
    return (
        mixed.select("shard", key.alias("order_key"), "label", "doc_id", "pass", "tokens")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "order_key", "doc_id")
    )


def reached_shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: its target share, the share reached, its tokens, documents, the most uses of one document, and whether the draw
    reached what was wanted of it: it did unless every document was used up and the tokens are still too few."""
    used = mixture.groupBy("label", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    by = used.groupBy("label").agg(
        F.sum("tokens").alias("drawn"), F.count("*").alias("distinct_documents"), F.max("uses").alias("most_uses")
    )
    total = by.agg(F.sum("drawn").alias("all_drawn"))
    drawn = F.coalesce("drawn", F.lit(0))
    return plan.join(by, "label", "left").join(F.broadcast(total)).select(  # total is one row
        "source", "target_share", F.round(F.coalesce(drawn / F.col("all_drawn"), F.lit(0.0)), 6).alias("reached_share"), drawn.alias("tokens"),
        F.coalesce("distinct_documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
        (~((drawn >= F.col("capacity")) & (drawn < F.col("wanted")))).alias("reachable"),
    )
