"""The k most similar vectors of every vector, by small-world graphs per shard with merged results.

Vectors are routed to shards by coarse centroids, fitted by spherical k-means on a bounded sample
(sample_rows).  A shard above shard_cap is cut by hash into graphs of at most about that many
vectors; each vector searches every graph of its own shard, and those of the second nearest
shard if its centroid is nearly as close (margin).  Results are merged by similarity, so a hot
shard costs more searches but no lost rows, and no task holds more than one graph and its visitors.
Vectors that at least k others equal exactly leave the graphs but for one: their k nearest are
their copies, taken within salted groups of copies.  Where that one is found by another vector,
the first k of its group are.

Cases: null vectors, other lengths, null or non-finite elements and zero vectors take no part;
ids that repeat with equal vectors count once; ties are broken by id; fewer than two usable
vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import apply_groups, map_batches
from quern.llm.hnsw import FlatHNSW
from quern.runtime import durable, hash_sample


def usable_vectors(df: DataFrame, id_col: str, dim: int = 64) -> DataFrame:
    """id, vec: rows whose vector has dim finite numbers that are not all zero."""
    ok = (
        "embedding is not null and size(embedding) = {0} and "
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= 3.4028235e38D) and exists(embedding, x -> x <> 0)"
    ).format(dim)
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        .filter("id is not null")
        .filter(ok)
        .select("id", F.col("embedding").alias("vec"))
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Spherical k-means; centroids that lose all members keep their place."""
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.choice(len(sample), count, replace=False))].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        full = norm > 1e-9
        c[full] = total[full] / norm[full, None]
    return c


_ROUTED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("shard", T.IntegerType()),
        T.StructField("own", T.BooleanType()),
    ]
)
_FOUND = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("neighbour", T.LongType()),
        T.StructField("similarity", T.FloatType()),
    ]
)


def nearest_neighbours(
    vectors: DataFrame, k: int = 5, shard_size: int = 2500, shard_cap: int = 10_000, sample_rows: int = 20_000, margin: float = 0.12, m: int = 8, ef: int = 32
) -> DataFrame:
    """id, neighbour, similarity, rank: the k most similar of every vector (vectors: id, vec)."""
    spark = vectors.sparkSession
    total = vectors.count()
    if total < 2:
        return spark.createDataFrame([], "id long, neighbour long, similarity float, rank int")
    # copies: groups larger than k are answered among themselves
    keyed = vectors.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")).distinct()
    copies = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("keep")).filter(F.col("n") > k)
    many = durable(keyed.join(copies, ["h1", "h2"]).select("id", "keep", "n"))
    n_many = many.count()
    without = many.filter("id <> keep").select("id")
    if n_many <= 1_000_000:  # at most 8 MB of ids; beyond that a shuffle join
        without = F.broadcast(without)
    indexed = vectors.join(without, "id", "left_anti") if n_many else vectors
    count = max(1, min(4096, round(total / shard_size)))
    sample = _matrix(pa.array([r["vec"] for r in hash_sample(vectors, ["id"], sample_rows).collect()], type=pa.list_(pa.float32())))
    centroids = fit_centroids(sample, min(count, len(sample)))

    def route(batch):
        x = _matrix(batch.column(1))
        s = x @ centroids.T
        first = s.argmax(axis=1)
        best = s[np.arange(len(x)), first]
        ids = batch.column(0).to_numpy()
        flat = pa.array(x.ravel())
        offsets = lambda n: pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1])
        rows, shards, own = np.arange(len(x)), first, np.ones(len(x), dtype=bool)
        if s.shape[1] > 1:
            s[np.arange(len(x)), first] = -9
            second = s.argmax(axis=1)
            near = np.flatnonzero(s[np.arange(len(x)), second] > best - margin)
            rows = np.concatenate([rows, near])
            shards = np.concatenate([first, second[near]])
            own = np.concatenate([own, np.zeros(len(near), dtype=bool)])
            flat = pa.array(x[rows].ravel())
        return {
            "id": ids[rows], "vec": pa.ListArray.from_arrays(offsets(len(rows)), flat).cast(pa.list_(pa.float32())),
            "shard": shards.astype(np.int32), "own": own,
        }

    # the routing is a small matrix product, so it is done again rather than written
    routed = map_batches(indexed.select("id", "vec"), _ROUTED, route)
    # one row per shard, at most 4096
    sizes = {r["shard"]: r["n"] for r in routed.filter("own").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    cuts = {s: -(-n // shard_cap) for s, n in sizes.items() if n > shard_cap}
    if cuts:
        table = spark.createDataFrame(list(cuts.items()), "shard int, cuts int")
        routed = routed.join(F.broadcast(table), "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    else:
        routed = routed.withColumn("cuts", F.lit(1))
    part = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    members = routed.filter("own").select("shard", part.alias("graph"), "id", "vec", F.lit(True).alias("member"))
    guests = (
        routed.withColumn("graph", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .filter(~F.col("own") | (F.col("graph") != part))
        .select("shard", "graph", "id", "vec", F.lit(False).alias("member"))
    )

    def search(table: pa.Table):
        member = np.array(table["member"].to_pylist(), dtype=bool)
        ids = table["id"].to_numpy()
        x = _matrix(table["vec"])
        first = np.zeros(len(ids), dtype=bool)
        first[np.unique(np.where(member, ids * 2, ids * 2 + 1), return_index=True)[1]] = True  # repeated rows count once
        member, ids, x = member[first], ids[first], x[first]
        at = np.flatnonzero(member)
        if not len(at):
            return None
        graph = FlatHNSW(x[at], m=m, ef_build=ef)
        got, sims = graph.search(x[at], k + 1, ef=16, start=np.arange(len(at)))
        own = [(ids[at], got, sims)]
        guest = np.flatnonzero(~member)
        if len(guest):
            g, s = graph.search(x[guest], k, ef=24)
            own.append((ids[guest], g, s))
        out = {"id": [], "neighbour": [], "similarity": []}
        for q, g, s in own:
            width = g.shape[1]
            a, b, c = np.repeat(q, width), ids[at][np.maximum(g, 0)].ravel(), s.ravel()
            keep = (g.ravel() >= 0) & (a != b)
            out["id"].append(a[keep])
            out["neighbour"].append(b[keep])
            out["similarity"].append(c[keep])
        return {n: np.concatenate(v) for n, v in out.items()}

    found = apply_groups(members.unionByName(guests), ["shard", "graph"], _FOUND, search)
    ranked = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    merged = found
    if n_many:
        merged = _with_copies(found.join(many.select("id"), "id", "left_anti"), many, k, n_many)
        merged = merged.unionByName(_copies_among_themselves(many, k))
    merged = merged.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    return merged.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def _with_copies(found: DataFrame, many: DataFrame, k: int, n_many: int) -> DataFrame:
    """A representative found as a neighbour stands for its copies: it becomes the first k ids of its group."""
    first = many.withColumn("i", F.row_number().over(Window.partitionBy("keep").orderBy("id"))).filter(F.col("i") <= k)
    first = first.select(F.col("keep").alias("neighbour"), F.col("id").alias("copy"))
    if n_many <= 1_000_000:  # at most 16 MB of ids; beyond that a shuffle join
        first = F.broadcast(first)
    return found.join(first, "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")


def _copies_among_themselves(many: DataFrame, k: int, group: int = 1000) -> DataFrame:
    """For every copy the k copies after it in its salted group, going round."""
    # groups of about `group` copies; the last part is never smaller than k + 1, as small groups aren't cut
    salted = many.withColumn("parts", F.greatest(F.lit(1), (F.col("n") / group).cast("int"))).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.col("parts"))
    )
    own = Window.partitionBy("keep", "salt").orderBy("id")
    whole = Window.partitionBy("keep", "salt")
    numbered = durable(salted.select("keep", "salt", "id", (F.row_number().over(own) - 1).alias("i"), F.count("*").over(whole).alias("size")))
    ahead = numbered.select("keep", "salt", "id", "size", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"), "i").select(
        "keep", "salt", "id", F.pmod(F.col("i") + F.col("step"), F.col("size")).alias("i")
    )
    return ahead.join(numbered.select("keep", "salt", "i", F.col("id").alias("neighbour")), ["keep", "salt", "i"]).filter(
        "id <> neighbour"
    ).select("id", "neighbour", F.lit(1.0).cast("float").alias("similarity"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """id_a < id_b: the pairs of which at least one is among the other's nearest."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
