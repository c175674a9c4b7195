"""Connected components by alternating large-star and small-star rounds, on DataFrames only.

Each round takes the least neighbour of every node by a partial aggregate and joins it back,
so a node with a third of all edges is pre-aggregated before the shuffle and never gathered
into one task.  Rounds end when the edge set no longer changes; every round is cut by a
durable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component) for every node that has an edge to another node.

    Null ends and self loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        e = durable(_small_star(_large_star(e)))
        new = _state(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return row["n"], row["h"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    up = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return up.union(own).filter("u <> v").distinct()
