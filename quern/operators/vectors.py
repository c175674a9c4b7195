"""Exact vector search and vector arithmetic as array expressions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.runtime import durable, stored


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    return F.transform(a.cast("array<double>"), lambda x: x / norm(a))


#: Query vectors of one block, and distances in one table.
QUERY_BLOCK, CELLS = 16_384, 4_000_000
#: Queries and vectors of one matrix product, so that it stays near the processor; vectors of one task.
TILE, VECTORS = (256, 2048), 1 << 17
_NEAR = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(queries: DataFrame):
    """(q_ids, matrix) of a stated query set (q_id, qvec), in blocks of about QUERY_BLOCK vectors."""
    known = queries.filter("qvec is not null")
    blocks = -(-known.count() // QUERY_BLOCK)
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b).orderBy("q_id").select("q_id", F.col("qvec").cast("array<double>").alias("v")).collect()
        if rows:
            yield [r["q_id"] for r in rows], np.array([r["v"] for r in rows])


def _named(found: DataFrame, q_ids: list, queries: DataFrame) -> DataFrame:
    """Numbers of a block's queries turned back into their ids."""
    kind = dict(queries.dtypes)["q_id"]
    names = found.sparkSession.createDataFrame(list(enumerate(q_ids)), f"q int, q_id {kind}")
    return found.join(F.broadcast(names), "q").select("q_id", "id", "distance")  # at most QUERY_BLOCK names, but for an uneven hash


def _union(parts: list[DataFrame], queries: DataFrame) -> DataFrame:
    if not parts:
        return queries.sparkSession.createDataFrame([], f"q_id {dict(queries.dtypes)['q_id']}, id long, distance double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rounding(norms: np.ndarray, most: float, dim: int) -> tuple[type, np.ndarray]:
    """The kind of number for products of the queries with vectors (squared lengths up to `most`), and twice the error that it can make."""
    largest = max(most, float(norms[np.isfinite(norms)].max(initial=0)))
    kind = np.float32 if 1e-12 < largest < 1e12 else np.float64
    slack = 2 * float(np.finfo(kind).eps) * (dim + 8) * (np.sqrt(norms) * np.sqrt(most) + most)
    return kind, slack + 4 * float(np.finfo(np.float64).eps) * (dim + 8) * (norms + most)


class _Nearest:
    """The k nearest (distance, then least id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.distance, self.id = k, np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        own = np.unique(q)
        old_d, old_i = self.distance[own], self.id[own]
        q = np.concatenate([np.searchsorted(own, q), np.repeat(np.arange(len(own)), self.k)])
        d, i = np.concatenate([distance, old_d.ravel()]), np.concatenate([ids, old_i.ravel()])
        order = np.lexsort((i, d, q))
        first = np.searchsorted(q[order], np.arange(len(own)))
        top = order[first[:, None] + np.arange(self.k)[None, :]]
        self.distance[own], self.id[own] = d[top], i[top]


def _above(table: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the numbers that reach their row's least; looked for by eights, as they are few."""
    found = table >= least[:, None]
    if found.shape[1] % 8:
        return np.nonzero(found)
    eight = np.flatnonzero(found.reshape(-1).view(np.uint64))
    at = (eight[:, None] * 8 + np.arange(8)[None, :])[found.reshape(-1, 8)[eight]]
    return at // found.shape[1], at % found.shape[1]


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """q_id, id, distance, rank: exact nearest neighbours of a stated query set (queries: q_id, qvec; vectors: id, vec).

    The vectors are made once and read once for each block of queries.  A task multiplies them with the block in tiles, in short
    numbers; all that may be among the k nearest of a query, with the rounding allowed for, are measured in double precision.
    """
    rows = vectors.filter("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    queries, parts = durable(queries), []
    rows = stored(rows)
    tasks = max(2, -(-rows.count() // VECTORS))
    for q_ids, block in _blocks(queries):
        norms = (block * block).sum(axis=1)

        def run(batches, block=block, norms=norms):
            best = _Nearest(len(block), k)
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _rows(batch.column(1))
                with np.errstate(over="ignore", invalid="ignore"):
                    squares = (x * x).sum(axis=1)
                known = np.isfinite(squares)
                ids, x, squares = ids[known], x[known], squares[known]
                if not len(ids):
                    continue
                kind, slack = _rounding(norms, float(squares.max()), x.shape[1])
                # a larger number is a nearer vector: the product less half the vector's squared length
                left = np.concatenate([block, np.ones((len(block), 1))], axis=1).astype(kind)
                right = np.concatenate([x, -squares[:, None] / 2], axis=1).astype(kind)
                for s in range(0, len(ids), TILE[1]):
                    own, part, turned = ids[s : s + TILE[1]], x[s : s + TILE[1]], right[s : s + TILE[1]].T
                    for a in range(0, len(block), TILE[0]):
                        table = left[a : a + TILE[0]] @ turned
                        n = slice(a, a + len(table))
                        reach = (norms[n] - best.distance[n, -1] ** 2) / 2
                        fresh = np.flatnonzero(np.isinf(best.distance[n, -1]))
                        if len(fresh) and len(own) > k:
                            reach[fresh] = np.partition(table[fresh], len(own) - k, axis=1)[:, len(own) - k]
                        q, i = _above(table, (reach - slack[n]).astype(kind))
                        if len(q):
                            best.add(q + a, own[i], np.sqrt(((part[i] - block[q + a]) ** 2).sum(axis=1)))
            hit = np.isfinite(best.distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.nonzero(hit)[0].astype(np.int32)), pa.array(best.id[hit]), pa.array(best.distance[hit])], names=["q", "id", "distance"]
            )

        parts.append(_named(rows.coalesce(tasks).mapInArrow(run, _NEAR), q_ids, queries))
    order = Window.partitionBy("q_id").orderBy("distance", "id")
    return _union(parts, queries).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def within(queries: DataFrame, vectors: DataFrame, distance: float) -> DataFrame:
    """q_id, id: all vectors nearer than distance to each of a stated query set, but for itself (queries: q_id, qvec; vectors: id, vec).

    Every vector is a candidate of every query; as in knn the vectors are read once for each block of queries.
    """
    parts = []
    for q_ids, block in _blocks(queries):
        norms = (block * block).sum(axis=1)

        def run(batches, block=block, norms=norms):
            step = max(1, CELLS // max(1, len(block)))
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _rows(batch.column(1))
                for s in range(0, len(ids), step):
                    part, own = x[s : s + step], ids[s : s + step]
                    rough = norms[:, None] + (part * part).sum(axis=1)[None, :] - 2 * (block @ part.T)
                    q, i = np.nonzero(rough < distance * distance + 1e-6 * (1 + norms[:, None]))
                    exact = np.sqrt(((part[i] - block[q]) ** 2).sum(axis=1))
                    keep = exact < distance
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[keep].astype(np.int32)), pa.array(own[i[keep]]), pa.array(exact[keep])], names=["q", "id", "distance"]
                    )

        rows = vectors.filter("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        parts.append(_named(rows.mapInArrow(run, _NEAR), q_ids, queries))
    return _union(parts, queries).filter(F.col("q_id") != F.col("id")).select("q_id", "id")


def blend(a: Column, b: Column) -> Column:
    """Mean of two vectors, renormalised unless it is zero."""
    mean = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x + y) / 2)
    length = norm(mean)
    return F.when(length > 0, F.transform(mean, lambda x: x / length)).otherwise(mean)


def cosine_threshold(similarity: float) -> float:
    """The L2 distance of unit vectors that have this cosine."""
    return float(np.sqrt(2 * (1 - similarity)))


def usable(vectors: DataFrame, id_col: str, dim: int = 64) -> DataFrame:
    """id, vec: the rows of a vector table whose vector has dim finite numbers that are not all zero, scaled to length one."""
    ok = (
        f"embedding is not null and size(embedding) = {dim} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= 3.4028235e38D) "
        "and exists(embedding, x -> x <> 0)"
    )
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def scale(batch):
        x = _rows(batch.column(1))
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        return {"id": batch.column(0), "vec": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))}

    return map_batches(vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), "embedding"), schema, scale)


def upsert(current: DataFrame, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """The current rows replaced or joined by the new ones with the same key; of new rows with one key the last in `order` wins
    (the key's greatest row, where no order is given)."""
    by = order or [F.col(c) for c in sorted(new.columns) if c != key and not dict(new.dtypes)[c].startswith("map")]
    last = Window.partitionBy(key).orderBy(*[c.desc() for c in by])
    newest = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return current.join(newest.select(key), key, "left_anti").unionByName(newest)


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector of a text's words (by their MD5): the default embedder where no model is given."""
    v = np.zeros(dim)
    for w in filter(None, re.split("[ \t\n\r]+", (text or "").lower())):
        h = hashlib.md5(w.encode()).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def batched(embedder=hash_embedding):
    """A function from a list of texts to their vectors, from one that takes one text; functions that take lists pass `embed_batch`."""
    many = getattr(embedder, "embed_batch", None)
    return many or (lambda texts: [embedder(t) for t in texts])


def embed(df: DataFrame, id_col: str, text_col: str, embedder=hash_embedding, normalize: bool = True, batch: int = 64) -> DataFrame:
    """id, embedding of every text.  embedder is a function from a text to a list of floats, or has embed_batch for lists of them; it is
    called in batches, loaded once per task, and its vectors are scaled to length one unless normalize is off."""
    kind = dict(df.dtypes)[id_col]
    kind = kind if kind == "string" else "long"
    schema = T.StructType([T.StructField("id", T.StringType() if kind == "string" else T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(part):
        texts, out = part.column(1).to_pylist(), []
        many = batched(embedder)
        for s in range(0, len(texts), batch):
            got = many(texts[s : s + batch])
            # a single vector for a single text is taken as one
            out += [got] if got and not hasattr(got[0], "__len__") else list(got)
        if normalize:
            lengths = [float(np.linalg.norm(v)) for v in out]
            out = [[x / n for x in v] if n else list(v) for v, n in zip(out, lengths)]
        return {"id": part.column(0), "embedding": out}

    return map_batches(df.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text")), schema, run)
