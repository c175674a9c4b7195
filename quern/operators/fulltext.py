"""BM25 full-text ranking: a forward index scored in blocks of questions, and a stored inverted index with upkeep.

A batch of questions never meets the postings in a shuffle: documents are read once, and what is kept of them are the counts of
the asked terms.  A task inverts these and adds up, for each question of its block, the postings of the question's terms only.
Documents that can't be among the k best any more are passed over, so about k rows per question are all that is moved.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.functions.text import terms
from quern.runtime import durable, stored

K1, B = 1.2, 0.75
#: An inverse document frequency that isn't positive is replaced by this.
LEAST_IDF = 1e-6
#: Questions of one block; asked terms of one reading of the documents.
QUERY_BLOCK, VOCABULARY = 16_384, 2_000_000
#: Documents and postings of one task.
DOCUMENTS, POSTINGS = 1 << 20, 1 << 23
#: Documents in one table of sums, at most; postings that a question meets in it, so that the sums stay near the processor.
CELLS, NEAR = 1 << 20, 20_000
#: Parts of a stored inverted index, by the hash of the term.
BUCKETS = 64


def tokenised(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t: the terms of every document in order."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))


def postings(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, term, tf, dl of every document; all terms of a document are counted where it is read."""
    rows = tokenised(documents, id_col, text_col).select("doc_id", F.size("t").alias("dl"), F.array_sort("t").alias("t"))
    once = rows.select("doc_id", "dl", "t", F.explode(F.array_distinct("t")).alias("term"))
    tf = F.size("t") - F.size(F.array_remove("t", F.col("term")))
    return once.select("doc_id", "term", tf.cast("long").alias("tf"), "dl")


_ASKED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("dl", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]
)
_HITS = T.StructType([T.StructField("q_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _asked(tokens: DataFrame, words: pa.Array) -> DataFrame:
    """doc_id, dl, and the asked terms of each document with their counts (tokens: doc_id, t)."""

    def count(batch: pa.RecordBatch) -> dict:
        t = batch.column(1)
        offsets = t.offsets.to_numpy()
        size = np.diff(offsets)
        code = pc.fill_null(pc.index_in(t.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        known = code >= 0
        pair, n = np.unique(doc[known] * max(1, len(words)) + code[known], return_counts=True)
        ends = np.searchsorted(pair, np.arange(len(size) + 1) * max(1, len(words))).astype(np.int32)
        ids, tfs = (pair % max(1, len(words))).astype(np.int32), n.astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return {"doc_id": batch.column(0), "dl": size.astype(np.int32), "ids": lists(ids), "tfs": lists(tfs)}

    return map_batches(tokens, _ASKED, count)


class _Best:
    """The k best (score in millionths, then least id) of each question so far, and the score that a further one must pass."""

    def __init__(self, questions: int, k: int):
        self.k, self.passed = k, [0.0] * questions
        self.score, self.doc = [np.zeros(0, np.int64)] * questions, [np.zeros(0, np.int64)] * questions

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score > least - 1.1e-6
            score, doc = score[keep], doc[keep]
        s, d = np.concatenate([self.score[q], np.rint(score * 1e6).astype(np.int64)]), np.concatenate([self.doc[q], doc])
        order = np.lexsort((d, -s))[: self.k]
        self.score[q], self.doc[q] = s[order], d[order]
        if len(order) == self.k:
            # an equal score to six places may still come in by its lesser id
            self.passed[q] = max(0.0, (int(s[order[-1]]) - 0.6) * 1e-6)


def _sums(wanted: list, start: list, doc: np.ndarray, part: np.ndarray, total: np.ndarray, passed: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and scores of the documents above `passed`, the k best among them (wanted: term, weight; total: zeros, and zeros again afterwards)."""
    own = [(start[t], start[t + 1], w) for t, w in wanted if start[t] < start[t + 1]]
    if not own:
        return None
    for lo, hi, w in own:
        total[doc[lo:hi]] += part[lo:hi] if w == 1 else w * part[lo:hi]
    if 8 * sum(hi - lo for lo, hi, _ in own) > len(total):
        at = np.flatnonzero(total > passed)
        score = total[at]
        total.fill(0)
        return at, score
    met = doc[own[0][0] : own[0][1]] if len(own) == 1 else np.concatenate([doc[lo:hi] for lo, hi, _ in own])
    score = total[met]
    if len(met) > k * len(own):
        # a document is met once a term at most
        passed = max(passed, np.partition(score, len(met) - k * len(own))[len(met) - k * len(own)] - 1.1e-6)
    at = met[score > passed]
    at = at if len(own) == 1 else np.unique(at)
    score = total[at]
    total[met] = 0
    return at, score


def _score(index: DataFrame, asked: pa.Table, idf: np.ndarray, avgdl: float, k: int) -> DataFrame:
    """The k best documents of every question in each task (index: doc_id, dl, ids, tfs; asked: q_id, t, weight)."""
    names = pc.unique(asked["q_id"]).cast(pa.string())
    q = pc.index_in(asked["q_id"], value_set=names).to_numpy()
    term, weight = asked["t"].to_numpy(), asked["weight"].to_numpy()
    order = np.lexsort((term, q))
    q, term, weight = q[order], term[order], weight[order]
    ends = np.searchsorted(q, np.arange(len(names) + 1))
    schema = pa.schema([("q_id", pa.string()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        docs = np.concatenate([b.column(0).to_numpy() for b in parts])
        dl = np.concatenate([b.column(1).to_numpy() for b in parts])
        size = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in parts])
        ids = np.concatenate([b.column(2).flatten().to_numpy() for b in parts])
        tf = np.concatenate([b.column(3).flatten().to_numpy() for b in parts]).astype(np.float64)
        del parts
        value = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.repeat(dl, size) / avgdl))
        del tf
        offsets = np.concatenate([[0], np.cumsum(size)])
        pairs = list(zip(term.tolist(), weight.tolist()))
        wanted = [pairs[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
        met = np.bincount(ids, minlength=len(idf))[term].sum() / len(wanted)
        step = int(min(max(len(docs) * NEAR / max(1, met), 1 << 15), CELLS))
        best = _Best(len(wanted), k)
        for s in range(0, len(docs), step):
            e = min(s + step, len(docs))
            lo, hi = offsets[s], offsets[e]
            by_term = np.argsort(ids[lo:hi], kind="stable")
            doc, part = np.repeat(np.arange(e - s), size[s:e])[by_term], value[lo:hi][by_term]
            start = np.searchsorted(ids[lo:hi][by_term], np.arange(len(idf) + 1)).tolist()
            total = np.zeros(e - s)
            for n, own in enumerate(wanted):
                found = _sums(own, start, doc, part, total, best.passed[n], k)
                if found is not None and len(found[0]):
                    best.add(n, found[1], docs[s:e][found[0]])
        which = np.repeat(np.arange(len(wanted)), [len(x) for x in best.doc])
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(which)), pa.array(np.concatenate(best.doc)), pa.array(np.concatenate(best.score) / 1e6)], schema=schema
        )

    return index.select("doc_id", "dl", "ids", "tfs").mapInArrow(run, _HITS)


def _weights(n: int, df: np.ndarray) -> np.ndarray:
    raw = np.log((n - df + 0.5) / (df + 0.5))
    return np.where(raw <= 0, LEAST_IDF, raw)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(index: DataFrame, asked: DataFrame, words: pa.Array, n: int, avgdl: float, k: int) -> DataFrame:
    """q_id, doc_id, score: the k best of every task for all questions (index: doc_id, dl, ids, tfs, the ids being places in words; asked: q_id, term, weight)."""
    df = np.zeros(len(words))
    # one row per asked term
    for r in index.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r["t"]] = r["n"]
    idf = _weights(n, df)
    # two at least: a union of single partitions is one partition
    tasks = max(2, -(-n // DOCUMENTS), -(-int(df.sum()) // POSTINGS))
    holding = index.filter(F.size("ids") > 0).coalesce(tasks)
    questions = asked.select("q_id").distinct().count()
    # blocks for all cores, but none of a few questions, as each reads the counts again
    spread = min(-(-questions // 256), -(-2 * index.sparkSession.sparkContext.defaultParallelism // tasks))
    blocks, found = max(1, -(-questions // QUERY_BLOCK), spread), None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.hash("q_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        rows = rows.append_column("t", pc.index_in(rows["term"].cast(pa.string()), value_set=words))
        part = _score(holding, rows, idf, avgdl, k)
        found = part if found is None else found.unionByName(part)
    return found


def _passes(query_terms: DataFrame) -> Iterator[tuple[DataFrame, pa.Array]]:
    """(q_id, term, weight) of the questions with all their terms, in passes of about VOCABULARY terms."""
    asked = durable(query_terms.select(F.col("q_id").cast("string").alias("q_id"), "term", F.col("weight").cast("double").alias("weight")))
    passes = -(-asked.select("term").distinct().count() // VOCABULARY)
    for p in range(passes):
        own = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("q_id"), F.lit(passes)) == p)
        words = own.select("term").distinct().toArrow()["term"].cast(pa.string()).combine_chunks()
        if len(words):
            yield own, words


def bm25(query_terms: DataFrame, documents: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """q_id, doc_id, score, rank: the k best documents of every query (query_terms: q_id, term, weight).

    Documents are read once, but for more than VOCABULARY asked terms.  Equal scores (to six places) are
    ordered by id; a document without any asked term is no hit.
    """
    tokens = tokenised(documents, id_col, text_col)
    found = None
    for asked, words in _passes(query_terms):
        index = stored(_asked(tokens, words))
        size = index.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("long")).alias("avgdl")).first()
        part = _searched(index, asked, words, size["n"], size["avgdl"] or 1.0, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = query_terms.sparkSession.createDataFrame([], _HITS)
    return _top(found, k)


class StoredIndex:
    """An inverted index on disk: postings in parts by the hash of the term, one folder per version, and the documents' lengths.

    A search reads only the parts of the asked terms.  Every change writes a new version and then
    switches to it, so that a stop in between leaves the old one whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._state = os.path.join(path, "state.json")

    def state(self) -> dict:
        """version, documents, terms in all, and format of the index; zeros where there is none."""
        if not os.path.exists(self._state):
            return {"version": 0, "documents": 0, "length": 0, "parts": []}
        with open(self._state, encoding="utf-8") as f:
            return json.load(f)

    def _switch(self, state: dict) -> None:
        os.makedirs(self.path, exist_ok=True)
        with open(self._state + ".new", "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(self._state + ".new", self._state)

    def _write(self, documents: DataFrame, id_col: str, text_col: str, name: str) -> tuple[int, int]:
        posts = postings(documents, id_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        posts.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}/postings")
        tokenised(documents, id_col, text_col).select("doc_id", F.size("t").cast("long").alias("dl")).write.mode("overwrite").parquet(f"{self.path}/{name}/documents")
        row = self.spark.read.parquet(f"{self.path}/{name}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
        return row["n"], row["l"]

    def rebuild(self, documents: DataFrame, id_col: str, text_col: str) -> dict:
        """Index all documents anew."""
        version = self.state()["version"] + 1
        n, length = self._write(documents, id_col, text_col, f"v{version}")
        self._switch({"version": version, "documents": n, "length": length, "parts": [f"v{version}"]})
        return self.state()

    def append(self, documents: DataFrame, id_col: str, text_col: str) -> dict:
        """Index documents whose id the index doesn't hold yet."""
        old = self.state()
        if old["parts"]:
            documents = documents.join(self._read(old, "documents").select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
        version = old["version"] + 1
        n, length = self._write(documents, id_col, text_col, f"v{version}")
        self._switch({"version": version, "documents": old["documents"] + n, "length": old["length"] + length, "parts": [*old["parts"], f"v{version}"]})
        return self.state()

    def delete(self, ids: DataFrame) -> dict:
        """Drop documents (one column of ids) from the index."""
        old, key = self.state(), ids.columns[0]
        version = old["version"] + 1
        gone = ids.select(F.col(key).alias("doc_id")).distinct()
        for table, parts in (("postings", ["bucket"]), ("documents", [])):
            self._read(old, table).join(gone, "doc_id", "left_anti").write.partitionBy(*parts).mode("overwrite").parquet(f"{self.path}/v{version}/{table}")
        row = self.spark.read.parquet(f"{self.path}/v{version}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
        self._switch({"version": version, "documents": row["n"], "length": row["l"], "parts": [f"v{version}"]})
        return self.state()

    def _read(self, state: dict, table: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p}/{table}" for p in state["parts"]]) if len(state["parts"]) == 1 else self._union(state, table)

    def _union(self, state: dict, table: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{p}/{table}") for p in state["parts"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def search(self, query_terms: DataFrame, k: int) -> DataFrame:
        """q_id, doc_id, score, rank as bm25 gives them, from the stored postings."""
        state, found = self.state(), None
        for asked, words in _passes(query_terms) if state["documents"] else ():
            numbers = pa.table({"term": words, "t": pa.array(np.arange(len(words), dtype=np.int32))})
            names = self.spark.createDataFrame(numbers).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
            buckets = [r["bucket"] for r in names.select("bucket").distinct().collect()]
            # the asked terms of a pass are bounded; only their parts are read
            posts = self._read(state, "postings").filter(F.col("bucket").isin(buckets)).join(F.broadcast(names.drop("bucket")), "term")
            index = stored(posts.groupBy("doc_id").agg(F.max("dl").cast("int").alias("dl"), F.sort_array(F.collect_list(F.struct("t", F.col("tf").cast("int").alias("tf")))).alias("l")).select(
                "doc_id", "dl", F.transform("l", lambda x: x["t"]).alias("ids"), F.transform("l", lambda x: x["tf"]).alias("tfs")))
            part = _searched(index, asked, words, state["documents"], state["length"] / state["documents"] or 1.0, k)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], _HITS)
        return _top(found, k)
