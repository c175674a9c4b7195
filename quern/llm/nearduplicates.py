"""Near-duplicate texts by the Jaccard similarity of their runs of q characters.

Equal texts (after lower-casing and reducing white space) are first collapsed to one representative.
The representatives are joined by size:

* Sets above the boundary enumerate fixed-size subsets: all size-c subsets of a set of a thousand
  runs cannot be listed, so the same `templates` random templates pick `subset_size` elements of every
  set (the least hash in each of the template's bins); two sets that share such a subset meet.
  At the similarity of 0.7 a pair misses all 48 subsets with a probability of about 0.016,
  at 0.75 of 0.001, and at 0.8 of less than 0.00002.
* Sets below the boundary scan inverted lists: an exact prefix filter over globally ordered
  runs, which loses no pair.  The boundary is where the lists' expected cost passes that of the
  subsets, from the measured mean length of a list, within limits.

Candidates are thinned by a 64-byte sketch whose bound a pair of the wanted similarity passes, and
verified exactly on their whole texts.

Cases: null texts take no part; texts of fewer than q characters have no runs and are linked only
to equal texts; repeated ids count once; a group of equal texts of any size is one
representative and never enumerated, except in the pairs that a caller asks for; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import map_batches
from quern.llm.leakage import gram_hashes
from quern.operators.graph import connected_components
from quern.runtime import durable, only_ids, stored

SKETCH = 64


def normal_text(column: str):
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.col(column)), r"(?U)\s+", " "))


def bin_minima(hashes: np.ndarray, doc: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """docs x bins: the least 32-bit hash in each bin; empty bins borrow from a bin chosen by a fixed sequence of probes."""
    where = doc * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    table = np.full(docs * bins, 0xFFFFFFFF, dtype=np.uint32)
    np.minimum.at(table, where, (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    table = table.reshape(docs, bins)
    full = table != 0xFFFFFFFF
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        probe = ((cols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(33)) % np.uint64(bins)
        probe = probe.astype(np.int64)
        good = full[rows, probe]
        # the probe's number is mixed in, so that two borrowed bins don't agree by chance of the lender
        table[rows[good], cols[good]] = table[rows[good], probe[good]] * np.uint32(2654435761) + np.uint32(attempt)
        rows, cols = rows[~good], cols[~good]
    return table


_SIGNED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sign_texts(bodies: DataFrame, q: int, templates: int, subset_size: int) -> DataFrame:
    """id, digest of the text, n (its distinct runs), keys (one per template), sketch; bodies: id, body."""
    bins = templates * subset_size

    def sign(batch):
        ids = batch.column(0).to_numpy()
        bodies = batch.column(1).to_pylist()
        counts, keys, sketches = [], [], []
        for s in range(0, len(bodies), 128):
            part = [np.sort(gram_hashes(t, q)) for t in bodies[s : s + 128]]
            sizes = np.array([len(h) for h in part])
            hashes = np.concatenate(part) if part else np.zeros(0, np.uint64)
            table = bin_minima(hashes, np.repeat(np.arange(len(part)), sizes), len(part), bins)
            cube = table.reshape(len(part), templates, subset_size).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.arange(templates, dtype=np.uint64)[None, :] * _MIX
                for j in range(subset_size):
                    key = (key ^ cube[:, :, j]) * _MIX
                    key ^= key >> np.uint64(31)
            step = bins // SKETCH
            sketch = (table[:, :: max(1, step)][:, :SKETCH] * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)
            counts += [int(len(h) > 0) + int(np.count_nonzero(h[1:] != h[:-1])) for h in part]
            keys += key.astype(np.int64).tolist()
            sketches += [row.tobytes() for row in sketch]
        digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in bodies]
        return {"id": ids, "digest": digests, "n": counts, "keys": keys, "sketch": sketches}

    return map_batches(bodies.select("id", "body"), _SIGNED, sign)


def exact_similarity(pairs: DataFrame, bodies: DataFrame, q: int) -> DataFrame:
    """a, b, similarity of candidate pairs, from their whole texts; only texts of candidates are moved."""
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = durable(only_ids(bodies.select("id", "body"), ids, keep=True).dropDuplicates(["id"]))
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b"
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def verify(batch):
        sims = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            u, v = np.unique(gram_hashes(x, q)), np.unique(gram_hashes(y, q))
            both = len(np.intersect1d(u, v, assume_unique=True))
            either = len(u) + len(v) - both
            sims.append(both / either if either else 0.0)
        return {"a": batch.column(0), "b": batch.column(1), "similarity": sims}

    return map_batches(joined.select("a", "b", "body_a", "body_b"), schema, verify)


def _sharing(keyed: DataFrame, block: int = 1000, most: int = 1_000_000) -> DataFrame:
    """a < b: ids that share a key (keyed: id, key).

    Keys are counted by a partial aggregate whose least and greatest id are the pair of a key that two ids have; only
    ids of keys with more are moved again.  A hot key's ids are cut into blocks that meet two by two, so no task holds a whole group.
    """
    counted = durable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n > 1"))
    two = counted.filter("n = 2 and a < b").select("a", "b")
    more = counted.filter("n > 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # at most 16 MB of keys are broadcast; more are joined by shuffle
    own = keyed.join(F.broadcast(more) if more.count() <= most else more, "key")
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id")
    left = own.select("key", "i", "j", F.col("part").alias("pa"), F.col("id").alias("a"))
    right = own.select("key", "i", "j", F.col("part").alias("pb"), F.col("id").alias("b"))
    many = left.join(right, ["key", "i", "j"]).filter("a < b and (i = j or pa <> pb)").select("a", "b")
    return two.unionByName(many).distinct()


def _grams(reps: DataFrame, q: int) -> DataFrame:
    """id, gram: the distinct runs of each text."""
    run = F.transform(F.sequence(F.lit(1), F.length("body") - (q - 1)), lambda i: F.xxhash64(F.substring(F.col("body"), i, F.lit(q))))
    return reps.select("id", F.explode(F.array_distinct(run)).alias("gram"))


def _small_pairs(grams: DataFrame, least: float) -> DataFrame:
    """Candidate pairs of small sets, by inverted lists over an exact prefix in the order of rarity."""
    # the order must be total and the same for every set: by frequency, then by the run itself
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "gram", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    sets = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    prefix = F.size("g") - F.ceil(F.size("g") * F.lit(least) - 1e-9).cast("int") + 1
    lists = sets.select("id", F.size("g").alias("size"), F.explode(F.slice("g", 1, prefix)).alias("e")).filter("e.df > 1").select(
        "id", "size", F.col("e.gram").alias("gram")
    )
    a = lists.select("gram", F.col("id").alias("a"), F.col("size").alias("na"))
    b = lists.select("gram", F.col("id").alias("b"), F.col("size").alias("nb"))
    return a.join(b, "gram").filter("a < b").filter(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")).select("a", "b").distinct()


def similar_texts(
    texts: DataFrame, least: float = 0.7, q: int = 8, templates: int = 48, subset_size: int = 7, low: int = 32, high: int = 160
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts (id, text): members has id and rep, the least id with the equal text; links has the pairs a < b of
    representatives with at least the least similarity."""
    bodies = texts.filter("id is not null and text is not null").select(F.col("id").cast("long"), normal_text("text").alias("body"))
    base = stored(sign_texts(bodies, q, templates, subset_size))
    # the least id of a text stands for it; the aggregate is partial before the shuffle, so copies don't gather
    lead = base.groupBy("digest").agg(F.min("id").alias("rep"))
    classes = durable(base.select("id", "digest").join(lead, "digest").select("id", "rep").distinct())
    copies = classes.filter("id <> rep").select("id").distinct()
    signed = only_ids(base.filter("n > 0"), copies, keep=False)
    reps = only_ids(bodies, copies, keep=False)
    # boundary: a prefix of 1 - least of a set, times the mean length of a list, against one key per template
    few = durable(signed.filter(F.col("n") <= high).select("id").distinct())
    upto = durable(_grams(only_ids(reps, few, keep=True).dropDuplicates(["id"]), q))
    lists = upto.groupBy("gram").agg(F.count("*").alias("df")).agg((F.sum(F.col("df") * F.col("df")) / F.sum("df")).alias("mean")).first()
    boundary = int(min(high, max(low, templates / ((1 - least) * max(1.0, lists["mean"] or 1.0)))))
    keyed = signed.filter(F.col("n") > boundary * least).select("id", F.explode("keys").alias("key"))
    met = _sharing(keyed)
    sketches = signed.select("id", "sketch")
    thin = met.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b"
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    # of 64 bins a pair of similarity s shares about 64 s; five deviations below that are let through
    floor = 64 * least - 5 * (64 * least * (1 - least)) ** 0.5

    def sift(batch):
        x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        y = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        keep = (x == y).sum(axis=1) >= floor
        return {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    large = map_batches(thin.select("a", "b", "sa", "sb"), schema, sift)
    small = _small_pairs(upto.join(signed.filter(F.col("n") <= boundary).select("id"), "id"), least)
    candidates = durable(large.unionByName(small).distinct())
    links = durable(exact_similarity(candidates, bodies, q).filter(F.col("similarity") >= least))
    return classes, links


def similar_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs a < b of similar texts, copies expanded: within a class of equal texts and across linked classes."""
    left = classes.select("rep", F.col("id").alias("x"))
    right = classes.select("rep", F.col("id").alias("y"))
    equal = left.join(right, "rep").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    across = (
        links.select("a", "b")
        .join(left.withColumnRenamed("rep", "a"), "a")
        .join(right.withColumnRenamed("rep", "b"), "b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    return equal.unionByName(across)


def similar_groups(classes: DataFrame, links: DataFrame) -> DataFrame:
    """One row per text: id, rep (its class of equal texts), group_id (connected classes), links (of its class to other classes)."""
    comps = connected_components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
