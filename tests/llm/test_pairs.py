"""Near-duplicates, neighbours, name variants and leaks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.edit import levenshtein_table
from quern.llm import variants
from quern.llm.hnsw import FlatHNSW
from quern.llm.leakage import banded_edits, find_leaks, gram_hashes, plain_words
from quern.llm.nameforms import read_name
from quern.llm.nearduplicates import _sharing, bin_minima, similar_groups, similar_pairs, similar_texts
from quern.llm.neighbours import nearest_neighbours, neighbour_pairs, usable_vectors
from quern.llm.variants import link_variants, metric_join, variant_pairs


def _grams(t, q=8):
    t = " ".join(t.lower().split())
    return t, {t[i : i + q] for i in range(len(t) - q + 1)}


def _brute(texts, least=0.7):
    want = set()
    items = sorted((i, *_grams(t)) for i, t in texts if t is not None)
    for n, (i, a, x) in enumerate(items):
        for j, b, y in items[n + 1 :]:
            if a == b or x and y and len(x & y) >= least * len(x | y):
                want.add((i, j))
    return want


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(300)]
    texts = []
    for base in range(25):
        t = rng.choices(words, k=rng.randint(4, 120))
        for _ in range(rng.randint(1, 4)):
            u = list(t)
            for _ in range(rng.randint(0, 2)):
                u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(" ".join(u))
    texts += ["", "", "short", "SHORT ", None, texts[0].upper()]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, text string, rep int")
    classes, links = similar_texts(df)
    got = {(r.a, r.b) for r in similar_pairs(classes, links).collect()}
    assert got == _brute(rows)
    groups = {r.id: r for r in similar_groups(classes, links).collect()}
    assert len(groups) == len([t for t in texts if t is not None])
    for a, b in got:
        assert groups[a].group_id == groups[b].group_id


def test_near_duplicates_of_nothing(spark):
    classes, links = similar_texts(spark.createDataFrame([], "id long, text string"))
    assert classes.count() == 0 and links.count() == 0


def test_short_and_repetitive_texts_with_the_same_runs_meet(spark):
    body = "the harbour master wrote down every ship that came in before the ice, and none that left it again"
    df = spark.createDataFrame([(1, body), (2, f"{body} {body} {body}"), (3, "quite another text of about the same length as the first one, with no run of it at all, nor two")], "id long, text string")
    classes, links = similar_texts(df)
    assert [(r.a, r.b) for r in similar_pairs(classes, links).collect()] == [(1, 2)]


def test_minima_do_not_depend_on_repeats_or_order():
    h = gram_hashes("the quick brown fox jumps", 8)
    a = bin_minima(h, np.zeros(len(h), dtype=np.int64), 1, 70)
    b = bin_minima(np.concatenate([h[::-1], h]), np.zeros(2 * len(h), dtype=np.int64), 1, 70)
    assert (a == b).all()


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.1 * rng.normal(size=(8, 16)) for c in rng.normal(size=(120, 16))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = FlatHNSW(x, m=8, ef_build=32)
    got, _ = g.search(x, 6, ef=24)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    recall = np.mean([np.isin(want[i], got[i]).mean() for i in range(len(x))])
    assert recall >= 0.95


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.1 * rng.normal(size=(7, 64)) for c in rng.normal(size=(60, 64))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0] * 63), (904, [float("inf")] + [1.0] * 63), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").withColumn("id", F.lit("x"))
    v = usable_vectors(df, "chunk_id")
    assert v.select("id").distinct().count() == len(x)
    got = {(r.id_a, r.id_b) for r in neighbour_pairs(nearest_neighbours(v, shard_size=150, shard_cap=100)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) / len(want) >= 0.9
    assert nearest_neighbours(v.limit(1)).count() == 0


def test_many_copies(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0] + [0.0] * 63) for i in range(40)] + [(100 + i, rng.normal(size=64).tolist()) for i in range(30)]
    v = usable_vectors(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), "chunk_id")
    got = nearest_neighbours(v).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert all(len(by[i]) == 5 and all(r.neighbour < 40 and r.neighbour != i for r in by[i]) for i in range(40))


def test_copies_are_found_by_others(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 64)), 20, axis=0), rng.normal(size=(40, 64))]).astype(np.float32)
    x[20:30] = x[0] + 0.3 * x[20:30]  # ten rows near the copies
    got = nearest_neighbours(usable_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>"), "chunk_id"))
    by = {}
    for r in got.orderBy("rank").collect():
        by.setdefault(r.id, []).append(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u @ u.T).astype(np.float64), 5)
    np.fill_diagonal(s, -2)
    assert all(sorted(by[i]) == sorted(np.argsort(-s[i], kind="stable")[:5].tolist()) for i in range(20, 60))
    assert all(by[i] == [0, 1, 2, 3, 4] for i in range(20, 30))


def test_keys_shared_by_many_meet_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 6)) for i in range(60)] + [(i, 99) for i in range(40)] + [(70, 5), (70, 5), (71, 123), (72, 124), (73, 124)]
    df = spark.createDataFrame(rows, "id long, key long")
    by = {}
    for i, k in set(rows):
        by.setdefault(k, set()).add(i)
    want = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    assert {(r.a, r.b) for r in _sharing(df, block=7).collect()} == want == {(r.a, r.b) for r in _sharing(df, most=0).collect()}


def test_metric_join_is_exact(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcde", k=rng.randint(4, 9))) for _ in range(60)]
    names = sorted(set(base + [b[:3] + rng.choice("abcde") + b[3:] for b in base] + [b[1:] for b in base]))
    df = spark.createDataFrame([("x", n) for n in names], "block string, name string")
    got = {(r.a, r.b) for r in metric_join(df, radius=2, pivots=5, short=0).collect()}
    d = levenshtein_table(names, names)
    want = {(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and d[i, j] <= 2}
    assert got == want
    # cells cut into parts, and pivots by the size of the block, give the same
    assert {(r.a, r.b) for r in metric_join(df, radius=2, short=0, cell_rows=10).collect()} == want


def test_metric_join_by_residues_is_exact(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdé", k=rng.randint(1, 14))) for _ in range(120)]
    names = sorted(set(base + [b[1:] + "x" for b in base] + [b[:3] + b[4:5] + b[3:4] + b[5:] for b in base if len(b) > 5] + ["李", "王", "李王"]) - {""})
    df = spark.createDataFrame([(x, n) for n in names for x in ("x", "y")] + [("x", names[0]), ("x", None), (None, "b")], "block string, name string")
    d = levenshtein_table(names, names)
    for short, longest in ((6, 32), (0, 32), (6, 8)):
        want = {(x, a, b) for x in "xy" for i, a in enumerate(names) for j, b in enumerate(names) if i < j and d[i, j] <= (1 if min(len(a), len(b)) < short else 2)}
        rows = metric_join(df, radius=2, short=short, block_rows=0, longest=longest).collect()
        assert len(rows) == len(want) and {(r.block, r.a, r.b) for r in rows} == want


def test_a_large_block_is_not_copied_to_its_cells(spark, monkeypatch):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice(("b", "d", "g", "k", "l", "m", "n", "r", "s", "t")) + rng.choice("aeiou") for _ in range(6)) for _ in range(3000)})
    slips = [(n, n[:4] + "x" + n[5:]) for n in names[::100]]
    df = spark.createDataFrame([("x", n) for n in [*names, *(b for _, b in slips)]], "block string, name string")
    kept, durable = [], variants.durable

    def counted(df):
        kept.append((cut := durable(df)).count())
        return cut

    monkeypatch.setattr(variants, "durable", counted)
    got = {(r.a, r.b) for r in metric_join(df).collect()}
    assert {tuple(sorted(p)) for p in slips} <= got
    assert sum(kept) < 5 * len(names)


def test_name_forms():
    assert read_name("Bell, Peggy", "person") == ("person", "margaret", ["margaret"], "bell")
    assert read_name("Dr. Margaret A. Béll", None) == ("person", "margaret", ["margaret"], "bell")
    assert read_name("M. Bell", "person")[2] == ["m*"]
    assert read_name("The Bell Rly. Works Ltd", "org") == read_name("BELL RAILWAY WKS", "org")
    assert read_name("Gt. Bell-ford Brg.", "place") == read_name("Great Bellford Bridge", "place")
    assert read_name(None, "person") is None and read_name("  ", None) is None and read_name("?", "org") is None


def test_variants(spark):
    e = [
        (1, "Margaret Belltower", "person"), (2, "Belltower, Peggy", "unknown"), (3, "M. Beltower", "person"), (4, "Michael Kingsward", "person"),
        (5, "Belltower & Sons", "org"), (6, "Belltower and Sons Ltd", "org"), (7, None, None), (8, "Upper Kingsford Lock", "place"), (9, "Lower Kingsford Lock", "place"),
        (10, "MARGARET BELLTOWER", None), (11, "Ann Belltower", "person"),
    ]
    a = [(1, "the doctor"), (4, "the doctor"), (2, "belltower"), (11, "belltower"), (1, None), (99, "x")]
    es = spark.createDataFrame(e, "id long, canonical_name string, kind string").withColumn("group_id", F.lit(1))
    got = {(r.entity_id_a, r.entity_id_b) for r in variant_pairs(link_variants(es, spark.createDataFrame(a, "entity_id long, alias string"))).collect()}
    people = [1, 2, 3, 10]
    assert got == {(x, y) for x in people for y in people if x < y} | {(5, 6)}


def test_variants_outside_the_lists(spark):
    """Slips and pet forms of given names that no list holds, legal forms, abbreviations, acronyms; and names that differ."""
    e = [
        (1, "Mohammed Hassanpour", "person"), (2, "Mohamed Hassanpour", "person"), (3, "Wolfgang Beckermann", "person"), (4, "Wolfgnag Beckermann", "person"),
        (5, "Guadalupe Fernandez", "person"), (6, "Lupe Fernandez", "person"), (7, "Anastasia Petrovskaya", "person"), (8, "Nastya Petrovskaya", "person"),
        (9, "Steinbach AG", "org"), (10, "Steinbach Aktiengesellschaft", "org"), (11, "Universidad de Salamanca", "org"), (12, "Univ. de Salamanca", "org"),
        (13, "International Business Machines", "org"), (14, "IBM", "org"), (15, "Karen Hassanpour", "person"), (16, "Christina Beckermann", "person"),
        (17, "Christopher Beckermann", "person"), (18, "Ted Ollerby", "person"), (19, "Ted Ollerbey", "person"), (20, "Universidad de Sevilla", "org"),
    ]
    es = spark.createDataFrame(e, "id long, canonical_name string, kind string")
    groups = link_variants(es, spark.createDataFrame([], "entity_id long, alias string"))
    got = {(r.entity_id_a, r.entity_id_b) for r in variant_pairs(groups).collect()}
    assert got == {(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (18, 19)}
    assert {r.links for r in groups.collect()} == {1}


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(200)]
    items = [(i, "en", " ".join(rng.choices(vocab, k=40))) for i in range(12)] + [(50, "zh", "".join(rng.choices("天地玄黄宇宙洪荒日月", k=60)))]
    docs = []
    for n in range(60):
        body = rng.choices(vocab, k=30)
        it = rng.choice(items[:12])[2].split()
        at, k = rng.randrange(30), rng.randint(7, 14)
        docs.append((n, " ".join(body[:15]) + ".\n" + ", ".join(it[at : at + k]).upper() + " " + " ".join(body[15:])))
    docs += [(100, items[-1][2][5:25] + "。"), (101, items[-1][2][5:22]), (102, None), (103, ""), (104, items[0][2].replace(" ", " \n"))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, spark.createDataFrame(items, "item_id long, lang string, text string")).filter("exact").collect()}
    want = set()
    for n, t in docs:
        w = plain_words(t or "")
        for i, lang, x in items:
            u, v, k = (w, x.split(), 10) if lang == "en" else ("".join(w), x, 18)
            if {tuple(u[j : j + k]) for j in range(len(u) - k + 1)} & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}:
                want.add((n, i))
    assert got == want


def test_leaks_in_blocks_and_nothing(spark):
    items = spark.createDataFrame([(1, "en", "one two three four five six seven eight nine ten"), (2, "en", None)], "item_id long, lang string, text string")
    docs = spark.createDataFrame([(1, "One two three, four five six seven eight-\nnine nine ten"), (2, "one two three four five six se-\nven eight nine ten!")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, items, block_chars=10).filter("exact").collect()] == [(2, 1)]
    assert find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,n", [("", "", 0), ("abc", "abd", 1), ("abc", "xyz", 3), ("kitten", "sitting", 3)])
def test_banded_alignment(a, b, n):
    assert banded_edits(a, b, 3) == n
