"""Linking the variant spellings of persons, organisations and places.

Names are read into a fixed part (given name, kind of business, added words of a place) and a core.
Three sets of distinct strings are joined within edit distance by metric-space partitioning: the
surnames of all persons, their given names, and the cores of organisations and places under each fixed part.
Every string is assigned to its nearest pivot and replicated to each pivot whose cell may hold a
string within the radius (by the triangle inequality, d(x, pivot) <= d(x, nearest) + 2 * radius); an
exact join with the Levenshtein metric runs inside each cell.  The number of pivots grows with the
square root of a block, and a cell above cell_rows is cut into parts that meet two by two, so no task
holds more than twice that.  Distances between unrelated names are much alike, so that most names go to
most cells and the work grows with the square of a block.  A block above block_rows is therefore joined by
residues: strings within the radius share what is left without up to radius letters of each, so only
strings with an equal residue meet, and the work grows with the number of strings and of pairs found.

Two persons are linked if surname and given name both agree within the radius.  Lists of given
names are evidence only: different listed names are different, as are two that many surnames bear; any
other given name may hold slips, and a short one that shares four letters with a single longer one under
the same surname is taken for its pet form.  Initials and ambiguous pet forms join the one full given name
that fits.  Organisations and places are linked too if their words align, each equal to the other's
or a beginning of it, and an acronym joins the one name whose initials it holds.

Cases: null, empty or unreadable names link to nothing; repeated rows and aliases count once;
an alias that is a bare surname or a role word is ignored, as many entities share it; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrow import apply_groups, map_batches
from quern.functions.edit import encode, levenshtein_pairs, levenshtein_table
from quern.llm.nameforms import GIVEN, JOINING, is_role, read_name
from quern.operators.graph import connected_components
from quern.runtime import durable, stored

_FORM = T.StructType(
    [
        T.StructField("entity_id", T.LongType()),
        T.StructField("own", T.BooleanType()),
        T.StructField("typ", T.StringType()),
        T.StructField("fixed", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("core", T.StringType()),
    ]
)


def read_forms(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The readable written forms of every entity: its canonical name (own) and its aliases."""
    names = entities.select(
        F.col("id").cast("long").alias("entity_id"), F.col("canonical_name").alias("name"), "kind", F.lit(True).alias("own")
    )
    extra = (
        aliases.select(F.col("entity_id").cast("long"), F.col("alias").alias("name"))
        .distinct()
        .join(entities.select(F.col("id").cast("long").alias("entity_id"), "kind"), "entity_id")
        .select("entity_id", "name", "kind", F.lit(False).alias("own"))
    )

    def parse(batch):
        out = {f.name: [] for f in _FORM}
        for eid, name, kind, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
            got = read_name(name, kind)
            if got is None or (not own and is_role(name)):
                continue
            for key, value in zip(out, (eid, own, *got)):
                out[key].append(value)
        return out

    forms = stored(map_batches(names.unionByName(extra), _FORM, parse).distinct())
    kinds = forms.filter("own").select("entity_id", F.col("typ").alias("own_typ")).distinct()
    return forms.join(kinds, "entity_id", "left").filter("own_typ is null or typ = own_typ").drop("own_typ")


def metric_join(names: DataFrame, radius: int = 2, pivots: int | None = None, short: int = 6, cell_rows: int = 4000, block_rows: int = 1000, longest: int = 32) -> DataFrame:
    """Pairs (block, a, b), a < b, of distinct names of a block within the radius of each other.

    names: block STRING, name STRING.  Names of fewer than `short` letters must be within one
    edit.  pivots: by default the square root of the block's names, 16 to 256.  A block of more than block_rows
    names is joined by residues, but for its names of more than `longest` letters, which have too many.  The
    result doesn't depend on the choice of the pivots, nor on which way a block is joined.
    """
    distinct = durable(names.select("block", "name").filter("name is not null and block is not null").distinct())
    sized = durable(distinct.join(distinct.groupBy("block").agg(F.count("*").alias("n")), "block"))
    celled = sized.filter((F.col("n") <= block_rows) | (F.length("name") > longest)).select("block", "name")
    keyed = sized.filter((F.col("n") > block_rows) & (F.length("name") <= longest + radius)).select("block", "name")
    return _cell_join(celled, radius, pivots, short, cell_rows).unionByName(_residue_join(keyed, radius, short)).distinct()


def _residue_join(names: DataFrame, radius: int, short: int) -> DataFrame:
    """The pairs of metric_join by residues, what a name leaves without up to `radius` of its letters: two names within the radius share one.

    names: distinct, read from a durable frame.  The keys are hashes of block and residue, so only the distance decides.
    """
    numbered = names.withColumn("id", F.monotonically_increasing_id())
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType())])

    def residues(batch):
        codes, lengths = encode(batch.column(1).to_pylist())
        blocks, ids = batch.column(2).to_numpy().view(np.uint64), batch.column(0).to_numpy()
        letters = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        letters ^= letters >> np.uint64(29)
        powers = np.cumprod(np.full(codes.shape[1], 0xBF58476D1CE4E5B9, dtype=np.uint64))
        keys, of = [], []
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            mine, block = np.ascontiguousarray(letters[at].T), blocks[at]
            # a pair with a short name is within one edit, so a short name loses one letter at most
            for lost in range(min(radius if size >= short else 1, radius, size) + 1):
                for gone in combinations(range(size), lost):
                    left = np.delete(np.arange(size), gone)
                    keys.append((mine[left] * powers[: len(left), None]).sum(axis=0, dtype=np.uint64) + block)
                    of.append(ids[at])
        return {"key": np.concatenate(keys).view(np.int64), "id": np.concatenate(of)}

    # a few MB of names leave many times as much, so they are spread over all tasks first
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = numbered.select("id", "name", F.xxhash64("block").alias("block")).repartition(tasks, "id")
    keys = map_batches(spread, schema, residues)
    met = keys.withColumnRenamed("id", "i").join(keys.withColumnRenamed("id", "j"), "key").filter("i < j").select("i", "j").distinct()
    one, two = (numbered.select(F.col("id").alias(i), F.col("block").alias(f"block_{i}"), F.col("name").alias(f"name_{i}")) for i in "ij")
    least = F.least(F.length("name_i"), F.length("name_j"))
    near = F.levenshtein("name_i", "name_j") <= F.when(least < short, min(1, radius)).otherwise(radius)
    return met.join(one, "i").join(two, "j").filter((F.col("block_i") == F.col("block_j")) & near).select(
        F.col("block_i").alias("block"), F.least("name_i", "name_j").alias("a"), F.greatest("name_i", "name_j").alias("b")
    )


def _cell_join(distinct: DataFrame, radius: int, pivots: int | None, short: int, cell_rows: int) -> DataFrame:
    """The pairs of metric_join by cells around pivots, some of them repeated."""
    sizes = distinct.groupBy("block").agg(F.count("*").alias("n"))
    wanted = F.lit(pivots) if pivots else F.greatest(F.lit(16), F.least(F.lit(256), F.ceil(F.sqrt("n")).cast("int")))
    order = Window.partitionBy("block").orderBy(F.xxhash64("name"), "name")
    # a share of each block, at least all of a small one, is ranked: about four times the pivots
    share = F.pmod(F.xxhash64(F.lit(1), "name"), F.lit(1 << 20)) * F.col("n") <= F.lit(4 << 20) * F.col("pivots")
    chosen = (
        distinct.join(sizes.withColumn("pivots", wanted), "block").filter(share)
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= F.col("pivots"))
        .groupBy("block")
        .agg(F.sort_array(F.collect_list("name")).alias("pivots"))
    )
    cells = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("cell", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("home", T.BooleanType()),
            T.StructField("d", T.ShortType()),
        ]
    )

    def assign(batch):
        by_block: dict[str, list[int]] = {}
        blocks, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, block in enumerate(blocks):
            by_block.setdefault(block, []).append(i)
        out: dict[str, list] = {f.name: [] for f in cells}
        for block, at in by_block.items():
            mine = [own[i] for i in at]
            table = levenshtein_table(mine, batch.column(2)[at[0]].as_py())
            home, least = table.argmin(axis=1), table.min(axis=1)
            rows, cols = np.nonzero(table <= (least + 2 * radius)[:, None])
            out["block"] += [block] * len(rows)
            out["cell"] += cols.tolist()
            out["name"] += [mine[r] for r in rows]
            out["home"] += (home[rows] == cols).tolist()
            out["d"] += table[rows, cols].tolist()
        return out

    assigned = durable(map_batches(distinct.join(chosen, "block").select("block", "name", "pivots"), cells, assign))
    # a large cell is cut into parts by hash; every two of them meet, and each one itself
    parts = assigned.groupBy("block", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    met = (
        assigned.join(parts, ["block", "cell"]).withColumn("part", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("block", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "name", "home", "d")
    )
    pairs = T.StructType([T.StructField("block", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

    def join_cell(table):
        table = table.sort_by([("d", "ascending"), ("name", "ascending")])
        own = table["name"].to_pylist()
        codes, lengths = encode(own)
        # an edit changes at most two of the letter counts, so most pairs need no exact distance
        letters = np.zeros((len(own), 32), dtype=np.int8)
        for k in range(codes.shape[1]):
            at = np.flatnonzero(lengths > k)
            np.add.at(letters, (at, codes[at, k] % 32), 1)
        d, home, part = table["d"].to_numpy(), np.array(table["home"].to_pylist(), dtype=bool), table["part"].to_numpy()
        apart = table["i"][0].as_py() != table["j"][0].as_py()
        found_a, found_b = [], []
        for i in np.nonzero(home)[0]:
            lo, hi = np.searchsorted(d, d[i] - radius, "left"), np.searchsorted(d, d[i] + radius, "right")
            near = np.arange(lo, hi)
            near = near[np.abs(lengths[near] - lengths[i]) <= radius]
            near = near[(near > i) | ~home[near]]
            if apart:
                near = near[part[near] != part[i]]
            near = near[np.abs(letters[near] - letters[i]).sum(axis=1, dtype=np.int16) <= 2 * radius]
            if not len(near):
                continue
            mine = np.full(len(near), i)
            dist = levenshtein_pairs(codes[mine], lengths[mine], codes[near], lengths[near])
            allowed = np.where(np.minimum(lengths[near], lengths[i]) < short, min(1, radius), radius)
            for j in near[dist <= allowed]:
                a, b = sorted((own[i], own[j]))
                if a != b:
                    found_a.append(a)
                    found_b.append(b)
        return {"block": [table["block"][0].as_py()] * len(found_a), "a": found_a, "b": found_b} if found_a else None

    return apply_groups(met, ["block", "cell", "i", "j"], pairs, join_cell)


def _both(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs in both directions."""
    return pairs.select(F.col("a").alias(a), F.col("b").alias(b)).union(pairs.select(F.col("b").alias(a), F.col("a").alias(b)))


def _aligned(cores: DataFrame) -> DataFrame:
    """Edges between cores (block, name) whose words align in order, each equal to the other's or a beginning of it."""
    words = F.filter(F.split("name", " "), lambda w: (w != "") & ~w.isin(*JOINING))
    own = cores.select("block", "name", words.alias("w")).filter("size(w) > 1")
    keyed = own.select("block", "name", "w", F.concat_ws("", F.transform("w", lambda x: F.substring(x, 1, 1))).alias("initials"), F.explode(F.array_distinct("w")).alias("word"))
    keyed = keyed.filter("length(word) >= 4")
    a = keyed.select("block", "initials", "word", F.col("name").alias("na"), F.col("w").alias("wa"))
    b = keyed.select("block", "initials", "word", F.col("name").alias("nb"), F.col("w").alias("wb"))
    fits = F.forall(F.zip_with("wa", "wb", lambda x, y: x.startswith(y) | y.startswith(x)), lambda z: z)
    met = a.join(b, ["block", "initials", "word"]).filter((F.col("na") < F.col("nb")) & (F.size("wa") == F.size("wb")) & fits)
    return met.select("block", F.col("na").alias("a"), F.col("nb").alias("b")).distinct()


def _acronyms(cores: DataFrame) -> DataFrame:
    """Edges between a single word of three to six letters and the one core of the same block whose words begin with them."""
    words = F.filter(F.split("name", " "), lambda w: (w != "") & ~w.isin(*JOINING))
    own = cores.select("block", "name", words.alias("w"))
    full = own.filter("size(w) between 3 and 6").select("block", F.concat_ws("", F.transform("w", lambda x: F.substring(x, 1, 1))).alias("a"), "name")
    one = full.groupBy("block", "a").agg(F.min("name").alias("b"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return own.filter("size(w) = 1").select("block", F.col("name").alias("a")).join(one, ["block", "a"])


def _given_edges(people: DataFrame, radius: int, established: int) -> DataFrame:
    """Edges between persons (node, given, core) of one surname whose given names are slips or pet forms of each other.

    At least one of the two is in no list; two names that `established` surnames bear are different.
    """
    known = sorted(GIVEN)
    bare = people.filter(~F.col("given").contains("*") & ~F.col("given").contains("/"))
    borne = bare.groupBy("given").agg(F.count("*").alias("n"))
    near = metric_join(borne.select(F.lit("given").alias("block"), F.col("given").alias("name")), radius, short=8)
    n = borne.select("given", "n", F.col("given").isin(*known).alias("listed"))
    slips = (
        near.join(n.select(F.col("given").alias("a"), F.col("n").alias("n1"), F.col("listed").alias("l1")), "a")
        .join(n.select(F.col("given").alias("b"), F.col("n").alias("n2"), F.col("listed").alias("l2")), "b")
        .filter(~(F.col("l1") & F.col("l2")) & (F.least("n1", "n2") < established) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)))
    )
    # the side that fewer than `established` surnames bear comes first, so that no frequent name meets all its slips
    rare = slips.select(F.when(F.col("n1") <= F.col("n2"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("n1") <= F.col("n2"), F.col("b")).otherwise(F.col("a")).alias("b"))
    left = bare.select("core", F.col("given").alias("a"), F.col("node").alias("na"))
    right = bare.select("core", F.col("given").alias("b"), F.col("node").alias("nb"))
    slipped = left.join(rare, "a").join(right, ["core", "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    four = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("given") - 3)), lambda i: F.substring(F.col("given"), i, F.lit(4)))
    grams = bare.filter(F.length("given") >= 4).select("core", "given", "node", F.explode(F.array_distinct(four)).alias("gram"))
    pet = grams.filter(~F.col("given").isin(*known) & (F.length("given") <= 6)).select("core", "gram", F.col("node").alias("a"), F.length("given").alias("size"))
    long = grams.select("core", "gram", F.col("node").alias("b"), F.length("given").alias("longer"))
    fits = pet.join(long, ["core", "gram"]).filter(F.col("longer") >= F.col("size") + 3).groupBy("a").agg(
        F.min("b").alias("b"), F.max("b").alias("other")
    ).filter("b = other").select("a", "b")
    return slipped.unionByName(fits)


def link_variants(entities: DataFrame, aliases: DataFrame, radius: int = 2, established: int = 5) -> DataFrame:
    """entity_id, group_id, links: the groups of entities that mean the same and how many others each is linked to; entities without
    any link are left out."""
    forms = stored(read_forms(entities, aliases))
    wide = lambda t: F.col(t) == "person"
    blocked = forms.withColumn("block", F.when(wide("typ"), F.lit("person")).otherwise(F.concat_ws("|", "typ", "fixed")))
    near = durable(metric_join(blocked.select("block", F.col("core").alias("name")), radius))
    # a person's node is the given name and the surname; of a form without one given name, the names or the initial it may stand for
    given = F.when(F.col("fixed") != "", F.col("fixed")).otherwise(F.array_join(F.array_sort("options"), "/"))
    persons = stored(blocked.filter(wide("typ")).select("entity_id", "own", given.alias("given"), "options", "core", F.concat_ws("#", given, "core").alias("node")))
    people = persons.select("node", "given", "core").distinct()
    around = _both(near.filter("block = 'person'"), "core", "core_b")
    like = people.join(around, "core").select("given", F.col("node").alias("a"), F.col("core_b").alias("core")).join(people, ["given", "core"])
    edges = like.select("a", F.col("node").alias("b")).unionByName(_given_edges(people, radius, established))
    rest = blocked.filter(~wide("typ"))
    cores = durable(rest.select("block", F.col("core").alias("name")).distinct())
    flat = near.filter("block <> 'person'").unionByName(_aligned(cores)).unionByName(_acronyms(cores).select("block", "a", "b"))
    edges = edges.unionByName(flat.select(F.concat_ws("#", "block", "a").alias("a"), F.concat_ws("#", "block", "b").alias("b")))
    comps = durable(connected_components(edges))

    def placed(df: DataFrame) -> DataFrame:
        return df.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    others = placed(rest.select("entity_id", "own", F.concat_ws("#", "block", "core").alias("node"))).select("entity_id", "own", F.col("comp").alias("identity"))
    single = F.size("options") == 1
    full = placed(persons.filter(single & ~F.col("given").contains("*")))
    settled = full.select("entity_id", "own", F.col("comp").alias("identity"))
    # initials and ambiguous pet forms: the full names of the same or a near surname that fit
    open_forms = placed(persons.filter(~(single & ~F.col("given").contains("*"))))
    shapes = open_forms.select("node", "options", "core").distinct().withColumn("o", F.explode("options")).drop("options")
    reach = shapes.join(around, "core").select("node", "o", F.col("core_b").alias("core")).unionByName(shapes.select("node", "o", "core"))
    known = full.select("core", F.col("given").alias("full"), F.col("comp").alias("fit")).distinct()
    fits = (
        reach.join(known, "core")
        .filter(F.when(F.col("o").endswith("*"), F.col("full").startswith(F.expr("substring(o, 1, length(o) - 1)"))).otherwise(F.col("o") == F.col("full")))
        .groupBy("node").agg(F.min("fit").alias("fit"), F.max("fit").alias("last"))
    )
    # without any that fits they are names of their own; with several they stay open
    resolved = open_forms.join(fits, "node", "left").filter("fit is null or fit = last").select(
        "entity_id", "own", F.coalesce("fit", "comp").alias("identity")
    )
    members = stored(others.unionByName(settled).unionByName(resolved).distinct())
    # two identities that one entity bears under its own name and an alias are the same
    bridge = members.filter("own").select("entity_id", F.col("identity").alias("a")).join(
        members.filter("not own").select("entity_id", F.col("identity").alias("b")), "entity_id"
    ).filter("a <> b")
    same = connected_components(bridge)
    own_known = members.filter("own").select("entity_id").distinct()
    final = members.filter("own").unionByName(
        members.filter("not own").join(own_known, "entity_id", "left_anti")
    )
    final = final.join(same.select(F.col("node").alias("identity"), F.col("component").alias("merged")), "identity", "left")
    final = final.select("entity_id", F.coalesce("merged", "identity").alias("identity")).distinct()
    groups = final.groupBy("identity").agg(F.min("entity_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    linked = final.join(groups, "identity").select("entity_id", "group_id", (F.col("n") - 1).alias("links"))
    return linked.groupBy("entity_id", "group_id").agg(F.max("links").alias("links"))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of entities of one group: entity_id_a < entity_id_b."""
    a = groups.select("group_id", F.col("entity_id").alias("entity_id_a"))
    b = groups.select("group_id", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "group_id").filter("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()
