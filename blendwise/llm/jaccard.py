"""N-gram Jaccard self-join: a size-aware, heavy-light set join with the boundary chosen by cost.

Documents with equal shingle sets form one class, and only classes are joined. Under any one order of all shingles,
two sets that reach the threshold t share at least c of their first ``n - ceil(t n) + c`` shingles, so

* light sets enumerate all 2-subsets of that prefix (c = 2) and meet where they share a subset,
* heavy sets scan the inverted lists of their prefix, in which light sets of nearly their size stand too.

Enumeration costs grow with the square of the prefix, lists with the frequency of the shingles; the boundary is the
size with the least total. The most central member of each bucket is its pivot and is compared with the others. The
classes that met a pivot in any bucket are its cell, and pairs left open lie within cells. Only classes outside the
component of the pivot are paired there, unless a bound excludes the pair: two sets share nothing of the pivot that
either lacks, and outside it only what others hold too. In crowded cells the shingles are counted anew, and
partners must meet in the lists of their few rarest ones; each pair is taken in its first common list. Copies cost
one comparison each instead of one per pair, and no link between components is lost.

The order puts rare shingles first, but counting all shingles would move several times the text. Prefixes are
short, so the order begins with a fixed ``PART`` of the hash space, by frequency; frequencies there are exact and
over all documents. Only sets that run out of shingles there, or hold too many frequent ones, go on to the rest,
whose frequencies are counted among these sets alone, and last to the frequent ones. Candidates travel as 32-bit
hashes; links are decided on whole sets of 64-bit hashes, which only sets with candidates need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import connected_components, forget, let, map_rows, stored
from blendwise.session import durable

SHINGLE = 5
PERCENT = 80
CROWD = 64  # members of a cell from which exact counts are worth their making
SUBSET_COST = 3  # of making one subset, against reading one list entry
PART = 0.3
FREQUENT = 256
FRONT = "array<struct<f:bigint,s:int>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs; a shorter text is one run, no words are none.

    Words are runs without ASCII white space, lower-cased in A-Z: what bytes.lower and bytes.split do.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > 100_000:  # a memory of word hashes, not of results
        cache.clear()
    codes = []
    for word in words:
        code = cache.get(word)
        if code is None:
            code = cache[word] = xxhash.xxh3_64_intdigest(word)
        codes.append(code)
    codes = np.array(codes, np.uint64)
    width = min(size, len(codes))
    run = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        run = _mixed(run * _MIX + codes[i : len(codes) - width + 1 + i])
    return np.unique(run)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The distinct upper halves of sorted hashes, still sorted."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(kind.to_pandas_dtype()), kind))


def shingle_parts(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, class_id, part) per row: set size, a hash of the set, and its shingles in ``PART``.

    class_id is equal for equal sets and NULL for empty ones. Hashes have 64 bits: among 10^10 different texts
    about three pairs of classes coincide by chance.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    limit = np.uint32(PART * 2**32)

    def make():
        cache: dict[bytes, int] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, seals, parts = [], [], []
            for value in batch.column(2):
                found = shingle_hashes(value.as_py(), size, cache)
                short = _short(found)
                sizes.append(len(found))
                seals.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                parts.append(short[: np.searchsorted(short, limit)])
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(seals, pa.int64()),
                    _lists(parts, pa.int32()),
                ],
                ["doc_id", "text_hash", "n", "class_id", "part"],
            )

        return work

    rows = docs.select(id_col, _text_hash(text_col).alias("h"), text_col)
    return map_rows(rows, make, f"doc_id {kind}, text_hash long, n long, class_id long, part array<int>")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(class_id, n, shingles, rest) of the wanted classes, from one document each.

    ``rest`` has the 32-bit hashes beyond ``PART``, for classes marked ``poor`` only.
    """
    limit = np.uint32(PART * 2**32)

    def make():
        cache: dict[bytes, int] = {}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_hashes(value.as_py(), size, cache) for value in batch.column(2)]
            rest = []
            for found, poor in zip(sets, batch.column(1)):
                short = _short(found) if poor.as_py() else np.empty(0, np.uint32)
                rest.append(short[np.searchsorted(short, limit) :])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets, pa.int64()), _lists(rest, pa.int32())],
                ["class_id", "n", "shingles", "rest"],
            )

        return work

    texts = docs.select(F.col(id_col).alias("i"), _text_hash(text_col).alias("h"), F.col(text_col).alias("t"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    rows = texts.join(wanted, same).select("class_id", "poor", "t")
    return map_rows(rows, make, "class_id long, n long, shingles array<long>, rest array<int>")


def _prefix_size(percent: int) -> Column:
    return (F.col("n") - F.ceil(F.col("n") * percent / 100) + 2).cast("int")


def _first(array: Column, n: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))


def prefixes(docs: DataFrame, every: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Prefixes (class_id, n, m, na, front) of classes that can have partners, and the whole sets of these.

    ``front``: (frequency, shingle) of the prefix for c = 2, rarest first, without shingles that only one document
    has; ``m``: an upper bound of the shingles that others share; ``na``: size of the counted part.
    """
    every = every.where("n > 0")
    common = every.select(F.explode("part").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = every.select("class_id", F.explode("part").alias("s")).join(common, "s")
    held = held.groupBy("class_id").agg(F.array_sort(F.collect_set(F.struct("f", "s"))).alias("held"))
    classes = every.groupBy("class_id").agg(
        F.max("n").alias("n"),
        F.max(F.size("part")).alias("na"),
        F.min(F.struct("doc_id", "text_hash")).alias("one"),
    )
    classes = classes.join(held, "class_id", "left").withColumn("held", F.coalesce("held", F.array().cast(FRONT)))
    own = F.col("na") - F.size("held")
    light = F.filter("held", lambda e: e["f"] <= FREQUENT)
    heavy = F.filter("held", lambda e: e["f"] > FREQUENT)
    classes = classes.select(
        "class_id",
        "n",
        "na",
        (F.col("n") - own).alias("m"),
        own.alias("own"),
        light.alias("light"),
        heavy.alias("heavy"),
        _prefix_size(percent).alias("p"),
        F.col("one.doc_id").alias("doc_id"),
        F.col("one.text_hash").alias("text_hash"),
    )
    reach = F.col("own") + F.size("light")
    classes = classes.withColumn("poor", reach < F.col("p")).where(
        (F.col("m") * 100 >= F.col("n") * percent) & (F.col("poor") | (F.col("own") < F.col("p")) & (F.size("light") > 0))
    )
    classes = stored(classes, "classes")
    whole = stored(whole_sets(docs, classes.select("class_id", "poor", "doc_id", "text_hash"), size, id_col, text_col), "sets")
    rest = whole.where(F.size("rest") > 0).select("class_id", F.explode("rest").alias("s"), F.size("rest").alias("nb"))
    common = rest.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    rest = rest.join(common, "s").groupBy("class_id").agg(
        F.array_sort(F.collect_set(F.struct("f", "s"))).alias("more"), F.max("nb").alias("nb")
    )
    sizes = whole.where(F.size("rest") > 0).groupBy("class_id").agg(F.max(F.size("rest")).alias("nb"))
    rest = sizes.join(rest.drop("nb"), "class_id", "left")
    sets = classes.join(rest, "class_id", "left")
    more, nb = F.coalesce("more", F.array().cast(FRONT)), F.coalesce("nb", F.lit(0))
    lack = F.col("p") - F.col("own") - F.size("light")  # of the prefix, after the counted part
    front = F.when(~F.col("poor"), _first(F.col("light"), F.col("p") - F.col("own"))).otherwise(
        F.concat("light", _first(more, lack - (nb - F.size(more))), _first(F.col("heavy"), lack - nb))
    )
    sets = sets.select("class_id", "n", "m", "na", "own", front.alias("front")).where(F.size("front") > 0)
    return stored(sets, "prefixes"), whole


def size_boundary(sets: DataFrame, percent: int) -> int:
    """The largest light size: the one with the least sum of subsets and list entries read.

    Only sums per power of 1.1 of the size reach the driver, at most about 200 numbers.
    """
    p = F.size("front").cast("double")
    costs = sets.select(
        F.floor(F.log(F.col("n")) / math.log(1.1)).alias("g"),
        "n",
        (p * (p - 1) / 2 * SUBSET_COST).alias("subsets"),
        F.aggregate("front", F.lit(0.0), lambda a, e: a + e["f"]).alias("lists"),
        p.alias("entries"),
    )
    sums = costs.groupBy("g").agg(
        F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("subsets", "lists", "entries")]
    )
    rows = sorted(sums.collect(), key=lambda r: r.n)
    best, boundary = sum(r.lists for r in rows), 0
    for i, row in enumerate(rows):
        light = sum(r.subsets for r in rows[: i + 1])
        heavy = sum(r.lists for r in rows[i + 1 :])
        near = sum(r.entries for r in rows[: i + 1] if r.n * 100 >= row.n * percent) if heavy else 0
        if light + heavy + near < best:
            best, boundary = light + heavy + near, row.n
    return boundary


def buckets(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(bucket, class_id, own, rare): who meets where.

    Each bucket is kept per size band, a set stands in its own band and the one below, so that all sets that can
    link meet and those of very different size do not. ``own`` and ``rare`` put central members first: few own
    shingles, then frequent ones.
    """
    light = F.col("n") <= boundary
    f = F.col("front")
    # The numbers alone, once per row: slices of stored rows would be copied for each element.
    subsets = let(
        F.transform(f, lambda e: e["s"]),
        lambda s: F.flatten(
            F.transform(
                s,
                lambda a, i: F.transform(
                    F.slice(s, i + 2, F.size(s)), lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b))
                ),
            )
        ),
    )
    single = F.transform(f, lambda a: F.xxhash64(a["s"], F.lit("list")))
    near = F.col("n") * 100 >= F.lit(boundary) * percent
    keys = F.when(light & near, F.concat(subsets, single)).when(light, subsets).otherwise(single)
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int")
    frequent = F.aggregate(f, F.lit(0.0), lambda a, e: a + F.log(e["f"].cast("double"))) / F.size(f)
    # A few wide rows make many: spread them over all tasks first. What a set has once is made before the rows are
    # multiplied; beside ``explode`` in one select it would be made anew, from the whole prefix, for each of them.
    rows = sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class_id").select(
        "class_id",
        (F.col("own") / F.greatest("na", F.lit(1))).alias("own"),
        (-frequent).alias("rare"),
        F.array_distinct(keys).alias("keys"),
        band.alias("band"),
    )
    rows = rows.select("class_id", "own", "rare", "band", F.explode("keys").alias("key"))
    rows = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    return rows.select(F.xxhash64("key", "band").alias("bucket"), "class_id", "own", "rare")


def cells(members: DataFrame) -> DataFrame:
    """(pivot, class_id): each class with the pivots, the most central members, of all its buckets.

    Every pair of a bucket is a pair with its pivot, or two members of that pivot's cell. Pivots are found by an
    aggregate that combines before the shuffle, and a cell holds a class once, in however many buckets they meet.
    """
    first = members.groupBy("bucket").agg(
        F.min(F.struct("own", "rare", "class_id")).alias("first"), F.count(F.lit(1)).alias("k")
    )
    first = first.where("k > 1").select("bucket", F.col("first.class_id").alias("pivot"))
    return members.join(first, "bucket").where("class_id != pivot").select("pivot", "class_id").distinct()


def _reaches(c: Column, n: Column, other: Column, percent: int) -> Column:
    """Whether sets of n and other shingles link if they share c."""
    return c * 100 >= percent * (n + other - c)


GAPS = 2  # words of 64 bits for the shingles of a pivot that a set lacks


def _most_shared(a: Column, b: Column) -> Column:
    """An upper bound of the shingles that two sets share; each side has its ``m`` and how it met one pivot.

    Inside the pivot they share at most the smaller overlap, and nothing that either lacks; lacking ones are bits of
    ``gaps``, of which some may coincide but none is made up. Outside, they share what others have there too.
    """
    lacking = sum((F.bit_count(a["gaps"][i].bitwiseOR(b["gaps"][i])) for i in range(GAPS)), F.lit(0))
    inside = F.least(a["c"], b["c"], a["size"] - lacking)
    outside = F.least(a["m"] - a["c"], b["m"] - b["c"])
    # least() skips NULLs, so a side that was not compared with the pivot must be told apart.
    return F.when(a["c"].isNull() | b["c"].isNull(), F.least(a["m"], b["m"])).otherwise(inside + outside)


def _may_link(c: Column, percent: int) -> Column:
    return _reaches(c, F.col("n"), F.col("n_b"), percent)


def overlaps(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(a, b, met, linked) for distinct pairs (a, b) of classes, decided on whole sets.

    ``met``: c, the number of shared shingles, size, that of a, and gaps, the shingles of a that b lacks as bits.
    """
    left = whole.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = whole.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.withColumn("c", F.size(F.array_intersect("sa", "sb")).cast("long"))
    both = both.withColumn("gap", F.array_except("sa", "sb"))

    def bits(word: int) -> Column:
        mine = F.filter("gap", lambda x: F.pmod(x, F.lit(GAPS)) == word)
        place = lambda x: F.pmod(F.floor(x / 1024.0).cast("long"), F.lit(64)).cast("int")
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(x))))

    met = F.struct("c", F.col("na").alias("size"), F.array(*[bits(i) for i in range(GAPS)]).alias("gaps"))
    return both.select("a", "b", met.alias("met"), _reaches(F.col("c"), F.col("na"), F.col("nb"), percent).alias("linked")).distinct()


def _crowd_lists(crowd: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(class_id, m, s, before) of the classes of crowded cells: the lists in which partners must meet.

    ``m`` counts the shingles that others of these classes have; the rest cannot be shared here. A partner has at
    least o = ceil(percent n / 100) of them, so the first common one, rarest first, is among the first m - o + 1 of
    either set. ``before`` has those ahead of s: a pair is taken in its first common list alone.
    """
    circle = crowd.select("class_id").union(crowd.select("pivot")).distinct()
    sets = whole.join(circle, "class_id", "left_semi").dropDuplicates(["class_id"])
    each = stored(sets.select("class_id", "n", F.explode("shingles").alias("s")), "crowd")
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = each.join(common, "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("held"))
    m = F.size("held").cast("long")
    front = held.select("class_id", m.alias("m"), "held", (m - F.ceil(F.col("n") * percent / 100) + 1).cast("int").alias("p"))
    front = front.where("p > 0").select("class_id", "m", F.transform(_first(F.col("held"), F.col("p")), lambda e: e["s"]).alias("s"))
    rows = front.select("class_id", "m", F.col("s").alias("front"), F.posexplode("s").alias("i", "s"))
    return rows.select("class_id", "m", "s", F.slice("front", F.lit(1), F.col("i")).alias("before"))


def open_pairs(placed: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) that may link, of classes in one cell but in different components.

    ``placed``: (pivot, class_id, n, m, met, root, home); home is the component of the pivot. Only classes outside it
    are paired, with all others. Small cells are paired as they stand. Classes of crowded ones meet in lists made
    with exact counts, each pair once, and are held against the first pivot that both have met.
    """
    size = placed.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"))
    size = size.where("lo < hi").select("pivot", "k")
    opened = stored(placed.join(size, "pivot"), "open")
    small, crowd = opened.where(F.col("k") <= CROWD), opened.where(F.col("k") > CROWD)
    ends = [F.least("class_id", "class_id_b").alias("a"), F.greatest("class_id", "class_id_b").alias("b")]
    differ = F.col("root") != F.col("root_b")

    def other(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, *[F.col(x).alias(f"{x}_b") for x in rows.columns if x != key])

    side = F.struct("m", "met.c", "met.size", "met.gaps").alias("side")
    rows = small.select("pivot", "class_id", "n", "root", "home", side)
    bound = _may_link(_most_shared(F.col("side"), F.col("side_b")), percent)
    pairs = rows.where("root != home").join(other(rows, "pivot"), "pivot").where(differ & bound).select(*ends)

    lists = stored(_crowd_lists(crowd, whole, percent), "lists")
    hub = F.struct(F.col("met.c").isNull().alias("blind"), (-F.col("k")).alias("rank"), "pivot", "met.c", "met.size", "met.gaps")
    hubs = crowd.groupBy("class_id", "n", "root").agg(
        F.array_sort(F.collect_list(hub)).alias("hubs"), F.max(F.col("root") != F.col("home")).alias("out")
    )
    rows = stored(lists.join(hubs.withColumn("ids", F.col("hubs.pivot")), "class_id"), "crowded")

    def held_against(pivot: Column) -> Column:
        of = lambda name, m: F.transform(
            F.filter(name, lambda h: h["pivot"] == pivot),
            lambda h: F.struct(F.col(m).alias("m"), h["c"].alias("c"), h["size"].alias("size"), h["gaps"].alias("gaps")),
        )
        fits = F.zip_with(of("hubs", "m"), of("hubs_b", "m_b"), lambda a, b: _may_link(_most_shared(a, b), percent))
        return F.exists(fits, lambda fit: fit)

    fits = (
        differ
        & _may_link(F.least("m", "m_b"), percent)
        & ~F.arrays_overlap("before", "before_b")
        & F.exists(F.slice(F.array_intersect("ids", "ids_b"), 1, 1), held_against)
    )
    return pairs.union(rows.where("out").join(other(rows, "s"), "s").where(fits).select(*ends)).distinct()


def link_classes(sets: DataFrame, whole: DataFrame, percent: int, boundary: int | None = None) -> DataFrame:
    """(class_id, root) of the classes that link with any; classes of one component share a root."""
    if boundary is None:
        boundary = size_boundary(sets, percent)
    members = stored(buckets(sets, boundary, percent), "buckets")
    met = stored(cells(members), "cells")
    forget(members)
    sizes = sets.select("class_id", "n", "m")
    pivots = sizes.select(F.col("class_id").alias("pivot"), F.col("n").alias("n_b"), F.col("m").alias("m_b"))
    star = met.join(sizes, "class_id").join(pivots, "pivot").where(_may_link(F.least("m", "m_b"), percent))
    star = stored(overlaps(star.select(F.col("pivot").alias("a"), F.col("class_id").alias("b")), whole, percent), "star")
    roots = stored(connected_components(star.where("linked").select("a", "b")), "roots")
    shared = star.select(F.col("a").alias("pivot"), F.col("b").alias("class_id"), "met")
    root = roots.select(F.col("node").alias("class_id"), "root")
    home = roots.select(F.col("node").alias("pivot"), F.col("root").alias("home"))
    placed = met.join(sizes, "class_id").join(shared, ["pivot", "class_id"], "left")
    placed = placed.join(root, "class_id", "left").join(home, "pivot", "left")
    placed = placed.withColumn("root", F.coalesce("root", "class_id")).withColumn("home", F.coalesce("home", "pivot"))
    late = stored(overlaps(open_pairs(placed, whole, percent), whole, percent).where("linked").select("a", "b"), "late")
    # What is linked already stands for its component, so the second search has few nodes.
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b")]
    late = late.join(ends[0], "a", "left").join(ends[1], "b", "left")
    late = late.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    joined = stored(connected_components(late), "joined").select("node", F.col("root").alias("new"))
    known = roots.select(F.col("node").alias("class_id"), F.col("root").alias("node"))
    known = known.join(joined, "node", "left").select("class_id", F.coalesce("new", "node").alias("root"))
    alone = joined.select(F.col("node").alias("class_id"), F.col("new").alias("root"))
    alone = alone.join(roots.select(F.col("node").alias("class_id")), "class_id", "left_anti")
    return stored(known.union(alone), "classes-linked")


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    boundary: int | None = None,
) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, class_id, component_class, component_id.

    Two documents link when their shingle sets have ``100 * intersection >= percent * union``; component_id is the
    smallest doc_id reachable, the own one included. Documents without words have no shingles and link with
    nothing; shorter ones are one shingle. Repeated rows are copies of each other. Rows without id take part, and
    get NULL as component_id only if their component holds no id; component_class tells components apart in any
    case. An empty table gives an empty result; other columns are not read.
    """
    every = stored(shingle_parts(docs, size, id_col, text_col), "shingles")
    sets, whole = prefixes(docs, every, size, percent, id_col, text_col)
    roots = link_classes(sets, whole, percent, boundary)
    rows = every.select("doc_id", "text_hash", "n", "class_id")
    rows = rows.join(roots, "class_id", "left")
    rows = durable(rows.withColumn("root", F.coalesce("root", "class_id")))
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        "class_id",
        F.col("root").alias("component_class"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id; documents without words all stay.

    Rows repeated under the id that stays are reduced to one, the one with the smallest text hash. All columns pass,
    whatever their names; an empty table gives an empty result.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col).where("n_shingles > 0")
    home = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = found.where(home).groupBy("component_class", "doc_id").agg(F.min("text_hash").alias("_keep_hash"))
    kept = kept.select(F.col("doc_id").alias("_keep_id"), "_keep_hash")
    # Same words as the shingles: a text is empty if it has nothing but ASCII white space.
    wordless = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\A[\x20\x09-\x0D]*\z")
    # One struct, so that no column of the documents can clash with the keys.
    rows = docs.where(~wordless).select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")
    )
    same = F.col("i").eqNullSafe(F.col("_keep_id")) & (F.col("h") == F.col("_keep_hash"))
    matched = rows.join(kept, same).dropDuplicates(["i", "h"])
    return matched.select(*[F.col("row")[c].alias(c) for c in docs.columns]).union(docs.where(wordless))
