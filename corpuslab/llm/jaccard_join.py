"""Exact Jaccard join of word-shingle sets in their metric space.

The Jaccard distance is a metric, and so is |x ^ y|, the size of the symmetric difference; a link
(similarity of at least ``threshold``) bounds both. The join uses that three times.

1. Texts with equal sets form one class; only classes are joined.
2. Classes are dealt into blocks. By size (the distance to the empty set) a class belongs to a
   band, and by the triangle inequality it is copied into the band below if it lies within the
   window of its upper edge. The range of shingle hashes is cut into more segments than a linked
   pair's symmetric difference can touch, so a linked pair agrees on a whole segment; classes
   that agree on a segment share a block.
   Pairs of blocks of up to ``SMALL_BLOCK`` members are told apart by the parities of hash buckets:
   two lists of parities differ in no more places than the sets in elements. What remains is
   verified on the whole sets, for each class its closest partner first.
3. Every larger block has a pivot, the member that agrees with most others, and a
   pivot's region holds the members of its blocks: a class on several boundaries is copied into
   several regions. Each member's exact distance to the pivot is worked out, and members within
   the radius are linked with it, one link each. Where a region still holds members of different
   components, it is joined once more inside, on the differences to the pivot: if x lies outside
   the radius and is linked to y, then x ^ p and y ^ p meet (otherwise |x ^ y| = |x ^ p| + |y ^ p|
   is beyond the radius), so x and y are in the subregion of a first difference they share. What
   stands before that difference on either side is no part of the other, which bounds |x ^ y| from
   below: pairs beyond the radius by that bound are never formed, nor are pairs of one component.
   "First" may mean any order that a region's members share. It is that of hashes, until more than
   ``CROWD`` members meet in one subregion (a family around a text that the pivot itself departs
   from: all members share the pivot's departures). Such a region is taken in the order of its own
   differences instead, common ones last, so that members meet in what is rare among them, and the
   pairs formed grow in proportion to the members.
   The rest is verified on the whole sets, for each class the likeliest partner in a component
   first, and others only where that leaves them apart.

Voronoi cells around sampled documents alone, with the triangle inequality's windows, do not work
for texts: nearly all distances are close to 1, so every document lies in the window of every cell.
Step 2 takes their place on the first level. Inside a region of near copies windows of distances
to pivots prune nothing either, since all distances are about as large as the radius itself; the
differences tell the members apart.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; texts with fewer words
than a shingle count as one shingle; null and wordless texts have no shingles and link with
nothing; null ids are carried along; repeated rows are in one class; an empty table gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_udf, released, removed, row_key, small_batches, small_or_not, written
from .components import connected_components

#: Segments beyond the fewest that guarantee an agreement: so many may be empty on both sides. Sets
#: with more empty segments have keys of those too, which they share with many others; one more for
#: every eight differences leaves hardly any such sets.
SPARE = 2
DIFFERENCES_PER_SPARE = 8
BAND_RATIO = 1.25
#: The keys are joined in so many parts, one after another, which bounds the disk that shuffles take.
KEY_PARTS = 8
#: Keys of a row that others share, about.
KEYS_A_ROW = 8
#: And so are the pairs whose whole sets meet, and the differences to pivots.
PAIR_PARTS = 4
#: 64-bit words of the shortest list of parities, which is the one that goes with each member of a block.
FOLD = 8
#: Members of a block up to which its pairs are compared by their parities, which gives a class so many partners a block at most.
SMALL_BLOCK = 64
#: Members of a subregion beyond which its region is taken with rare differences first.
CROWD = 64
#: Differences are common that more than ``CROWD`` members share, and more than one in so many: few enough for a list of each region.
COMMON_SHARE = 64
#: Distinct words whose hashes a worker keeps.
WORDS_KEPT = 1 << 17
#: Rows with sets of shingles that a worker gets at a time.
BATCH = 1000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = np.full(len(words) - k + 1, len(words) if len(words) < k else k, np.uint64)
    for i in range(k):
        acc = _mixed(acc * _M1 + h[i : len(words) - k + 1 + i])
    return np.unique(acc)


class Bands:
    """Size bands and the segments of each, for one threshold a / b (as whole numbers)."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.num, self.den = num, den
        self.ratio = max(BAND_RATIO, den / num)  # so that the window never reaches two bands down
        self.edges = [1]

    def most_apart(self, n: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set has n elements."""
        return n * (self.den - self.num) // self.num

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * self.ratio)))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, spare ones) of a set of n elements: its own band and, within the window, the one below."""
        own = self.band(n)
        bands = [own]
        if own and (self.edges[own] - 1) * self.den >= n * self.num:
            bands.append(own - 1)
        found = []
        for band in bands:
            apart = self.most_apart(self.edges[band + 1] - 1)
            if apart:
                spare = SPARE + apart // DIFFERENCES_PER_SPARE
                found.append((band, apart + 1 + spare, spare))
        return found


def segment_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set's segments in its bands. Empty segments have one only where a set has more than the spare ones."""
    if not len(h):
        return np.zeros(0, np.int64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(h ^ _M1))])
    keys = []
    for band, m, spare in bands.of(len(h)):
        cuts = np.searchsorted(h, np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m))
        cuts = np.concatenate([[0], cuts, [len(h)]])
        sizes = np.diff(cuts)
        sums = upto[cuts[1:]] - upto[cuts[:-1]]
        key = _mixed(_mixed(sums + sizes.astype(np.uint64) * _M2) + np.arange(m, dtype=np.uint64) * _M3 + np.full(m, band, np.uint64) * _M1)
        if (sizes == 0).sum() <= spare:
            key = key[sizes > 0]
        keys.append(key)
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def parities(h: np.ndarray) -> bytes:
    """Whether each of a power of two of buckets (as many as shingles, or up to twice that) holds an odd number of a set's hashes.

    Buckets go by the low bits, so that a longer list folds into a shorter one, down to ``FOLD`` words.
    Two sets' lists differ in no more places than the sets have different elements.
    """
    n_buckets = max(64 * FOLD, 1 << (len(h) - 1).bit_length()) if len(h) else 64 * FOLD
    counts = np.bincount((h & np.uint64(n_buckets - 1)).astype(np.int64), minlength=n_buckets)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _parities_apart():
    """In how many places two lists of parities differ, the longer one folded."""

    def apart(xs: pd.Series, ys: pd.Series) -> pd.Series:
        found = np.zeros(len(xs), np.int64)
        xs, ys = xs.to_numpy(), ys.to_numpy()
        lengths = pd.DataFrame({"x": [len(x) for x in xs], "y": [len(y) for y in ys]})
        for (x, y), at in lengths.groupby(["x", "y"]).indices.items():
            folded = [
                np.bitwise_xor.reduce(np.frombuffer(b"".join(some[at]), np.uint64).reshape(len(at), -1, min(x, y) // 8), axis=1)
                for some in (xs, ys)
            ]
            found[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
        return pd.Series(found)

    return arrow_udf(apart, "long")


def _sketcher(k: int, num: int, den: int):
    """Size, 128-bit name and parities of a text's set, and the keys of its segments, dealt into ``KEY_PARTS``."""
    n_parts = KEY_PARTS
    parts = [f"k{i}" for i in range(n_parts)]

    def sketch(texts: pd.Series) -> pd.DataFrame:
        bands, rows = Bands(num, den), []
        for text in texts:
            h = shingles(text, k)
            name = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
            keys = segment_keys(h, bands)
            part = keys.view(np.uint64) % np.uint64(n_parts)
            odd = parities(h)
            fold = np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, FOLD), axis=0)
            rows.append((len(h), name, odd, fold, *(keys[part == i] for i in range(n_parts))))
        return pd.DataFrame(rows, columns=["n", "class", "odd", "fold", *parts])

    return arrow_udf(sketch, "n long, class binary, odd binary, fold array<long>, " + ", ".join(f"{c} array<long>" for c in parts))


def _set_maker(k: int):
    def make(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, k) for t in texts]
        return pd.DataFrame({"class": [xxhash.xxh3_128_digest(h.tobytes()) for h in sets], "set": [h.view(np.int64) for h in sets]})

    return arrow_udf(make, "class binary, set array<long>")


def _differ(num: int, den: int):
    """Size of the intersection, |x - p|, |p - x| and the first differences: x's own first."""

    def differ(xs: pd.Series, ps: pd.Series) -> pd.DataFrame:
        rows = []
        for x, p in zip(xs, ps):
            x, p = np.asarray(x).view(np.uint64), np.asarray(p).view(np.uint64)
            own, lost = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
            room = len(x) * (den - num) // num + 1
            first = np.concatenate([own[:room], lost[: max(0, room - len(own))]])
            rows.append((len(own), len(lost), first.view(np.int64)))
        return pd.DataFrame(rows, columns=["n_own", "n_lost", "first"])

    return arrow_udf(differ, "n_own long, n_lost long, first array<long>")


def _all_differences():
    """The whole symmetric difference of two sets."""

    def differ(xs: pd.Series, ps: pd.Series) -> pd.Series:
        return pd.Series([np.setxor1d(np.asarray(x), np.asarray(p), assume_unique=True) for x, p in zip(xs, ps)])

    return arrow_udf(differ, "array<long>")


def _rare_before_common(num: int, den: int):
    """The first of a set's differences, by hash, those in the second list last."""

    def order(sizes: pd.Series, differences: pd.Series, common: pd.Series) -> pd.Series:
        found = []
        for n, all_of, known in zip(sizes, differences, common):
            late = np.isin(np.asarray(all_of), np.asarray(known))
            found.append(np.concatenate([all_of[~late], all_of[late]])[: n * (den - num) // num + 1])
        return pd.Series(found)

    return arrow_udf(order, "array<long>")


def _meeter():
    def meet(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.asarray(x), np.asarray(y), assume_unique=True)) for x, y in zip(xs, ys)], dtype="int64")

    return arrow_udf(meet, "long")


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each row.

    Two texts link when ``den * |x & y| >= num * |x | y|``.
    """
    found = _labelled(docs, k, num, den, id_col, text_col)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n (shingles), root (one for each component) and component_id of each row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = named.withColumn("row", row_key("doc_id", "text"))
    with small_batches(docs.sparkSession, BATCH):
        keyed = written(named.select("doc_id", "row", _sketcher(k, num, den)("text").alias("s")).select("doc_id", "row", "s.*"), "join-keyed")
    n_rows = keyed.count()
    rows = written(keyed.select("doc_id", "row", "n", "class"), "join-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "odd", "fold")).alias("least")
    facts = keyed.where("n > 0").groupBy("class", "n").agg(least)
    facts = facts.select(F.monotonically_increasing_id().alias("c"), "class", "n", F.col("least.doc_id").alias("min_id"), "least.row", "least.odd", "least.fold")
    facts = written(facts, "join-facts", n_rows)

    members = blocks(keyed, facts, n_rows)
    roots = class_roots(docs, members, facts, k, num, den, id_col, text_col)
    labelled = facts.join(roots.withColumnRenamed("node", "c"), "c", "left").select("class", "min_id", F.coalesce("root", "c").alias("root"))
    least = labelled.groupBy("root").agg(F.min("min_id").alias("component_id"))
    components = written(labelled.join(least, "root").select("class", "root", "component_id"), "join-components", n_rows)
    removed(facts)
    return rows.join(components, "class", "left")


def blocks(keyed: DataFrame, facts: DataFrame, n_rows: int) -> DataFrame:
    """The members (key, c, n) of each block of two classes or more, and the block's size; blocks with the same members are one block.

    Until the members are known, 64 bits stand for a class: should two classes share them, a block
    has a member too many, which costs a comparison. The table ``keyed`` is deleted.
    """
    spark = keyed.sparkSession
    parts = []
    for part in range(KEY_PARTS):
        # Dealt out by key first: counting and joining then read the same shuffle.
        some = keyed.select(F.xxhash64("class").alias("h"), F.explode(f"k{part}").alias("key")).repartition("key")
        shared = some.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
        parts.append(written(some.join(shared, "key").distinct(), "join-shared", n_rows * KEYS_A_ROW // KEY_PARTS))
        released(spark)
    removed(keyed)
    members = reduce(DataFrame.union, parts)
    alike = members.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("h")).alias("a"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("b"))
    alike = alike.groupBy("size", "a", "b").agg(F.min("key").alias("key")).select("key", "size")
    named = members.join(alike, "key").join(facts.select(F.xxhash64("class").alias("h"), "c", "n"), "h").select("key", "size", "c", "n")
    named = written(named, "join-members", sum(p.count() for p in parts))
    removed(*parts)
    released(spark)
    return named


def class_roots(docs: DataFrame, members: DataFrame, facts: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The root of each class that is linked to another (node, root). The table ``members`` is deleted."""
    spark = members.sparkSession
    n_members = members.count()
    odds = facts.select(F.col("c").alias("x"), "n", "odd", "fold")
    close = small_block_pairs(members, odds, num, den)
    n_close = close.count()
    members, all_members = members.where(F.col("size") > SMALL_BLOCK).select("key", "c"), members
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    degree = members.join(sizes, "key").groupBy("c").agg(F.sum("size").alias("degree"))
    pivots = members.join(degree, "c").groupBy("key").agg(F.max(F.struct("degree", F.negative("c").alias("c"))).alias("top"))
    placed = members.join(pivots.select("key", F.negative("top.c").alias("p")), "key").where("c <> p")
    of_block = written(placed.select("key", F.col("c").alias("x"), "p"), "join-regions", n_members)
    removed(all_members)
    regions = of_block.select("x", "p").distinct()

    in_regions = of_block.select("x", F.lit(False).alias("pivot")).union(of_block.select("p", F.lit(True)))
    ends = close.select("x", F.lit(False)).union(close.select("y", F.lit(False)))
    involved = in_regions.union(ends).groupBy("x").agg(F.max("pivot").alias("pivot"))
    involved = written(involved, "join-involved", n_members)
    wanted = involved.join(facts.select(F.col("c").alias("x"), "class", "n", "row"), "x")
    texts = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    # Written before repeated rows are dropped, so that they meet no more than once in a task.
    texts = written(texts.join(wanted.select("row"), "row", "left_semi"), "join-texts")
    released(spark)
    with small_batches(spark, BATCH):
        sets = written(_sets_of(wanted, texts.dropDuplicates(["row"]), k), "join-sets")
    removed(texts, involved)
    released(spark)

    regions = written(regions, "join-pairs", n_members)
    n_placed = regions.count()
    parts = [_placed(regions, sets, num, den, part) for part in range(PAIR_PARTS)]
    placed = reduce(DataFrame.union, parts)
    links = [written(placed.where("near").select("x", F.col("p").alias("y")), "join-links", n_placed)]
    # Of the pairs of small blocks, every class with the closest of its partners first: one comparison a class.
    either = close.union(close.select("y", "x", "apart"))
    closest = either.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("best")).select(F.least("x", "best.y").alias("x"), F.greatest("x", "best.y").alias("y"))
    links += _verified(closest.distinct(), sets, num, den, n_close)
    roots = _roots(links)
    far = region_pairs(of_block, placed, roots, sets, num, den)
    removed(of_block, regions, *parts)
    released(spark)
    far = _possible(far, odds, num, den).select("x", "y", "root_y", "shared")
    near = _between(close, roots).select("x", "y", "root_y", F.negative("apart").alias("shared"))
    with small_batches(spark, BATCH):
        pairs = written(far.union(near), "join-possible", n_close)
    removed(close)
    n_pairs = pairs.count()
    # The partner in each component that shares most subregions first, the others if that is no link.
    best = pairs.groupBy("x", "root_y").agg(F.max(F.struct("shared", F.negative("y").alias("y"))).alias("best"))
    for some in (best.select("x", F.negative("best.y").alias("y")), None):
        more = _verified(_between(pairs.select("x", "y"), roots).select("x", "y") if some is None else some, sets, num, den, n_pairs)
        links += more
        if not all(m.isEmpty() for m in more):
            roots = _roots(links)
    removed(sets, pairs, *links)
    return roots


def small_block_pairs(members: DataFrame, odds: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of the members of small blocks that their sizes and parities leave possible, and in how many parities they differ (apart)."""
    spark, n_members = members.sparkSession, members.count()
    small = members.where(F.col("size") <= SMALL_BLOCK).select("key", "c", "n").join(odds.select(F.col("x").alias("c"), "fold"), "c")
    a, b = small.alias("a"), small.alias("b")
    sizes = F.expr(f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)")
    apart = " + ".join(f"bit_count(a.fold[{i}] ^ b.fold[{i}])" for i in range(FOLD))
    close = F.expr(f"({apart}) * {den + num} <= (a.n + b.n) * {den - num}")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & sizes & close)
    met = written(met.select(F.col("a.c").alias("x"), F.col("b.c").alias("y")).distinct(), "join-met", n_members)
    released(spark)
    with small_batches(spark, BATCH):
        found = written(_possible(met, odds, num, den).select("x", "y", "apart"), "join-close", n_members)
    removed(met)
    released(spark)
    return found


def _possible(pairs: DataFrame, odds: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may be links by their parities, and in how many of these they differ (apart)."""
    xs = odds.select("x", F.col("n").alias("nx"), F.col("odd").alias("xodd"))
    ys = odds.select(F.col("x").alias("y"), F.col("n").alias("ny"), F.col("odd").alias("yodd"))
    met = pairs.join(xs, "x").join(ys, "y").withColumn("apart", _parities_apart()("xodd", "yodd")).drop("xodd", "yodd")
    return met.where(f"apart * {den + num} <= (nx + ny) * {den - num}")


def _placed(regions: DataFrame, sets: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """Distances and differences of one part of the members to their pivots, and whether they are links."""
    spark = regions.sparkSession
    mine = F.pmod(F.xxhash64("x"), F.lit(PAIR_PARTS)) == part
    xs = sets.where(mine).select("x", F.col("n").alias("nx"), F.col("set").alias("xset"))
    ps = sets.where("pivot").select(F.col("x").alias("p"), F.col("n").alias("np"), F.col("set").alias("pset"))
    met = regions.where(mine).join(xs, "x").join(ps, "p")
    met = met.withColumn("d", _differ(num, den)("xset", "pset")).select("x", "p", "nx", "np", "d.*")
    near = F.expr(f"{den} * (nx - n_own) >= {num} * (np + n_own)")
    with small_batches(spark, BATCH):
        found = written(met.withColumn("near", near), "join-placed")
    released(spark)
    return found


def region_pairs(of_block: DataFrame, placed: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of different components that the differences to their pivots leave possible: x, y, root_y, shared."""
    spark = placed.sparkSession
    root = F.coalesce("root", "x").alias("root")
    of_block = of_block.join(roots.withColumnRenamed("node", "x"), "x", "left").select("key", "x", "p", root)
    mixed = of_block.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    mixed = of_block.join(mixed, "key").select("x", "p", "root").distinct()
    lists = written(placed.join(mixed, ["x", "p"]), "join-lists")
    n_lists = lists.count()
    crowded = written(_subregions(lists.select("p", "near", "root", F.explode("first").alias("e"))).where(F.col("n") > CROWD).select("p").distinct(), "join-crowded", n_lists)
    # At the first difference that both have, what stands before it is only x's or only y's. What
    # follows differs by no less than its numbers do: own and lost differences apart.
    own = F.expr("abs(a.n_own - a.at - b.n_own + b.at) + abs(a.n_lost - b.n_lost)")
    lost = F.expr("abs(a.n_own + a.n_lost - a.at - b.n_own - b.n_lost + b.at)")
    roomy, parts = lists.join(small_or_not(crowded), "p", "left_anti"), []
    for part in range(PAIR_PARTS):
        parts.append(written(_meeting(roomy, F.when(F.col("a.at") < F.col("a.n_own"), own).otherwise(lost), num, den, part), "join-meetings", n_lists))
        released(spark)
    if not crowded.isEmpty():
        ordered = _rare_first(lists.join(small_or_not(crowded), "p", "left_semi"), sets, num, den)
        for part in range(PAIR_PARTS):
            parts.append(written(_meeting(ordered, lost, num, den, part), "join-meetings", n_lists))
            released(spark)
        removed(ordered)
    found = reduce(DataFrame.union, parts).groupBy("x", "y", "root_y").agg(F.sum("shared").alias("shared"))
    found = written(found, "join-candidates", sum(p.count() for p in parts))
    removed(lists, crowded, *parts)
    return found


def _subregions(diffs: DataFrame) -> DataFrame:
    """(p, e) and n, the number of members, of each subregion that can hold a pair."""
    shared = diffs.groupBy("p", "e").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_and("near").alias("all_near"), F.count("*").alias("n"))
    return shared.where("lo <> hi AND NOT all_near").select("p", "e", "n")


def _rare_first(lists: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Members of crowded regions with their first differences, those that many members share last."""
    spark, n_lists = lists.sparkSession, lists.count()
    xs = sets.join(small_or_not(lists.select("x").distinct()), "x", "left_semi").select("x", F.col("set").alias("xset"))
    ps = sets.where("pivot").select(F.col("x").alias("p"), F.col("set").alias("pset")).join(small_or_not(lists.select("p").distinct()), "p", "left_semi")
    whole = lists.drop("first").join(xs, "x").join(ps, "p").withColumn("all", _all_differences()("xset", "pset")).drop("xset", "pset")
    with small_batches(spark, BATCH):
        whole = written(whole, "join-differences")
    released(spark)
    sizes = whole.groupBy("p").agg(F.count("*").alias("size"))
    counts = whole.select("p", F.explode("all").alias("e")).groupBy("p", "e").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    common = counts.join(sizes, "p").where(F.col("n") * COMMON_SHARE > F.col("size")).groupBy("p").agg(F.collect_list("e").alias("common"))
    common = written(common, "join-common", n_lists)
    ordered = whole.join(small_or_not(common, "common"), "p", "left")
    first = _rare_before_common(num, den)("nx", "all", F.coalesce("common", F.array().cast("array<long>")))
    with small_batches(spark, BATCH):
        found = written(ordered.withColumn("first", first).drop("all", "common"), "join-ordered")
    removed(whole, common)
    return found


def _meeting(lists: DataFrame, follows: Column, num: int, den: int, part: int) -> DataFrame:
    """x, y, root_y and how many first differences to a pivot they share, of one part of the differences.

    ``follows`` bounds from below how much a and b differ after a difference both have.
    """
    diffs = lists.select("p", "x", "nx", "n_own", "n_lost", "near", "root", F.posexplode("first").alias("at", "e"))
    diffs = diffs.where(F.pmod(F.xxhash64("e"), F.lit(PAIR_PARTS)) == part)
    shared = written(_subregions(diffs).select("p", "e"), "join-subregions", lists.count())
    diffs = diffs.join(shared, ["p", "e"])
    a, b = diffs.where("NOT near").alias("a"), diffs.alias("b")
    same = (F.col("a.p") == F.col("b.p")) & (F.col("a.e") == F.col("b.e")) & (F.col("a.root") != F.col("b.root"))
    once = F.col("b.near") | (F.col("a.x") < F.col("b.x"))
    sizes = F.expr(f"{den} * least(a.nx, b.nx) >= {num} * greatest(a.nx, b.nx)")
    within = (F.col("a.at") + F.col("b.at") + follows) * (den + num) <= (F.col("a.nx") + F.col("b.nx")) * (den - num)
    met = a.join(b, same & once & sizes & within)
    met = met.select(F.col("a.x").alias("x"), F.col("b.x").alias("y"), F.col("b.root").alias("root_y"))
    return met.groupBy("x", "y", "root_y").agg(F.count("*").alias("shared"))


def _roots(links: list[DataFrame]) -> DataFrame:
    return connected_components(reduce(DataFrame.union, links), "x", "y")


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    of_x = roots.select(F.col("node").alias("x"), F.col("root").alias("rx"))
    of_y = roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
    apart = F.coalesce("rx", "x") != F.coalesce("ry", "y")
    return pairs.join(of_x, "x", "left").join(of_y, "y", "left").where(apart).withColumn("root_y", F.coalesce("ry", "y")).drop("rx", "ry")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, about: int) -> list[DataFrame]:
    """The pairs that are links, by their whole sets, in parts."""
    spark = pairs.sparkSession
    pairs, links = written(pairs, "join-pairs", about), []
    n_pairs = pairs.count()
    for part in range(PAIR_PARTS):
        mine = pairs.where(F.pmod(F.xxhash64("x"), F.lit(PAIR_PARTS)) == part)
        wanted_x, wanted_y = (small_or_not(mine.select(F.col(c).alias("x")).distinct()) for c in ("x", "y"))
        xs = sets.join(wanted_x, "x", "left_semi").select("x", F.col("n").alias("nx"), F.col("set").alias("xset"))
        ys = sets.join(wanted_y, "x", "left_semi").select(F.col("x").alias("y"), F.col("n").alias("ny"), F.col("set").alias("yset"))
        met = mine.join(xs, "x").join(ys, "y").withColumn("i", _meeter()("xset", "yset"))
        with small_batches(spark, BATCH):
            links.append(written(met.where(f"{den} * i >= {num} * (nx + ny - i)").select("x", "y"), "join-links", n_pairs))
        released(spark)
    removed(pairs)
    return links


def _sets_of(wanted: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Whole shingle sets of classes, made again from the row of each that was chosen; ``texts`` has each row once."""
    found = wanted.join(texts, "row").select("x", "n", "pivot", "class", _set_maker(k)("text").alias("made"))
    return found.where("made.class = class").select("x", "n", "pivot", "made.set")


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id, in the columns of ``docs``.

    Of documents with the same smallest id one stays, by a hash of its text. Documents without
    words all stay, and so do documents without an id; of repeated rows (same id and text) one
    stays.
    """
    labelled = written(_labelled(docs, k, num, den, id_col, text_col).select("doc_id", "row", "n", "root"), "join-labelled")
    first = labelled.where("n > 0 AND doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias("__row")).union(labelled.where("n = 0 OR doc_id IS NULL").select("row")).distinct()
    found = docs.withColumn("__row", row_key(id_col, text_col)).join(kept, "__row", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    found = found.withColumn("__nth", F.when(F.col(id_col).isNull(), 1).otherwise(nth))
    return found.where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
