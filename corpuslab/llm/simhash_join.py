"""SimHash near-duplicates within a Hamming radius, by tables of distances to reference fingerprints.

The references are the 64 Hadamard words; each fingerprint's distances to all of them are worked out
once and go with it. By the triangle inequality two fingerprints differ by no more in any of these
coordinates than from each other. Only distinct fingerprints are joined; copies are one.

1. Search: a linked pair (at most 4 bits apart) differs by at most 2 bits in one half, so there is a
   reference at most 1 bit from both in that half: a fingerprint gives its two halves and the words
   1 bit from each, 66 references, and those that share one share a block. No link is lost.
2. In a block of up to ``BLOCK`` fingerprints, pairs whose largest coordinate difference is beyond
   the radius are discarded, and the survivors verified. A block gives a spanning forest of its
   links, so rows and comparisons are bounded for each member.
3. In larger blocks no pairs are looked at. Two linked fingerprints have a reference halfway: at most
   2 bits from both, and differing from each in bits that differ within the block. Two that share
   one are linked, by the triangle inequality again. So each gives the references around it, 2081
   at most, and every one that several share links them with the least of them. The work grows in
   proportion to the fingerprints however large a block is.
4. Links are joined to components.

Unrelated fingerprints share a block with a chance of 2.5e-7, so each meets one other in four
million; blocks of more than ``BLOCK`` by chance need billions of them, and step 3 then takes them.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer words
than a shingle is one shingle; null and wordless texts have the fingerprint zero and link like any
other; a null id never names a component that has another; repeated rows all stay; an empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, arrow_udf, removed, small_batches, small_or_not, written
from .components import connected_components

SEED = 42
#: Fingerprints of a block that are compared with each other.
BLOCK = 256
#: Keys that a task makes, on average.
KEYS_PER_TASK = 500_000
#: Hashes whose bits are counted at a time, so that memory does not follow the length of a text.
HASHES_AT_A_TIME = 1 << 15

BITS, HALF = 64, 32
#: Row i holds the bits of reference i: the parities of i & j.
REFERENCES = np.array([[(i & j).bit_count() & 1 for j in range(BITS)] for i in range(BITS)], np.float32)


def fingerprint(text: str | None, k: int) -> int:
    """The SimHash of a text's k-word shingles, repeats included: bits set in over half of the hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_A_TIME):
        upto = min(n, at + HASHES_AT_A_TIME)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans), np.uint64, upto - at)
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(np.int64)[0])


def bits_of(prints: np.ndarray) -> np.ndarray:
    """One row of 64 bits, the lowest first, for each fingerprint."""
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), bitorder="little").reshape(-1, 64)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the references, as bytes."""
    return (bits_of(prints).astype(np.float32) @ (1 - 2 * REFERENCES.T) + REFERENCES.sum(axis=1)).astype(np.uint8)


def block_keys(fingerprint: Column) -> Column:
    """The references at most 1 bit from either half of a fingerprint: bit 32 tells the half."""
    one_bit = [0, *(1 << i for i in range(HALF))]
    halves = (fingerprint.bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(fingerprint, HALF).bitwiseOR(F.lit(1 << HALF)))
    return F.array(*[half.bitwiseXOR(F.lit(b).cast("long")) for half in halves for b in one_bit])


def linked(prints: np.ndarray, tables: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints of a block are within the radius of which."""
    near = np.ones((len(prints), len(prints)), bool)
    for coordinate in tables.T.astype(np.int16):
        near &= np.abs(coordinate[:, None] - coordinate[None, :]) <= radius
    x, y = np.nonzero(np.triu(near, 1))
    within = np.bitwise_count(prints[x].view(np.uint64) ^ prints[y].view(np.uint64)) <= radius
    near[:] = False
    near[x[within], y[within]] = near[y[within], x[within]] = True
    return near


def spanning_links(prints: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that links join, one for each fingerprint at most."""
    found, new = [], np.ones(len(prints), bool)
    for start in range(len(prints)):
        if not new[start]:
            continue
        new[start], waiting = False, [start]
        while waiting:
            x = waiting.pop()
            for y in np.flatnonzero(near[x] & new).tolist():
                new[y] = False
                waiting.append(y)
                found.append((int(prints[y]), int(prints[x])))
    return found


def references_around(fingerprint: int, mask: int, radius: int) -> np.ndarray:
    """All words that differ from a fingerprint in at most ``radius`` (0 to 2) bits of the mask."""
    one = np.uint64(1) << np.flatnonzero(bits_of(np.array([mask], np.int64))[0]).astype(np.uint64)
    flips = [np.zeros(1, np.uint64)]
    if radius > 0:
        flips.append(one)
    if radius > 1:
        i, j = np.triu_indices(len(one), 1)
        flips.append(one[i] | one[j])
    return (np.concatenate(flips) ^ np.array([fingerprint], np.int64).view(np.uint64)).view(np.int64)


def _fingerprinter(k: int):
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return arrow_udf(of, "long")


def _tables():
    def of(prints: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in distance_table(prints.to_numpy(np.int64))])

    return arrow_udf(of, "binary")


def _links_of(radius: int):
    """The spanning links of each block, given as lists of its fingerprints and their tables."""

    def of(blocks: pd.Series, tables: pd.Series) -> pd.Series:
        found = []
        for prints, table in zip(blocks, tables):
            prints = np.asarray(prints, np.int64)
            near = linked(prints, np.frombuffer(b"".join(table), np.uint8).reshape(-1, BITS), radius)
            found.append([{"x": x, "y": y} for x, y in spanning_links(prints, near)])
        return pd.Series(found)

    return arrow_udf(of, "array<struct<x: long, y: long>>")


def _around(radius: int):
    def around(prints: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([references_around(f, m, radius) for f, m in zip(prints, masks)])

    return arrow_udf(around, "array<long>")


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest id reachable by links) of each row.

    Texts link when their fingerprints differ in at most ``radius`` bits, 2 or 4.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with small_batches(spark, TEXTS_PER_BATCH):
        rows = written(named.select("doc_id", _fingerprinter(k)("text").alias("print")), "simhash-rows")
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("n")), "simhash-prints")
    roots = connected_components(links(prints.select("print"), radius), "x", "y")
    joined = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").where("n > 1 OR root IS NOT NULL")
    joined = joined.withColumn("root", F.coalesce("root", "print"))
    least = joined.groupBy("root").agg(F.min("min_id").alias("component_id"))
    # A fingerprint of one row and without links is its own component and needs no join.
    named = written(joined.join(least, "root").select("print", "component_id"), "simhash-components")
    removed(prints)
    found = rows.join(small_or_not(named), "print", "left")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Links x, y between distinct fingerprints (column ``print``) that join all that are within the radius of each other.

    Every row is a pair within the radius; those of a block are a spanning forest of its links.
    """
    if radius not in (2, 4):
        raise ValueError("the radius must be 2 or 4")
    spark = prints.sparkSession
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-prints.count() * 66 // KEYS_PER_TASK))
    tables = prints.repartition(n_tasks, "print").withColumn("distances", _tables()("print"))
    tables = written(tables, "simhash-tables")
    placed = tables.withColumn("key", F.explode(block_keys(F.col("print"))))
    shared = placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(shared, "simhash-shared")
    members = written(placed.join(small_or_not(shared.select("key")), "key"), "simhash-members")
    removed(tables, shared)

    differing = F.expr("bit_or(print) & ~bit_and(print)").alias("mask")
    blocks = members.groupBy("key").agg(F.count("*").alias("size"), differing, F.bit_xor(F.xxhash64("print")).alias("of"))
    # Blocks of the same members are one block.
    blocks = blocks.groupBy("size", "mask", "of").agg(F.min("key").alias("key"))
    blocks = written(blocks.select("key", "size", "mask"), "simhash-blocks")
    small = members.join(small_or_not(blocks.where(F.col("size") <= BLOCK).select("key")), "key")
    small = small.groupBy("key").agg(F.collect_list(F.struct("print", "distances")).alias("m"))
    with small_batches(spark, TEXTS_PER_BATCH):
        near = small.select(F.explode(_links_of(radius)("m.print", "m.distances")).alias("l")).select("l.*").distinct()
        found = [written(near, "simhash-near")]
    large = members.select("key", "print").join(small_or_not(blocks.where(F.col("size") > BLOCK).select("key", "mask")), "key")
    large = written(large.groupBy("print").agg(F.bit_or("mask").alias("mask")), "simhash-large")
    if not large.isEmpty():
        found.append(written(_halfway(large, radius), "simhash-halfway"))
    removed(members, blocks, large)
    return found[0] if len(found) == 1 else found[0].union(found[1])


def _halfway(large: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints that share a reference halfway between them, with the least that shares it."""
    with small_batches(large.sparkSession, TEXTS_PER_BATCH):
        around = large.select(F.col("print").alias("x"), F.explode(_around(radius // 2)("print", "mask")).alias("z"))
        shared = around.groupBy("z").agg(F.min("x").alias("y"), F.max("x").alias("top")).where("y < top").select("z", "y")
        shared = written(shared, "simhash-shared")
        found = written(around.join(small_or_not(shared), "z").where("x <> y").select("x", "y").distinct(), "simhash-links")
    removed(shared)
    return found
