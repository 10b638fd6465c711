"""Benchmark decontamination over item-sized windows.

A document leaks an item where a window of the item's length holds at least ``threshold`` of the
item's weight in word shingles (a shingle weighs as often as it stands in the item). The windows
to look at are those that end at a shared shingle and hold enough of them: the first of a
document's best windows ends at one or starts at 0, since moving it back by a word would lose
nothing otherwise. So no window that could be the result is left out, in whatever order the
item's parts stand. All are verified exactly on their shingles.

SimHash in Hamming blocks, the method dealt for this operator, does not find the windows: at a
similarity of 0.8 hashes differ in 13 of 64 bits on average with a deviation of 3.2, so a radius
of 24 bits is needed, cut into 25 blocks of 2 or 3 bits, and of unrelated hashes 99.3 % agree on
one of those (calculated): nearly all windows would meet all items. Nor does it drop any; the
distance of the hashes is reported with each result.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing; items of fewer words than a
shingle are one shingle of their own length; null and wordless texts and items match nothing;
items that repeat match each; a document reports each item once, at its best window (the first of
equals); null ids are carried along; repeated rows (same id and text) give one result; empty
tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, row_key, small_or_not, word_array, written

def grams_of(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, by position."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(hashed, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def simhash(grams: Column) -> Column:
    """64 bits: each is set where the shingles' hashes have it set more often than not."""
    total = F.size(grams)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, b: acc.bitwiseOR(
            F.when(
                F.aggregate(grams, F.lit(0), lambda a, g: a + F.getbit(g, b).cast("int")) * 2 > total,
                F.call_function("shiftleft", F.lit(1).cast("long"), b),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance and similarity of each leaked item."""
    bench = items.select(F.col(item_col).alias("item_id"), word_array(F.lower(F.col(item_text_col))).alias("words"))
    bench = bench.where(F.size("words") > 0).withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    lengths = [r[0] for r in bench.select(F.least(F.size("words"), F.lit(k))).distinct().collect()]
    found = None
    for length in sorted(lengths):
        mine = bench.where(F.least(F.size("words"), F.lit(k)) == length)
        part = _leaks(docs, mine, length, threshold, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}"
        found = docs.sparkSession.createDataFrame([], f"uid struct<a:bigint,b:bigint>, {kinds}, start_word int, n_words int, distance int, similarity double")
    return found


def _leaks(docs: DataFrame, bench: DataFrame, k: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    bench = bench.select("item", "item_id", F.size("words").alias("n_words"), grams_of(F.col("words"), k).alias("item_grams"))
    bench = written(bench, "leak-items")
    places = bench.select("item", F.explode(F.array_distinct("item_grams")).alias("gram"))

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("uid", row_key("doc_id", "text"))
    # The words are a column of their own: inside a lambda they would be split again for each word.
    keyed = keyed.withColumn("words", word_array(F.lower(F.col("text"))))
    each = keyed.select("uid", F.posexplode(grams_of(F.col("words"), k)).alias("at", "gram"))
    hits = written(each.join(small_or_not(places), "gram").select("uid", "item", "at").distinct(), "leak-hits")

    # A window weighs no more than it has shared shingles: of those that end at one, the window
    # is wanted if the place so many shared shingles before is in it too.
    sizes = bench.select("item", F.size("item_grams").alias("total"))
    sizes = sizes.withColumn("needed", F.greatest(F.ceil(F.lit(threshold) * F.col("total") - 1e-9), F.lit(1)).cast("int"))
    shared = hits.groupBy("uid", "item").agg(F.array_sort(F.collect_list("at")).alias("ats")).join(small_or_not(sizes), "item")
    ends = F.filter("ats", lambda at, i: (i >= F.col("needed") - 1) & (F.get("ats", i - F.col("needed") + 1) > at - F.col("total")))
    starts = F.array_distinct(F.transform(ends, lambda at: F.greatest(at - F.col("total") + 1, F.lit(0))))
    starts = written(shared.select("uid", "item", F.explode(starts).alias("start")), "leak-windows")

    texts = keyed.join(small_or_not(starts.select("uid").distinct()), "uid")
    texts = texts.dropDuplicates(["uid"])
    texts = texts.select("uid", "doc_id", grams_of(F.col("words"), k).alias("grams"))
    windows = starts.join(texts, "uid").join(small_or_not(bench, "item_grams"), "item")
    windows = windows.withColumn("window", F.slice("grams", F.col("start") + 1, F.size("item_grams")))
    counted = F.aggregate(
        F.array_distinct("item_grams"),
        F.lit(0),
        lambda a, g: a + F.least(F.size(F.filter("item_grams", lambda x: x == g)), F.size(F.filter("window", lambda x: x == g))),
    )
    # Where one side repeats no shingle, each shared one counts once.
    plain = [F.size(F.array_distinct(c)) == F.size(c) for c in ("item_grams", "window")]
    held = F.when(plain[0] | plain[1], F.size(F.array_intersect("item_grams", "window"))).otherwise(counted)
    pairs = windows.withColumn("similarity", held / F.size("item_grams").cast("double")).where(F.col("similarity") >= threshold)
    best = pairs.groupBy("uid", "item").agg(
        F.max(F.struct("similarity", F.negative("start").alias("back"), "doc_id", "item_id", "n_words", "window", "item_grams")).alias("b")
    )
    distance = F.bit_count(simhash(F.col("b.window")).bitwiseXOR(simhash(F.col("b.item_grams")))).cast("int")
    return best.select("uid", "b.doc_id", "b.item_id", F.negative("b.back").cast("int").alias("start_word"), "b.n_words", distance.alias("distance"), "b.similarity")


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, in the columns of ``docs``."""
    bad = leaks(docs, items, **options).select(F.col("uid").alias("__uid")).distinct()
    keyed = docs.withColumn("__uid", row_key("doc_id", "text"))
    return keyed.join(small_or_not(written(bad, "leak-documents")), "__uid", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
