"""Overlap of item sets with document sets by posting lists, rare elements first.

The elements of the items are numbered, and one pass over the documents writes the posting table:
(doc_id, code) of every element that an item has. Elements that many documents hold ("hot") never
pair items with documents: candidates come of the others, and what candidates share besides is
counted from lists of the hot elements of each document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir
from .joins import small_side

#: Documents that hold an element beyond which it is hot.
HOT = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder: what is used several times is worked out once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Postings:
    """Items (item_id, code) with their elements' document frequencies, and the posting table (doc_id, code, n).

    ``n`` is the size of the document's set, where the documents carry one.
    """

    def __init__(self, items: DataFrame, docs: DataFrame, hot: int = HOT) -> None:
        """items: (item_id, e), each element once; docs: (doc_id, e[, n]), each element once."""
        items = items.where("e IS NOT NULL")
        vocabulary = stored(items.select("e").distinct().withColumn("code", F.monotonically_increasing_id()), "vocabulary")
        self.docs = stored(docs.join(small_side(vocabulary), "e").drop("e"), "postings")
        counts = self.docs.groupBy("code").agg(F.count("*").alias("df"))
        coded = items.join(small_side(vocabulary), "e").join(small_side(counts), "code", "left")
        self.items = stored(coded.select("item_id", "code", F.coalesce("df", F.lit(0)).alias("df"), (F.coalesce("df", F.lit(0)) > hot).alias("hot")), "item-codes")

    def with_shared(self, pairs: DataFrame, codes: DataFrame, out: str) -> DataFrame:
        """``pairs`` (item_id, doc_id, ...) with the number of ``codes`` (item_id, code) that the item's document holds.

        Both sides' codes become lists, the documents' only of codes that are asked for: a list is
        no longer than an item, or than what all items ask for.
        """
        asked = codes.groupBy("item_id").agg(F.collect_list("code").alias("asked"))
        wanted = self.docs.join(small_side(codes.select("code").distinct()), "code", "left_semi")
        wanted = wanted.join(small_side(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
        held = wanted.groupBy("doc_id").agg(F.collect_list("code").alias("held"))
        both = pairs.join(small_side(asked), "item_id", "left").join(held, "doc_id", "left")
        return both.withColumn(out, F.coalesce(F.size(F.array_intersect("asked", "held")), F.lit(0))).drop("asked", "held")


def top_overlaps(items: DataFrame, docs: DataFrame, k: int, hot: int = HOT) -> DataFrame:
    """The ``k`` documents that hold most elements of an item: item_id, doc_id, hits, n_words, rank. Ties go to the smaller id.

    An item with h hot elements is settled by its candidates, the documents that hold one of its
    others, where the k-th best of them has more than h hits: all the rest have h at most. Items
    that are not settled so (nearly all their elements are hot) meet all documents of their elements.
    """
    index = Postings(items, docs, hot)
    sizes = index.items.groupBy("item_id").agg(F.count("*").alias("n_words"), F.count_if("hot").alias("n_hot"))
    order = Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")

    def counted(codes: DataFrame) -> DataFrame:
        return index.docs.join(small_side(codes.select("item_id", "code")), "code").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    rare = counted(index.items.where("NOT hot"))
    hot_codes = index.items.where("hot")
    if hot_codes.isEmpty():
        found = ranked(rare)
    else:
        # Candidates that could still come among the first k, whatever hot elements they hold.
        nth = F.row_number().over(order)
        least = rare.withColumn("nth", nth).where(F.col("nth") == k).select("item_id", F.col("hits").alias("least"))
        some = rare.join(F.broadcast(sizes), "item_id").join(small_side(least), "item_id", "left")
        some = stored(some.where("least IS NULL OR hits + n_hot >= least").select("item_id", "doc_id", "hits", "n_hot"), "candidates")
        whole = index.with_shared(some, hot_codes, "more").withColumn("hits", F.col("hits") + F.col("more"))
        found = stored(ranked(whole.select("item_id", "doc_id", "hits", "n_hot")), "overlaps")
        settled = found.where((F.col("rank") == k) & (F.col("hits") > F.col("n_hot"))).select("item_id")
        open_items = stored(index.items.join(small_side(settled), "item_id", "left_anti"), "open-items")
        found = found.join(small_side(settled), "item_id", "left_semi").drop("n_hot").unionByName(ranked(counted(open_items)))
    return found.join(small_side(sizes.select("item_id", "n_words")), "item_id")


def first_overlaps(items: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """item_id, doc_id and overlap: the first document (by id) that shares ``threshold`` of the smaller of both sets.

    ``docs`` has (doc_id, e, n), n the size of its whole set. A pair must share ``threshold`` of the
    smaller set, rounded up: r elements. So it shares one of the item's elements that are left when
    the r - 1 most frequent are put aside (the item being the smaller set), or of the document's own
    that an item has (the document being smaller). Only those pair items with documents.
    """
    index = Postings(items, docs)
    needed = lambda n: F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("long")
    by_rarity = Window.partitionBy("item_id").orderBy("df", "code")
    sized = index.items.withColumns({"at": F.row_number().over(by_rarity), "na": F.count("*").over(Window.partitionBy("item_id"))})
    sized = stored(sized, "item-prefixes")
    prefix = sized.where(F.col("at") <= F.col("na") - needed(F.col("na")) + 1).select("item_id", "code", "na")
    of_item = index.docs.join(small_side(prefix), "code").where("n >= na").select("item_id", "doc_id", "na", "n")

    longest = sized.agg(F.max("na")).first()[0] or 0
    short = index.docs.where(F.col("n") < longest).join(small_side(index.items.select("code", "df").distinct()), "code")
    of_doc = Window.partitionBy("doc_id")
    short = short.withColumns({"at": F.row_number().over(of_doc.orderBy("df", "code")), "m": F.count("*").over(of_doc)})
    short = short.where(F.col("at") <= F.col("m") - needed(F.col("n")) + 1).select("doc_id", "code", "n")
    of_short = short.join(small_side(sized.select("item_id", "code", "na")), "code").where("n < na").select("item_id", "doc_id", "na", "n")

    pairs = stored(reduce(DataFrame.unionByName, (of_item, of_short)).distinct(), "candidates")
    met = index.with_shared(pairs, index.items.select("item_id", "code"), "hits")
    share = F.col("hits") / F.least("na", "n").cast("double")
    met = met.withColumn("overlap", share).where(F.col("overlap") >= threshold)
    return met.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.round(F.min_by("overlap", "doc_id"), 6).alias("overlap"))
