"""A stored index for substring search: posting lists of trigrams, which prune before texts are read.

A text that contains a pattern holds all the pattern's trigrams. The lists of the rarest few are
read (each lies in the folder of its bucket, sorted by trigram, so that other lists are skipped),
their documents' texts are searched, and no others. Case is ignored, as ``lower`` folds it.

Patterns under three characters have no trigram, and patterns of common trigrams alone prune
nothing; for both all texts are searched.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .curate import gram_rows
from .postings import stored

#: Folders of posting lists.
BUCKETS = 64
#: Lists that a search reads, at most.
LISTS = 4
#: A list of more than this share of the documents prunes too little to be read.
MOST_SHARE = 0.25


def bucket_of(gram: Column) -> Column:
    return (F.crc32(gram) % BUCKETS).cast("int")


class SubstringIndex:
    """The index at a path, over the documents (id and text) it was built of."""

    def __init__(self, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.path, self.id_col, self.text_col = docs, path, id_col, text_col
        self.n_docs = self.spark.read.parquet(f"{path}/size").first()["n"]

    @classmethod
    def create(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> SubstringIndex:
        grams = gram_rows(docs, id_col, F.lower(text_col), 3).withColumnRenamed(id_col, "doc_id").withColumn("bucket", bucket_of(F.col("gram")))
        lists = grams.repartition("bucket", "gram").sortWithinPartitions("bucket", "gram", "doc_id")
        lists.write.partitionBy("bucket").parquet(f"{path}/lists")
        written = docs.sparkSession.read.parquet(f"{path}/lists")
        written.groupBy("bucket", "gram").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
        docs.agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/size")
        return cls(docs, path, id_col, text_col)

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        """A table's rows of some trigrams: their buckets' folders alone, and their row groups."""
        buckets = sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def candidates(self, pattern: str) -> DataFrame | None:
        """doc_id of the documents that hold the rarest of a pattern's trigrams; None where those would prune too little."""
        grams = sorted({pattern[i : i + 3] for i in range(len(pattern) - 2)})
        if not grams:
            return None
        known = {r["gram"]: r["df"] for r in self._of("counts", grams).collect()}  # a row for each trigram of the pattern
        rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:LISTS]
        rarest = [g for g in rarest if known.get(g, 0) <= MOST_SHARE * self.n_docs]
        if not rarest:
            return None
        held = self._of("lists", rarest).groupBy("doc_id").agg(F.count("*").alias("n"))
        return held.where(F.col("n") == len(rarest)).select(F.col("doc_id").alias(self.id_col))

    def search(self, pattern: str) -> DataFrame:
        """The documents that contain the pattern, in any case."""
        pattern = self.spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first()["p"]
        some = self.candidates(pattern)
        found = self.docs if some is None else self.docs.join(some, self.id_col, "left_semi")
        return found.where(F.contains(F.lower(self.text_col), F.lit(pattern))) if pattern else found

    def page(self, pattern: str, offset: int = 0, limit: int = 20, most_chars: int = 2000) -> DataFrame:
        """A page of the matches by id: id, content (up to ``most_chars``), full_length and total, the number of all matches.

        Candidates' texts are searched once, for the ids of the matches; then only the page's are read.
        """
        ids = stored(self.search(pattern).select(self.id_col), "matches")
        rows = ids.orderBy(self.id_col).offset(offset).limit(limit).collect()  # no more than a page
        texts = self.docs.where(F.col(self.id_col).isin([r[self.id_col] for r in rows]))
        page = texts.select(self.id_col, F.substring(self.text_col, 1, most_chars).alias("content"), F.length(self.text_col).cast("long").alias("full_length"))
        return page.withColumn("total", F.lit(ids.count()).cast("long"))
