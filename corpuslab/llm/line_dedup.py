"""Removal of repeated runs of lines by winnowing.

A document's lines are hashed. At every line starts a gram: the fewest lines from it on that hold
``gram_words`` words. Of the grams that start within any ``window_words`` words, the one with the
smallest hash is a fingerprint (the last of equals), so two copies of a run of
``gram_words + window_words`` words or more share a fingerprint wherever they stand. Fingerprints
are joined with their first position in the collection (by id, then line); the two documents are
laid over each other at that offset, the match is extended both ways to the longest run of equal
lines, and runs of at least ``gram_words`` words are deleted from the later document. First
occurrences are kept, so every deleted passage remains once.

The first position of a fingerprint may hold a part of the passage only, and the rest stand first
elsewhere. So in the documents that share a fingerprint, all grams are joined with their first
positions too, both those that start at a line and those that end at one: these cover every line
of every run of ``gram_words`` words or more, whichever document holds it first. Together, each
line with words in a run of ``gram_words + window_words`` words that stands earlier is deleted.
Wordless lines at the ends of a run go where the first position of a fingerprint has them.

Each gram is matched with its first position only, so a passage in a third of all
documents makes as many rows as it has copies, and joins on it can be split by Spark at will.

Defined cases: null texts stay null with no lines; empty texts have one empty line; empty lines
match each other but carry no words, so they go only inside a longer run; a document's own
repeats count, the first stays; null ids sort first; repeated rows (same id and text) get the
same result, as one document; an empty table gives no rows. Only the id and text columns are read
and other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import removed, row_key, word_array, written


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct document: id, uid, and per line its hash and words."""
    lines = F.split(F.col(text_col), "\n", -1)
    return docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("uid"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(lines, lambda x: F.size(word_array(x))).alias("words"),
    ).dropDuplicates(["uid"])


def fingerprints(lines: DataFrame, gram_words: int, window_words: int) -> DataFrame:
    """uid, doc_id, line and gram hash of the selected grams.

    A line's place is the number of words before it; frames are ranges of places. Lines without
    words start no gram.
    """
    each = lines.select("doc_id", "uid", F.posexplode(F.arrays_zip("hashes", "words")).alias("line", "x"))
    each = each.select("doc_id", "uid", "line", F.col("x.hashes").alias("h"), F.col("x.words").cast("long").alias("n")).where("n > 0")
    before = Window.partitionBy("uid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    gram = Window.partitionBy("uid").orderBy("place").rangeBetween(0, gram_words - 1)
    placed = placed.withColumn("gram", F.xxhash64(F.collect_list("h").over(gram))).withColumn("held", F.sum("n").over(gram))
    # The tail of a document, too short for a gram, starts none.
    placed = placed.where(F.col("held") >= gram_words)
    ahead = Window.partitionBy("uid").orderBy("place").rangeBetween(0, window_words - 1)
    best = F.min(F.struct(F.col("gram"), F.negative("line").alias("at"))).over(ahead)
    chosen = placed.select("doc_id", "uid", best.alias("best"))
    return chosen.select("doc_id", "uid", F.col("best.gram").alias("gram"), F.negative("best.at").alias("line")).distinct()


def later_grams(lines: DataFrame, gram_words: int) -> tuple[DataFrame, DataFrame]:
    """The table of all grams, and uid, first_line, last_line, and the first place, of each gram of a document that stands earlier.

    Grams are the fewest lines from a line on, or up to a line, that hold ``gram_words`` words, with
    the wordless lines between.
    """
    each = lines.select("doc_id", "uid", F.posexplode(F.arrays_zip("hashes", "words")).alias("line", "x"))
    each = each.select("doc_id", "uid", "line", F.col("x.hashes").alias("h"), F.col("x.words").cast("long").alias("n"))
    before = Window.partitionBy("uid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("nth", F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(before), F.lit(0)))
    # A line with words, and the wordless ones right before it.
    block = each.groupBy("uid", "nth").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("line", "h", "n"))).alias("held"))
    last = F.element_at("held", -1)
    block = block.select("doc_id", "uid", last["line"].alias("line"), last["h"].alias("h"), last["n"].alias("n"), F.xxhash64(F.col("held.h")).alias("g"))
    block = block.where("n > 0")
    placed = block.withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("after", F.col("place") + F.col("n"))
    found = None
    for frame in (
        Window.partitionBy("uid").orderBy("place").rangeBetween(0, gram_words - 1),
        Window.partitionBy("uid").orderBy("after").rangeBetween(1 - gram_words, 0),
    ):
        gram = placed.select(
            "doc_id", "uid", F.min("line").over(frame).alias("first_line"), F.max("line").over(frame).alias("last_line"),
            F.sum("n").over(frame).alias("n_words"), F.first("h").over(frame).alias("h"), F.collect_list("g").over(frame).alias("gs"),
        ).where(F.col("n_words") >= gram_words)
        # What stands right before its first line is no part of a gram.
        gram = gram.withColumn("gram", F.xxhash64("h", F.slice("gs", 2, F.greatest(F.size("gs") - 1, F.lit(0))))).drop("h", "gs")
        found = gram if found is None else found.union(gram)
    grams = written(found.distinct(), "dedup-grams")
    first = grams.groupBy("gram").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "uid", "first_line")).alias("first")).where("copies > 1")
    first = first.select("gram", F.col("first.doc_id").alias("of_id"), F.col("first.uid").alias("of_uid"), F.col("first.first_line").alias("of_line"))
    met = grams.join(first, "gram").where((F.col("uid") != F.col("of_uid")) | (F.col("first_line") != F.col("of_line")))
    return grams, met.select("uid", "first_line", "last_line", "of_id", "of_line", "n_words")


def repeated_runs(docs: DataFrame, gram_words: int = 25, window_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, first_line, last_line, and the run's first place (of_id, of_line), of each later run or gram."""
    lines = written(line_table(docs, id_col, text_col), "dedup-lines")
    prints = written(fingerprints(lines, gram_words, window_words), "dedup-prints")
    first = prints.groupBy("gram").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "uid", "line")).alias("first")
    ).where("copies > 1")
    first = first.select("gram", F.col("first.doc_id").alias("of_id"), F.col("first.uid").alias("of_uid"), F.col("first.line").alias("of_line"))
    met = prints.join(first, "gram").where((F.col("uid") != F.col("of_uid")) | (F.col("line") != F.col("of_line")))
    diagonals = written(met.select("uid", "of_id", "of_uid", (F.col("line") - F.col("of_line")).alias("offset")).distinct(), "dedup-diagonals")

    mine = lines.select("uid", "hashes", "words")
    theirs = lines.select(F.col("uid").alias("of_uid"), F.col("hashes").alias("of_hashes"))
    laid = diagonals.join(mine, "uid").join(theirs, "of_uid")
    start = F.greatest(F.col("offset"), F.lit(0))
    stop = F.least(F.size("hashes"), F.size("of_hashes") + F.col("offset"))
    places = F.sequence(start, stop - 1)
    unlike = F.filter(places, lambda i: F.get(F.col("hashes"), i) != F.get(F.col("of_hashes"), i - F.col("offset")))
    # Runs lie between neighbouring unlike lines, with the overlap's ends as borders.
    borders = F.concat(F.array(start - 1), unlike, F.array(stop))
    laid = laid.withColumn("borders", borders)
    runs = F.transform(
        F.sequence(F.lit(1), F.size("borders") - 1),
        lambda b: F.struct((F.get(F.col("borders"), b - 1) + 1).alias("first_line"), (F.get(F.col("borders"), b) - 1).alias("last_line")),
    )
    runs = F.filter(runs, lambda r: r["first_line"] <= r["last_line"])
    runs = laid.select("uid", "of_id", "offset", "words", F.explode(runs).alias("run"))
    size = F.aggregate(F.slice("words", F.col("run.first_line") + 1, F.col("run.last_line") - F.col("run.first_line") + 1), F.lit(0), lambda a, n: a + n)
    runs = runs.withColumn("n_words", size).where(F.col("n_words") >= gram_words)
    runs = runs.select(
        "uid", F.col("run.first_line").alias("first_line"), F.col("run.last_line").alias("last_line"), "of_id",
        (F.col("run.first_line") - F.col("offset")).alias("of_line"), "n_words",
    )
    sharing = diagonals.select("uid").union(diagonals.select(F.col("of_uid").alias("uid"))).distinct()
    grams, later = later_grams(lines.join(sharing, "uid", "left_semi"), gram_words)
    found = written(runs.unionByName(later), "dedup-found")
    removed(lines, prints, diagonals, grams)
    return found


def merged(runs: DataFrame) -> DataFrame:
    """uid, first_line and last_line of runs that overlap or touch, as one."""
    order = Window.partitionBy("uid").orderBy("first_line", "last_line")
    before = F.max("last_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("uid", "first_line", "last_line").distinct().withColumn("starts", F.coalesce(F.col("first_line") > before + 1, F.lit(True)).cast("int"))
    groups = starts.withColumn("nth", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("uid", "nth")
    return groups.agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line")).drop("nth")


def dedup_lines(docs: DataFrame, gram_words: int = 25, window_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without later repeats, and the deleted lines of each row."""
    runs = merged(repeated_runs(docs, gram_words, window_words, id_col, text_col))
    spans = F.collect_set(F.struct("first_line", "last_line"))
    gone = written(runs.groupBy("uid").agg(F.array_sort(spans).alias("runs")), "dedup-runs")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Runs grow with the documents, so both sides are always dealt by document.
    keyed = keyed.withColumn("uid", row_key("doc_id", "text")).join(gone.hint("merge"), "uid", "left")
    return keyed.select("doc_id", *cut(F.col("text"), F.col("runs")))


def cut(text: Column, runs: Column) -> list[Column]:
    """The kept text, the number of lines and the deleted lines, by number from 0."""
    lines = F.split(text, "\n", -1)
    spans = F.coalesce(runs, F.array().cast("array<struct<first_line:int,last_line:int>>"))
    deleted = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda r: F.sequence(r["first_line"], r["last_line"])))))
    marked = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.exists(spans, lambda r: (r["first_line"] <= i) & (i <= r["last_line"])).alias("gone")))
    kept = F.array_join(F.transform(F.filter(marked, lambda m: ~m["gone"]), lambda m: m["x"]), "\n")
    return [
        F.when(F.size(spans) == 0, text).otherwise(kept).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        deleted.alias("deleted_lines"),
    ]
