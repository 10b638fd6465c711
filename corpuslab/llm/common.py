"""Helpers that several operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


#: Rows of a file where ``written`` is told their number, and up to how many it deals them out for that.
ROWS_A_FILE, MOST_DEALT = 50_000, 4_000_000


def written(df: DataFrame, name: str, about: int | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it again.

    A lost executor then costs a re-read of the table, never the work before it. Where the number
    of rows is known (``about``), small tables of narrow rows are dealt into few files, however many
    the shuffle partitions. (``coalesce`` would run the work before in those few tasks, each of which
    keeps the sort buffers of all its partitions.)
    """
    if about is not None and about <= MOST_DEALT:
        df = df.repartition(-(-about // ROWS_A_FILE) or 1)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def removed(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hands Python ``rows`` rows at a time while the block runs, for rows that hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Whole texts that Python gets at a time.
TEXTS_PER_BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on hands Python ``TEXTS_PER_BATCH`` rows at a time at most: a lazy result is planned later, by its user."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def arrow_udf(function, kind: str):
    """A Pandas UDF that runs once for each row.

    Spark copies a deterministic one into each filter on its result and runs it there again, in a
    second set of Python workers.
    """
    return F.pandas_udf(function, kind).asNondeterministic()


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished work now.

    Spark removes a shuffle's files once the driver's garbage collector has found its plan unused,
    which may be long after; between steps that shuffle much, disk would hold all of them at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, JVM-side; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def literal_array(values, kind: str) -> Column:
    """A constant array column; the optimizer folds it, so rows share one copy."""
    return F.from_json(F.lit("[" + ",".join(str(v) for v in values) + "]"), f"array<{kind}>")


def row_key(*columns: Column | str) -> Column:
    """128 bits that name a row by these columns, as two hashes that differ from the first byte on."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


#: Bytes of a side that is broadcast, at most.
BROADCAST_BYTES = 32_000_000


def small_or_not(df: DataFrame, *arrays: str) -> DataFrame:
    """Marked for broadcast if its size, worked out from its rows and the lengths of these arrays, is small; Spark joins by shuffle beyond.

    ``df`` should be a table that is written, or made of one: it is read once more for this.
    """
    held = [F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0)) for c in arrays]
    n_rows, *n_elements = df.agg(F.count("*"), *held).first()
    size = n_rows * 24 * (len(df.columns) + 1) + 8 * sum(n_elements)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
