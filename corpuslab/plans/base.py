"""The registry: each query is a function of (spark, sf_dir), with its oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dealt over all cores, for work that is bound by text processing.

    Only a table of fewer files than there are cores is dealt anew.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Texts that exercise every cleaning step; ids below 0 keep them apart from documents.
SAMPLES = (
    (-1, "Mail bob.smith@example.com or a|b@x.org now, call +1 (555) 123-4567 or 555-123-4567 today."),
    (-2, "See https://example.com/a?b=1&c=2#x and HTTP://EXAMPLE.ORG/path, then stop."),
    (-3, "As shown [1], [2, 3] and [4-6] by (Smith 2024), (Smith et al., 2020a), (Smith and Jones, 1999) and [Smith2024]."),
    (-4, "Intro text here\n\n42\n\nMore content\n   15   \nThere are 42 items in the list."),
    (-5, "short header\nThis line is long enough to be kept in any case, surely.\n\nx\nAnother line that is long enough to be kept as well."),
    (-6, "  many   spaces\tand\n\nlines  "),
    (-7, "“quoted” ‘single’ en–dash em—dash dots… nbsp x ﻿bom"),
    (-8, "Keep `x@y.com` and ```code https://a.b/c``` but not z@y.com"),
    (-9, ""),
)


def with_samples(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(SAMPLES, "doc_id long, text string"))


SAMPLE_SQL = "WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(x)})" for i, x in SAMPLES) + ") v(doc_id, text)) "
