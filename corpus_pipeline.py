"""A training-data pipeline over ``documents``, stage by stage.

Each stage works on all that the stage before kept, and is written as Parquet in the folder that
driver and executors share before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from corpuslab.llm.common import written

N_SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (a null text, or one without a letter); fills in missing languages.

    A language that is there stays, the prediction decides the missing ones. Where no row has a
    language nothing can be learned, and documents with a letter stay with a null one. Repeated rows
    all stay; an empty table stays empty; columns other than ``lang`` are not touched.
    """
    field = language_id.train(docs, lambda doc_id: F.lit(True))
    if not field.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = language_id.label_documents(docs, field, lang_out="__lang", score_out="__score")
    kept = labelled.where(F.col("__lang") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).drop("__lang", "__score")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    That of the smallest id stays, of equal ids the one whose text has the smallest hash. Null and
    wordless texts link with nothing and stay, as do documents without an id; of repeated rows one
    stays. An empty table stays empty; columns of any name are kept.
    """
    return jaccard_join.keep_one(docs, k=5, num=4, den=5)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and items match nothing; all repeats of a row go or stay together; an empty
    table, or no items, drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the sources' weights; a document stands as often as it is taken.

    A null source is one source. Texts without words weigh nothing and are not taken; repeated rows
    are taken alike; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of every document of the mix.

    Null texts count as empty; repeated rows have places of their own; an empty table gives no rows.
    """
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", join_near_duplicates),
    ("decontaminate", remove_benchmarks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The trained language model and the shingle join have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
