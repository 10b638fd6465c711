"""Sinks: collections of chunks, versions of data sets, run exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed_places


def upsert_collection(chunks: DataFrame, path: str, collection: str, key: str = "chunk_id") -> None:
    """Writes chunks that have an embedding into a collection; those of the same key are replaced.

    Of chunks with the same key in one batch one stays, that whose row has the smallest hash.
    """
    spark = chunks.sparkSession
    good = _first_of_each(chunks.where(F.col("embedding").isNotNull()), key)
    if not exists(spark, f"{path}/collection={collection}"):
        return replace_collection(good, path, collection)
    old = read_collection(spark, path, collection).drop("collection").join(good.select(key), key, "left_anti")
    _swap(old.unionByName(good), path, collection)


def _first_of_each(chunks: DataFrame, key: str) -> DataFrame:
    least = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[F.to_json(F.struct("*"))])))
    return chunks.withColumn("__nth", least).where("__nth = 1").drop("__nth")


def replace_collection(chunks: DataFrame, path: str, collection: str) -> None:
    """A collection's partition with these chunks alone; other collections stay, and so does nothing of this one where there are none."""
    _swap(chunks.where(F.col("embedding").isNotNull()), path, collection)


def delete_from_collection(spark: SparkSession, path: str, collection: str, gone: DataFrame, key: str = "chunk_id") -> None:
    """Drops the chunks whose key is in ``gone``."""
    _swap(read_collection(spark, path, collection).drop("collection").join(gone.select(key), key, "left_anti"), path, collection)


def _swap(chunks: DataFrame, path: str, collection: str) -> None:
    """Writes a collection aside (it cannot be read and overwritten at once), then puts it in the place of the old one.

    An empty collection is a folder with an empty file, so that its columns stay known.
    """
    spark = chunks.sparkSession
    staged, place = f"{path}/_staged-{uuid.uuid4().hex}", f"{path}/collection={collection}"
    chunks.drop("collection").write.parquet(staged)
    put_in_place(spark, staged, place)


def put_in_place(spark: SparkSession, staged: str, place: str) -> None:
    """Moves a written folder to a place, whose old contents go."""
    files, (new, old) = _files(spark, place), (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, place))
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{staged} could not be moved to {place}")


def _files(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def read_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("collection") == collection)


def write_version(pairs: DataFrame, path: str, version: int, published: bool = False) -> int:
    """Writes a version unless the newest has the same contents; published versions are never replaced. Returns the version that holds the pairs."""
    spark = pairs.sparkSession
    rows = [F.to_json(F.struct(*sorted(pairs.columns)))]
    sums = [F.count("*"), F.bit_xor(F.xxhash64(*rows)), F.bit_xor(F.xxhash64(F.lit(7), *rows)), F.sum(F.crc32(*rows))]
    digest = pairs.agg(F.sha2(F.concat_ws("|", *[x.cast("string") for x in sums]), 256)).first()[0]
    manifest = f"{path}/manifest"
    known = spark.read.parquet(manifest).orderBy(F.desc("version")).collect() if exists(spark, manifest) else []
    if known and known[0]["content_hash"] == digest:
        return known[0]["version"]
    if any(r["version"] == version and r["is_published"] for r in known):
        raise ValueError(f"version {version} is published")
    pairs.write.mode("overwrite").parquet(f"{path}/version={version}")
    row = spark.createDataFrame([(version, digest, published)], "version int, content_hash string, is_published boolean")
    row.coalesce(1).write.mode("append").parquet(manifest)
    return version


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    """version, content_hash and is_published of each version; none where nothing was written."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "version int, content_hash string, is_published boolean")
    rows = spark.read.parquet(f"{path}/manifest")
    return rows.groupBy("version").agg(F.max("content_hash").alias("content_hash"), F.bool_or("is_published").alias("is_published"))


def create_version(pairs: DataFrame, path: str) -> int:
    """Writes the next version, unless the newest has the same contents; a published set takes no more."""
    newest = list_versions(pairs.sparkSession, path).agg(F.max("version").alias("version"), F.bool_or("is_published").alias("published")).first()
    if newest["published"]:
        raise ValueError("the data set is published; fork it to change it")
    return write_version(pairs, path, (newest["version"] or 0) + 1)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The pairs of a version, the newest by default."""
    known = list_versions(spark, path)
    newest = known.agg(F.max("version")).first()[0]
    if newest is None or (version is not None and known.where(F.col("version") == version).isEmpty()):
        raise ValueError(f"version {version} not found" if newest else "no versions exist")
    return spark.read.parquet(f"{path}/version={version or newest}")


def publish(spark: SparkSession, path: str) -> int:
    """Marks the newest version as published, for good."""
    newest = list_versions(spark, path).orderBy(F.desc("version")).first()
    if newest is None:
        raise ValueError("no versions exist")
    row = spark.createDataFrame([(newest["version"], newest["content_hash"], True)], "version int, content_hash string, is_published boolean")
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return newest["version"]


def fork(spark: SparkSession, path: str, new_path: str, version: int | None = None) -> int:
    """A version's pairs as the first version of another data set."""
    return create_version(read_version(spark, path, version), new_path)


def run_csv_rows(results: DataFrame) -> DataFrame:
    """A run's result rows as they are exported: percentages with one place, latency with two."""

    def percent(name: str):
        return F.concat(fixed_places(F.coalesce(F.col(name), F.lit(0.0)) * 100.0, 1), F.lit("%")).alias(name)

    jaccard = F.coalesce(F.nullif(F.coalesce("jaccard", F.lit(0.0)), F.lit(0.0)), F.coalesce("score", F.lit(0.0)))
    return results.select(
        "query", "predicted_answer", "ground_truth", F.concat(fixed_places(jaccard * 100.0, 1), F.lit("%")).alias("jaccard"),
        percent("context_precision"), percent("precision_at_k"), percent("recall_at_k"), fixed_places(F.col("latency"), 2).alias("latency"),
    )
