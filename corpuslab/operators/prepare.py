"""Preparation of documents, from files to chunks with vectors: load, clean, enrich, save, chunk, embed, write."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import docmeta, text
from ..sources import files, sinks
from . import chunking
from .postings import stored
from .retrieval import Embedder, config_hash, embed


@dataclass(frozen=True)
class PrepareConfig:
    """What is done to the documents. Without ``chunking`` they are only saved, to be chunked later."""

    collection: str
    clean_steps: tuple[str, ...] = ("page_numbers", "short_lines", "html", "unicode", "urls", "citations", "pii", "whitespace")
    enrich: tuple[str, ...] = ("statistics", "language")
    chunking: chunking.ChunkConfig | None = field(default_factory=chunking.ChunkConfig)

    def name(self) -> str:
        """Under which prepared tables of this configuration are kept."""
        parts = self.chunking and (self.chunking.method, self.chunking.size, self.chunking.overlap)
        return config_hash({"collection": self.collection, "clean": self.clean_steps, "enrich": self.enrich, "chunking": parts})


STEPS = {
    "page_numbers": text.strip_page_numbers, "short_lines": text.strip_short_lines, "html": text.strip_html, "unicode": text.normalize_unicode, "urls": text.strip_urls,
    "citations": text.strip_citations, "pii": lambda c: text.remove_pii(c, redact=False), "whitespace": text.squeeze_whitespace,
}


def load(spark: SparkSession, path: str | list[str], pages_of=None) -> tuple[DataFrame, DataFrame]:
    """Documents (source, file_type, content) of a folder, and the files that could not be taken (source, error)."""
    return files.read_documents(spark, path, pages_of)


def clean(docs: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """The steps in order; documents that are blank after them are dropped."""
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown cleaning steps {sorted(unknown)}")
    for step in steps:
        docs = docs.withColumn("content", STEPS[step](F.col("content")))
    return docs.where(F.trim("content") != "")


def enrich(docs: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Adds ``metadata``: the chosen facts as JSON strings, those without a value left out."""
    entries = []
    if "statistics" in wanted:
        # The whole row stands for the id, so nothing has to be joined back.
        counted = docmeta.text_statistics(docs.select(F.struct("*").alias("row"), "content"), "row", "content")
        docs = counted.select("row.*", F.to_json(F.struct(*counted.columns[1:])).alias("__statistics"))
        entries.append(F.struct(F.lit("statistics").alias("key"), F.col("__statistics").alias("value")))
    if "language" in wanted:
        found = docmeta.detect_language(F.array_distinct(docmeta.ascii_words(F.lower("content"))))
        value = F.when(found["language"] != "unknown", F.to_json(found))
        entries.append(F.struct(F.lit("language").alias("key"), value.alias("value")))
    filled = F.filter(F.array(*entries), lambda e: e["value"].isNotNull()) if entries else F.array().cast("array<struct<key:string,value:string>>")
    return docs.withColumn("metadata", F.map_from_entries(filled)).drop("__statistics")


def prepare(spark: SparkSession, path: str, out: str, config: PrepareConfig, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """Runs the whole preparation; returns the written tables ``documents``, ``errors`` and, if chunked, ``chunks``.

    A file that fails is a row of ``errors``, the others are prepared all the same.
    """
    docs, errors = load(spark, path)
    docs = enrich(clean(docs, config.clean_steps), config.enrich)
    docs = docs.withColumn("doc_id", F.sha2(F.concat_ws("|", "source", "content"), 256))
    base = f"{out}/{config.name()}"
    docs.write.mode("overwrite").parquet(f"{base}/documents")
    errors.write.mode("overwrite").parquet(f"{base}/errors")
    found = {"documents": spark.read.parquet(f"{base}/documents"), "errors": spark.read.parquet(f"{base}/errors")}
    if config.chunking:
        found["chunks"] = rechunk(spark, base, config.collection, config.chunking, embedder)
    return found


#: Files whose paths are handed to one read.
FILES_A_READ = 10_000
MANIFEST = "source string, n_bytes long, modified timestamp, batch string, seq long"


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    """The last entry of each file; one without a batch is gone."""
    if not sinks.exists(spark, f"{base}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    last = rows.groupBy("source").agg(F.max_by(F.struct("n_bytes", "modified", "batch", "seq"), "seq").alias("m"))
    return last.select("source", "m.*")


def find_prepared(spark: SparkSession, out: str, config: PrepareConfig) -> dict[str, DataFrame] | None:
    """The tables that ``prepare_changed`` has made under a configuration; None where there are none."""
    base = f"{out}/{config.name()}"
    if not sinks.exists(spark, f"{base}/manifest"):
        return None
    current = _manifest(spark, base).where("batch IS NOT NULL").select("source", "batch")
    names = ["documents", "errors"] + (["chunks"] if config.chunking else [])
    # A batch that was not entered into the manifest (its run failed) does not count.
    return {name: spark.read.parquet(f"{base}/by_file/{name}").join(current, ["source", "batch"], "left_semi") for name in names}


def prepare_changed(spark: SparkSession, path: str, out: str, config: PrepareConfig, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """As ``prepare``, but only files that are new or changed since the last run are read; those that are gone are left out.

    A manifest has the length and time of each file, as the file system lists them, and the batch
    that holds what was made of it. A run adds one batch and enters it last, so a run that fails
    changes nothing. A file is taken as changed when its length or time is another.
    """
    base = f"{out}/{config.name()}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # Without the column of contents no file is opened.
    listed = listed.select(F.col("path").alias("source"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    known = _manifest(spark, base)
    seq = (known.agg(F.max("seq")).first()[0] or 0) + 1
    batch = uuid.uuid4().hex
    held = known.where("batch IS NOT NULL")
    same = ["source", "n_bytes", "modified"]
    changed = stored(listed.join(held.select(same), same, "left_anti").withColumns({"batch": F.lit(batch), "seq": F.lit(seq).cast("long")}), "changed-files")
    gone = held.join(listed.select("source"), "source", "left_anti").withColumns({"batch": F.lit(None).cast("string"), "seq": F.lit(seq).cast("long")})
    gone = stored(gone.select(*same, "batch", "seq"), "gone-files")
    paths, some = changed.select("source").orderBy("source").toLocalIterator(), True
    while some:
        some = [r["source"] for r in islice(paths, FILES_A_READ)]
        if some or seq == 1:
            _prepare_batch(spark, some, base, batch, config, embedder)
    changed.unionByName(gone).write.mode("append").parquet(f"{base}/manifest")
    return find_prepared(spark, out, config)


def _prepare_batch(spark: SparkSession, paths: list[str], base: str, batch: str, config: PrepareConfig, embedder: Embedder | None) -> None:
    def add(rows: DataFrame, name: str) -> None:
        rows.write.mode("append").partitionBy("batch").parquet(f"{base}/by_file/{name}")

    if paths:
        docs, errors = load(spark, paths)
    else:
        docs, errors = spark.createDataFrame([], "source string, file_type string, content string"), spark.createDataFrame([], "source string, error string")
    docs = enrich(clean(docs, config.clean_steps), config.enrich)
    docs = docs.withColumns({"doc_id": F.sha2(F.concat_ws("|", "source", "content"), 256), "batch": F.lit(batch)})
    add(errors.withColumn("batch", F.lit(batch)), "errors")
    docs = stored(docs, "prepared")
    add(docs, "documents")
    if config.chunking:
        chunks = chunking.chunk(docs, config.chunking, "doc_id", "content").withColumnRenamed("content", "text")
        chunks = embed(chunks, "text", embedder=embedder).withColumn("chunk_id", F.concat_ws("-", "doc_id", F.col("chunk_ix").cast("string")))
        add(chunks.join(docs.select("doc_id", "source", "batch"), "doc_id"), "chunks")


def rechunk(spark: SparkSession, base: str, collection: str, config: chunking.ChunkConfig, embedder: Embedder | None = None) -> DataFrame:
    """Chunks the saved documents (again): the collection's chunks are replaced."""
    docs = spark.read.parquet(f"{base}/documents")
    chunks = chunking.chunk(docs, config, "doc_id", "content").withColumnRenamed("content", "text")
    chunks = embed(chunks, "text", embedder=embedder).withColumn("chunk_id", F.concat_ws("-", "doc_id", F.col("chunk_ix").cast("string")))
    sinks.replace_collection(chunks, f"{base}/chunks", collection)
    return sinks.read_collection(spark, f"{base}/chunks", collection)
