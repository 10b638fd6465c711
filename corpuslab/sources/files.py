"""Sources: raw files and rows to documents."""

from __future__ import annotations

import csv
import importlib.util
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File types by MIME type and by extension, and text fields by priority.
MIME_TYPES = {
    "application/pdf": "pdf", "application/json": "json", "text/markdown": "md", "text/x-markdown": "md", "text/plain": "txt", "text/csv": "csv",
    "application/csv": "csv",
}
EXTENSIONS = {"pdf": "pdf", "json": "json", "md": "md", "markdown": "md", "txt": "txt", "text": "txt", "csv": "csv"}
TEXT_FIELDS = (
    "text", "content", "body", "message", "description", "question", "answer", "context", "passage", "document", "title", "summary", "abstract",
)
PREFERRED = ("text", "content", "body", "context", "passage", "document", "question")
#: Characters of a CSV column's values on average above which it is taken for text.
LONG_ENOUGH = 50.0
MAX_UPLOAD = 100 * 1024 * 1024


def file_type(path: Column, mime: Column | None = None) -> Column:
    """By MIME type, else by extension; null where neither is known."""
    by_name = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
    if mime is None:
        return by_name
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), mime), by_name)


def mime_type(kind: Column) -> Column:
    names = {"pdf": "application/pdf", "json": "application/json", "md": "text/markdown", "txt": "text/plain", "csv": "text/csv"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind), F.lit("application/octet-stream"))


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1, which never fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_blobs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw files with hash, size and type. Oversized files carry an error instead of failing the job; files of no bytes are skipped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.col("path").alias("source"), file_type(F.col("path")).alias("file_type"), F.col("length").alias("n_bytes"),
        F.sha2("content", 256).alias("content_hash"), "content",
        F.when(F.col("length") > MAX_UPLOAD, "file too large").when(file_type(F.col("path")).isNull(), "unknown file type").alias("error"),
    )


def new_blobs(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """First file of each content that is not known yet."""
    good = blobs.where("error IS NULL").join(known.select("content_hash"), "content_hash", "left_anti")
    first = good.groupBy("content_hash").agg(F.min("source").alias("source"))
    return good.join(first, ["content_hash", "source"], "left_semi")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files, one document each."""
    return read_blobs(spark, path).where(F.col("file_type").isin("txt", "md")).select("source", "file_type", decoded(F.col("content")).alias("content"))


def text_of_object(obj: Column) -> Column:
    """The text of a JSON object (a map of its string fields): the first known field, else long strings joined."""
    named = F.coalesce(*[F.element_at(obj, F.lit(name)) for name in TEXT_FIELDS])
    rest = F.filter(F.map_values(obj), lambda v: F.length(v) > 10)
    return F.coalesce(named, F.when(F.size(rest) > 0, F.array_join(rest, "\n\n")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON files: lists give a document for each element, objects one, scalars their text.

    Objects of a list without a text are skipped; an object without one is kept as JSON
    (``serialized``). Only strings count as texts. Files that are no JSON give no rows, see
    ``broken_json``.
    """
    raw = _json_files(spark, path).where(F.try_parse_json("json").isNotNull())
    kind = F.substring(F.trim("json"), 1, 1)
    lists = raw.where(kind == "[").select("source", F.posexplode(F.from_json("json", "array<string>")).alias("json_index", "json"))
    ones = raw.where(kind != "[").select("source", F.lit(None).cast("int").alias("json_index"), "json")
    each = lists.unionByName(ones).withColumn("is_object", F.substring(F.trim("json"), 1, 1) == "{")
    found = each.withColumn("obj", F.when(F.col("is_object"), F.from_json("json", "map<string,variant>")))
    strings = F.map_filter("obj", lambda _, v: F.schema_of_variant(v) == "STRING")
    strings = F.transform_values(strings, lambda _, v: F.variant_get(v, "$", "string"))
    text = F.when(F.col("is_object"), text_of_object(strings)).otherwise(F.regexp_replace("json", r'^\s*"|"\s*$', ""))
    serialized = F.col("is_object") & text.isNull() & F.col("json_index").isNull()
    docs = found.select(
        "source", F.lit("json").alias("file_type"), F.when(serialized, F.col("json")).otherwise(text).alias("content"),
        "json_index", F.map_keys("obj").alias("json_keys"), serialized.alias("serialized"),
    )
    return docs.where("content IS NOT NULL")


def _json_files(spark: SparkSession, path: str) -> DataFrame:
    return read_blobs(spark, path).where(F.col("file_type") == "json").select("source", decoded(F.col("content")).alias("json"))


def broken_json(spark: SparkSession, path: str) -> DataFrame:
    """source and error of the JSON files that cannot be parsed."""
    return _json_files(spark, path).where(F.try_parse_json("json").isNull()).select("source", F.lit("no valid JSON").alias("error"))


def text_columns(rows: DataFrame, columns: list[str], longest: float = LONG_ENOUGH) -> list[str]:
    """Columns whose values are longer than ``longest`` on average; all if none is."""
    means = rows.agg(*[F.avg(F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in columns]).first()
    return [c for c in columns if (means[c] or 0.0) > longest] or columns


def rows_to_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``content``: "column: value" lines of the text columns, empty values left out."""
    chosen = text_columns(rows, columns)
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in chosen]
    return rows.withColumn("content", F.concat_ws("\n", *lines))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows_to_text(rows, rows.columns).withColumn("csv_columns", F.array(*map(F.lit, rows.columns)))


CSV_ROWS = "source string, csv_row long, content string, csv_columns array<string>, error string"


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder, whatever their columns: source, csv_row, content, csv_columns and error.

    Each file's columns are chosen as ``rows_to_text`` chooses those of one table; a file without a
    header, or that cannot be parsed, is one row with an error.
    """

    def rows_of(source: str, text: str) -> list[tuple]:
        table = list(csv.reader(io.StringIO(text.replace("\x00", ""), newline=""), strict=True))
        if not table or not any(c.strip() for c in table[0]):
            return [(source, None, None, None, "no header")]
        header, rows = table[0], [row for row in table[1:] if row]
        cells = [dict(zip(header, row)) for row in rows]
        means = {c: sum(len(r.get(c) or "") for r in cells) / max(1, len(cells)) for c in header}
        chosen = [c for c in header if means[c] > LONG_ENOUGH] or header
        return [(source, n, "\n".join(f"{c}: {r[c]}" for c in chosen if r.get(c)), header, None) for n, r in enumerate(cells)]

    def parse(batches):
        for batch in batches:
            found = []
            for source, text in zip(batch["source"], batch["csv"]):
                try:
                    found += rows_of(source, text)
                except csv.Error as e:
                    found.append((source, None, None, None, f"no valid CSV: {e}"))
            yield pd.DataFrame(found, columns=["source", "csv_row", "content", "csv_columns", "error"]).astype({"csv_row": "Int64"})

    raw = read_blobs(spark, path).where((F.col("file_type") == "csv") & F.col("error").isNull())
    return raw.select("source", decoded(F.col("content")).alias("csv")).mapInPandas(parse, CSV_ROWS)


def suggest_text_column(rows: DataFrame) -> DataFrame:
    """The column to read texts from: a preferred name, else the longest strings on average."""
    names = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    means = rows.select(*[F.avg(F.length(c)).alias(c) for c in names])
    each = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("text_column"), F.lit(PREFERRED.index(c) if c in PREFERRED else 99).alias("place"), F.col(c).alias("mean"), F.lit(-i).alias("order")) for i, c in enumerate(names)])).alias("x"))
    best = each.select("x.*").orderBy("place", F.desc("mean"), F.desc("order")).limit(1)
    return best.select("text_column", F.round("mean", 6).alias("mean_length"))


def read_pdf(spark: SparkSession, path: str, pages_of=None) -> DataFrame:
    """One row for each page with text, by a page extractor; a file that yields none has one error row.

    ``pages_of`` maps a file's bytes to its pages' texts. Without it the optional pypdf is used.
    """
    if pages_of is None:
        from pypdf import PdfReader  # optional, not part of the base environment

        def pages_of(blob: bytes) -> list[str]:
            return [page.extract_text() or "" for page in PdfReader(io.BytesIO(blob)).pages]

    def extract(blobs):
        def safe(blob: bytes) -> list[str]:
            try:
                return list(pages_of(blob))
            except Exception:  # a broken file is a row with an error, not a failed job
                return []

        return pd.Series([safe(b) for b in blobs])

    blobs = read_blobs(spark, path).where(F.col("file_type") == "pdf")
    pages = blobs.select("source", F.pandas_udf(extract, "array<string>")("content").alias("pages"))
    each = pages.select("source", F.size("pages").alias("total_pages"), F.posexplode_outer("pages").alias("page", "content"))
    good = each.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("source", "content", (F.col("page") + 1).alias("page"), "total_pages", F.lit(False).alias("extraction_error"))
    bad = pages.join(good.select("source").distinct(), "source", "left_anti")
    return good.unionByName(bad.select("source", F.lit("").alias("content"), F.lit(None).cast("int").alias("page"), F.size("pages").alias("total_pages"), F.lit(True).alias("extraction_error")))


def read_documents(spark: SparkSession, path: str, pages_of=None) -> tuple[DataFrame, DataFrame]:
    """Documents (source, file_type, content) of all files of a folder, and those that could not be taken (source, error).

    Each type goes to its reader; PDF files have one where ``pages_of`` is given, or pypdf is there.
    """
    blobs = read_blobs(spark, path)
    errors = blobs.where("error IS NOT NULL").select("source", "error").unionByName(broken_json(spark, path))
    tables = read_csv_files(spark, path)
    errors = errors.unionByName(tables.where("error IS NOT NULL").select("source", "error"))
    docs = read_text(spark, path).unionByName(read_json(spark, path).select("source", "file_type", "content"))
    docs = docs.unionByName(tables.where("error IS NULL").select("source", F.lit("csv").alias("file_type"), "content"))
    if pages_of is None and importlib.util.find_spec("pypdf") is None:
        unread = blobs.where("error IS NULL AND file_type = 'pdf'").select("source", F.lit("no reader for pdf").alias("error"))
        return docs, errors.unionByName(unread)
    pages = read_pdf(spark, path, pages_of)
    docs = docs.unionByName(pages.where("NOT extraction_error").select("source", F.lit("pdf").alias("file_type"), "content"))
    return docs, errors.unionByName(pages.where("extraction_error").select("source", F.lit("no text in pdf").alias("error")))


def curated_rows(rows: DataFrame, context: Column, order: str, least_length: int = 50, limit: int | None = None) -> DataFrame:
    """Contexts of at least ``least_length``, first of each text, up to ``limit`` in order."""
    named = rows.select(F.col(order).alias("row_id"), context.alias("content")).where(F.length("content") >= least_length)
    first = named.groupBy(F.substring(F.md5("content"), 1, 16).alias("content_id")).agg(F.min(F.struct("row_id", "content")).alias("x"))
    kept = first.select("content_id", "x.row_id", "x.content")
    return kept.orderBy("row_id").limit(limit) if limit else kept
