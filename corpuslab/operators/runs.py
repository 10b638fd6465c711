"""Stored evaluation runs: listing, comparison over metrics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed_places
from . import stats

RUN = "id string, name string, created_at string, eval_dataset_id string, config map<string,string>, metrics map<string,double>, results array<struct<query:string,ground_truth:string,predicted_answer:string,score:double,scores:map<string,double>,latency:double,error:string>>"


def scan_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The runs of a folder of JSON files with their modification time, and the files that are broken."""
    raw = spark.read.schema(f"{RUN}, _broken string").json(path, multiLine=True, columnNameOfCorruptRecord="_broken")
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    bad = F.col("_broken").isNotNull() | F.col("id").isNull()
    return raw.where(~bad).drop("_broken"), raw.where(bad).select("file", "modified")


def list_runs(runs: DataFrame, name: str | None = None, limit: int = 20) -> DataFrame:
    """The newest runs, those whose name holds ``name`` in any case."""
    kept = runs.where(F.contains(F.lower("name"), F.lit(name.lower()))) if name else runs
    return kept.orderBy(F.desc("created_at"), "id").limit(limit)


def compare_metrics(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two runs metric by metric (group = metric, a, b), significance corrected over the metrics."""
    compared = stats.compare_runs(scores, alpha)
    corrected = stats.benjamini_hochberg(compared.select("group", "p"), alpha).select("group", "adjusted", F.col("significant").alias("still"))
    return compared.join(corrected, "group").withColumn("significant", F.col("still")).drop("still")


def comparison_summary(compared: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: how many metrics rose or fell significantly, and a line for each of them in order."""
    sure, d = F.col("significant"), F.col("difference")
    status = F.when(d > 0, "improved").when(d < 0, "degraded").otherwise("unchanged")
    line = F.concat(
        F.lit("  - "), F.col("group").cast("string"), F.lit(": "), fixed_places(F.col("mean_a"), 3), F.lit(" -> "), fixed_places(F.col("mean_b"), 3), F.lit(" ("), status,
        F.when(sure, " (significant)").otherwise(""), F.concat(F.lit(", "), "effect", F.lit(" effect")), F.lit(")"),
    )
    counted = compared.agg(
        F.count_if(sure & (d > 0)).alias("improvements"), F.count_if(sure & (d < 0)).alias("degradations"), F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"),
    )
    same = F.col("n") - F.col("improvements") - F.col("degradations")
    text = F.concat(
        F.format_string(f"Comparison Summary (alpha={alpha}):\n  - Significant improvements: %d\n  - Significant degradations: %d\n  - No significant change: %d\n\nMetric Details:\n", "improvements", "degradations", same), "lines"
    )
    return counted.select("improvements", "degradations", same.alias("no_change"), F.when(F.col("n") == 0, "No comparisons to summarize.").otherwise(text).alias("summary"))


def csv_summary(aggregates: DataFrame) -> DataFrame:
    """The summary block under an exported run: one row for each label."""

    def percent(name: str) -> Column:
        return F.concat(fixed_places(F.coalesce(F.col(name), F.lit(0.0)) * 100.0, 1), F.lit("%"))

    rows = (("Context Precision", percent("context_precision")), ("Precision@K", percent("precision_at_k")), ("Recall@K", percent("recall_at_k")), ("Avg Latency", F.concat(fixed_places(F.coalesce("avg_latency", F.lit(0.0)), 2), F.lit("s"))))
    return aggregates.select("run", F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(rows)])))


def bench_csv_rows(results: DataFrame, scores: list[str]) -> DataFrame:
    """Result rows as the benchmark script exports them: percentages without a sign, empty where there is no value."""
    values = [F.when(F.col(c).isNull(), "").otherwise(fixed_places(F.col(c) * 100.0, 1)).alias(c) for c in scores]
    return results.select("run", "item_id", *values, F.when(F.col("latency").isNull(), "").otherwise(fixed_places(F.col("latency"), 3)).alias("latency"))
