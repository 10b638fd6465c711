"""Evaluation as a whole: a registry of metrics that checks its inputs, presets that are honoured, scoring that outlives a failing metric,
templates, exports, and stages that are retried and taken up again where they stopped."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import answers, metrics
from .postings import stored

# Thresholds of the presets of metrics, and the retrieval presets.
PRESETS = {"default": metrics.DEFAULT, "strict": metrics.STRICT, "lenient": metrics.LENIENT, "fast": metrics.DEFAULT}
#: Metrics that embed texts; the fast preset leaves them out.
SLOW = frozenset({"answer_correctness"})


@dataclass(frozen=True)
class RetrievalSettings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    k: int = 5
    rerank: bool = False


RETRIEVAL_PRESETS = {"quick": RetrievalSettings(500, 50, 3), "balanced": RetrievalSettings(1000, 200, 5), "high_quality": RetrievalSettings(1500, 300, 7, True)}


def with_preset(asked: RetrievalSettings, preset: str) -> RetrievalSettings:
    """The preset's values where ``asked`` holds its defaults; what was set stays."""
    known, base = RETRIEVAL_PRESETS[preset], RetrievalSettings()
    kept = {f.name: getattr(asked, f.name) for f in fields(asked) if getattr(asked, f.name) != getattr(base, f.name)}
    return replace(known, **kept)


@dataclass(frozen=True)
class Metric:
    """What a metric is called, what its rows must have, and how it is worked out under thresholds: (item_id, value)."""

    name: str
    needs: tuple[str, ...]
    compute: Callable[[DataFrame, metrics.Thresholds], DataFrame]
    about: str = ""
    version: str = "2.0.0"


REGISTRY: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    REGISTRY[metric.name] = metric
    return metric


def metric_info() -> list[dict[str, str]]:
    return [{"name": m.name, "needs": ",".join(m.needs), "about": m.about, "version": m.version} for m in sorted(REGISTRY.values(), key=lambda m: m.name)]


def check_inputs(name: str, rows: DataFrame) -> Metric:
    """The metric of that name; raises where it is not known or the rows lack a column it needs."""
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name}, known are {sorted(REGISTRY)}")
    lacking = [c for c in REGISTRY[name].needs if c not in rows.columns]
    if lacking:
        raise ValueError(f"metric {name} needs {lacking}")
    return REGISTRY[name]


def _judged(rows: DataFrame, t: metrics.Thresholds) -> DataFrame:
    """Rows (item_id, rank, question, content[, reference]) with the judgement of a preset."""
    truth = F.col("reference") if "reference" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("relevant", metrics.relevant(F.col("question"), truth, F.col("content"), t.relevance))


register(Metric("context_precision", ("item_id", "rank", "question", "content"), lambda rows, t: metrics.context_precision(_judged(rows, t)), "average precision of the judged ranks"))
register(Metric("precision_at_k", ("item_id", "rank", "question", "content"), lambda rows, t: metrics.precision_at_k(_judged(rows, t)), "relevant of the first k"))
register(Metric("faithfulness", ("item_id", "answer", "context"), lambda rows, t: metrics.faithfulness(rows, t.support), "claims that the context holds"))
register(Metric("answer_correctness", ("item_id", "answer", "reference"), lambda rows, t: answers.answer_correctness(rows, threshold=t.claim_match).select("item_id", "value"), "claims and similarity to a reference"))


def evaluate(rows: dict[str, DataFrame], names: list[str] | None = None, preset: str = "default") -> DataFrame:
    """(item_id, metric, value, error) of each metric over its rows, under a preset.

    ``rows`` has the frame of each metric. A metric whose job fails gives no values but one row
    without an item: its error. Inputs that lack a column raise before anything runs.
    """
    thresholds = PRESETS[preset]
    names = [n for n in (names or sorted(rows)) if not (preset == "fast" and n in SLOW)]
    chosen = [(check_inputs(n, rows[n]), rows[n]) for n in names]
    kind = "item_id string, metric string, value double, error string"
    found = next(iter(rows.values())).sparkSession.createDataFrame([], kind)
    for metric, frame in chosen:
        try:
            values = stored(metric.compute(frame, thresholds).select(F.col("item_id").cast("string").alias("item_id"), F.lit(metric.name).alias("metric"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("error")), "metric")
        except Exception as e:  # whatever a metric of the user's raises, the others are still scored
            values = frame.sparkSession.createDataFrame([(None, metric.name, 0.0, f"{type(e).__name__}: {str(e)[:500]}")], kind)
        found = found.unionByName(values)
    return found


def export_run(results: DataFrame, path: str) -> None:
    """A run as JSON, one result a line; times and decimals as text."""
    plain = {f.name: F.col(f.name).cast("string") for f in results.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date", "decimal")}
    results.withColumns(plain).write.mode("overwrite").json(path)


def list_templates(templates: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Templates (name, is_preset, tags, ...) that have any of the tags, presets first, then by name in any case."""
    found = templates if not tags else templates.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return found.orderBy(F.desc("is_preset"), F.lower("name"))


def first_with_rows(*sources: DataFrame) -> DataFrame:
    """The first frame that has rows, such as a vector store before prepared documents; the last if none has."""
    for source in sources[:-1]:
        if not source.isEmpty():
            return source
    return sources[-1]


def with_retries(call: Callable[[], DataFrame], retries: int = 3, base: float = 1.0, most: float = 60.0, again: tuple[type[Exception], ...] = (OSError,), sleep=time.sleep) -> DataFrame:
    """Runs a call again after errors that may pass, after 1, 2, 4 ... times ``base`` seconds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except again:
            if attempt == retries:
                raise
            sleep(min(most, base * 2**attempt))
    raise AssertionError("unreachable")


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], out: str, retries: int = 3, base: float = 1.0) -> dict[str, DataFrame]:
    """Runs stages in order, each on the written tables of those before it; whole tables that are there already are taken as they are."""
    done: dict[str, DataFrame] = {}
    for name, stage in stages:
        place = f"{out}/{name}"
        if not sinks.exists(spark, f"{place}/_SUCCESS"):

            def run() -> None:
                stage(done).write.mode("overwrite").parquet(place)  # noqa: B023

            with_retries(run, retries, base)
        done[name] = spark.read.parquet(place)
    return done
