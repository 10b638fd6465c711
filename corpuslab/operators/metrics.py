"""Retrieval and answer metrics over frames of judged results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_set

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}


@dataclass(frozen=True)
class Thresholds:
    relevance: float = 0.3
    support: float = 0.5
    claim_match: float = 0.7


DEFAULT, STRICT, LENIENT = Thresholds(), Thresholds(0.5, 0.7, 0.8), Thresholds(0.2, 0.3, 0.6)


def metric(function):
    """Registers a metric: a function from judged results to (item_id, value)."""
    METRICS[function.__name__] = function
    return function


def jaccard(a: Column, b: Column) -> Column:
    """Word-set Jaccard; 0 where either is empty."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y)).cast("double")
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0.0)))


def relevant(query: Column, truth: Column, content: Column, threshold: float = DEFAULT.relevance) -> Column:
    """Whether more than ``threshold`` of the reference's words (truth, else query) stand in the content."""
    reference = word_set(F.when(F.coalesce(truth, F.lit("")) != "", truth).otherwise(query))
    hits = F.size(F.array_intersect(reference, word_set(content)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(reference)) > threshold, F.lit(False))


@metric
def context_precision(judged: DataFrame) -> DataFrame:
    """Average precision: the mean over relevant ranks of the precision down to each."""
    so_far = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    each = judged.select("item_id", rel.alias("rel"), (F.sum(rel).over(so_far) / F.col("rank").cast("double")).alias("p"))
    value = F.coalesce(F.try_divide(F.sum(F.col("rel") * F.col("p")), F.sum("rel")), F.lit(0.0))
    return each.groupBy("item_id").agg(F.round(value, 6).alias("value"))


@metric
def precision_at_k(judged: DataFrame) -> DataFrame:
    return judged.groupBy("item_id").agg(F.round(F.avg(F.col("relevant").cast("double")), 6).alias("value"))


def recall_at_k(expanded: DataFrame, k: int) -> DataFrame:
    """Relevant in the first k over relevant in the whole expanded set; 0 without any."""
    inside = F.count_if(F.col("relevant") & (F.col("rank") <= k)).cast("double")
    value = F.coalesce(F.try_divide(inside, F.count_if("relevant")), F.lit(0.0))
    return expanded.groupBy("item_id").agg(F.round(value, 6).alias("value"))


def claims(answer: Column) -> Column:
    """Parts between full stops of more than ten characters."""
    return F.filter(F.transform(F.split(answer, r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > 10)


def faithfulness(answers: DataFrame, support: float = DEFAULT.support) -> DataFrame:
    """Share of an answer's claims whose words stand in the context by more than ``support``.

    Without a context 0, without claims 1.
    """
    sets = answers.select("item_id", "answer", "context", claims(F.col("answer")).alias("claims"), word_set(F.coalesce("context", F.lit(""))).alias("seen"))
    held = F.filter("claims", lambda c: F.size(F.array_intersect(word_set(c), F.col("seen"))) / F.size(word_set(c)).cast("double") > support)
    value = F.when(F.coalesce("context", F.lit("")) == "", 0.0).when(F.size("claims") == 0, 1.0).otherwise(F.size(held) / F.nullif(F.size("claims").cast("double"), F.lit(0.0)))
    return sets.select("item_id", F.round(value, 6).alias("value"))


def claim_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Both sides empty: 1; one: 0."""
    total = 2 * tp + fp + fn
    return F.when(total == 0, 1.0).otherwise(2.0 * tp / F.nullif(total.cast("double"), F.lit(0.0)))


def run_aggregates(results: DataFrame, scores: list[str]) -> DataFrame:
    """Means over results without an error (a missing score is 0), latency over all, and counts."""
    good = F.col("error").isNull()
    means = [F.round(F.avg(F.when(good, F.coalesce(F.col(s), F.lit(0.0)))), 6).alias(s) for s in scores]
    return results.groupBy("run").agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_good"), *means,
        F.round(F.avg("latency"), 6).alias("avg_latency"),
        F.round(F.try_divide(F.sum(F.when(good, F.col("latency"))), F.count("*")), 6).alias("avg_latency_of_good"),
    )
