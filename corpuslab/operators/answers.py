"""Answer correctness and the scoring of stored runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .retrieval import Embedder, HashedWords


def matched_pairs(similarity: np.ndarray, threshold: float) -> int:
    """Pairs matched one to one, the most similar first, down to ``threshold``; ties go to the earlier claims."""
    found, rows, columns = 0, set(), set()
    for flat in np.argsort(-similarity, axis=None, kind="stable"):
        i, j = divmod(int(flat), similarity.shape[1])
        if similarity[i, j] < threshold:
            break
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            found += 1
    return found


def claim_matches(given: Column, wanted: Column, threshold: float = metrics.DEFAULT.claim_match, embedder: Embedder | None = None) -> Column:
    """How many claims of two arrays match one to one by the cosine of their embeddings."""
    model = embedder or HashedWords()

    def match(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b):
            both = x is not None and y is not None and len(x) and len(y)
            found.append(matched_pairs(_unit(model(list(x))) @ _unit(model(list(y))).T, threshold) if both else 0)
        return pd.Series(found, dtype="int64")

    return F.pandas_udf(match, "long")(given, wanted)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def text_similarity(a: Column, b: Column, embedder: Embedder | None = None) -> Column:
    """Cosine of two texts' embeddings; 0 where one is empty."""
    model = embedder or HashedWords()

    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_unit(model(list(x.fillna("")))) * _unit(model(list(y.fillna(""))))).sum(axis=1) if len(x) else [], dtype="float64")

    return F.pandas_udf(similar, "double")(a, b)


@metrics.metric
def answer_correctness(answers: DataFrame, factual_weight: float = 0.5, threshold: float = metrics.DEFAULT.claim_match, embedder: Embedder | None = None) -> DataFrame:
    """(item_id, value, tp, fp, fn) of rows (item_id, answer, reference): F1 of claims and similarity, weighted.

    Without a reference the value is 0; with no claims on either side the factual part is 1.
    """
    sides = answers.select("item_id", "answer", "reference", metrics.claims(F.coalesce("answer", F.lit(""))).alias("given"), metrics.claims(F.coalesce("reference", F.lit(""))).alias("wanted"))
    tp = claim_matches(F.col("given"), F.col("wanted"), threshold, embedder)
    sides = sides.withColumns({"tp": tp, "alike": text_similarity(F.col("answer"), F.col("reference"), embedder)})
    counted = sides.select("item_id", "reference", "alike", "tp", (F.size("given") - F.col("tp")).alias("fp"), (F.size("wanted") - F.col("tp")).alias("fn"))
    score = factual_weight * metrics.claim_f1(F.col("tp"), F.col("fp"), F.col("fn")) + (1 - factual_weight) * F.col("alike")
    value = F.when(F.coalesce("reference", F.lit("")) == "", 0.0).otherwise(score)
    return counted.select("item_id", F.round(value, 6).alias("value"), "tp", "fp", "fn")


def score_run(results: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``results`` (one row for each item_id) with one column for each metric, 0 where it gives no value.

    Stored runs are scored again by reading them and passing the metrics wanted; columns of those
    names are replaced, others stay.
    """
    scored = results.drop(*scorers)
    for name, scorer in scorers.items():
        values = scorer(results).select("item_id", F.col("value").alias(name))
        scored = scored.join(values, "item_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return scored
