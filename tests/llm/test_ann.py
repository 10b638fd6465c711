"""Nearest neighbours: recall on tables beyond the sample, and mixed dimensions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import ann


def recall_of(rows, found, k=5):
    x = np.array([v for _, v in rows])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = collections.defaultdict(set)
    for r in found:
        got[r["query_id"]].add(r["vec_id"])
    hits = asked = 0
    for q, _ in rows:
        if q % 50 == 0:
            scores = unit @ unit[q]
            scores[q] = -9
            hits += len(got[q] & set(np.argsort(-scores)[:k].tolist()))
            asked += k
    return hits / asked


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_beyond_the_sample(spark, clusters):
    """The sample is an eighth of the rows, so trees go on by random directions."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(8000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 8000)] + 0.3 * x
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, n_sample=1000, leaf_size=32)
    assert recall_of(rows, found.collect()) >= 0.9


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    assert [i for i, _ in rows] == list(range(len(rows)))
    assert recall_of(rows, ann.search(table, F.col("vec_id") % 50 == 0).collect()) >= 0.9


def test_leaves_deepen(spark):
    rng = np.random.default_rng(5)
    points = ann._unit(rng.normal(size=(4000, 8)))
    tree = ann.deepened(ann.grow(points[:500], 25, rng), 3, rng)
    sizes = np.unique(ann.leaves_of(tree, points), return_counts=True)[1]
    assert sizes.mean() < 40
    walk = list(ann.visits_of([tree], points[0]))
    assert walk[0] == (0, ann.leaves_of(tree, points[:1])[0]) and len(walk) == len(set(walk)) == 8 * len(tree.means)


def test_mixed_dimensions(spark):
    rows = [(0, [1.0]), (50, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (100, [2.0]), (150, [1.0, 2.0, 3.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [100], 50: [1, 2], 100: [0]}
