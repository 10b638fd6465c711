"""Families that crowd one region of the Jaccard join: exact as ever, and pairs that grow in proportion.

Whole runs in the numbers of parts of production are tested beside the other operators.
"""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import jaccard_join

from .test_llm import families, roots_of


def template_texts(n, seed=1):
    """One text of 94 words with six words of its own in each copy."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(94)]
    texts = []
    for i in range(n):
        words = list(base)
        for j, at in enumerate(sorted(rnd.sample(range(94), 6), reverse=True)):
            words.insert(at, f"own{i}x{j}")
        texts.append(" ".join(words))
    return texts


def compared(monkeypatch):
    """How many pairs of members the subregions of a run hold, of each call."""
    counts = []
    meeting = jaccard_join._meeting

    def counted(lists, *rest):
        diffs = lists.select("p", "x", "near", "root", F.explode("first").alias("e"))
        groups = diffs.join(jaccard_join._subregions(diffs), ["p", "e"]).groupBy("p", "e").agg(F.count("*").alias("n"))
        counts.append(groups.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0])
        return meeting(lists, *rest)

    monkeypatch.setattr(jaccard_join, "_meeting", counted)
    return counts


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return roots_of(sets, lambda a, b: den * len(a & b) >= num * len(a | b))


@pytest.mark.parametrize("k, num, den", [(3, 9, 10), (5, 4, 5)])
def test_pairs_of_a_template_grow_in_proportion(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard_join, "CROWD", 16)
    counts, of = compared(monkeypatch), []
    for n in (300, 600):
        docs = spark.createDataFrame(list(enumerate(template_texts(n))), "doc_id long, text string")
        counts.clear()
        found = jaccard_join.jaccard_components(docs, k, num, den)
        assert found.select("component_id").distinct().count() == n
        of.append(sum(counts))
    assert of[1] <= 2.6 * max(of[0], 600 * 16)


@pytest.mark.parametrize("crowd, k, num, den", [(1, 3, 9, 10), (2, 5, 4, 5), (8, 3, 9, 10)])
def test_crowds_brute_force(spark, monkeypatch, crowd, k, num, den):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    rnd = random.Random(crowd)
    texts = families(crowd) + template_texts(40, crowd)
    base = [f"b{i}" for i in range(80)]
    # A family of several variants, each with edits of its own.
    for n in range(60):
        words = list(base)
        words[10 : 10 + n % 5] = [f"v{n % 5}"] * (n % 5)
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(30)}"
        texts.append(" ".join(words))
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, num, den).collect()}
    assert found == dict(enumerate(brute(texts, k, num, den)))
