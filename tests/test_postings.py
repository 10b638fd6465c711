"""Overlap by posting lists against brute force, with most elements hot; and the pairs that are formed."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import curate, postings


def zipf_sets(n, size, seed, words=400):
    rnd = random.Random(seed)
    return {i: {f"w{int(words * rnd.random() ** 4)}" for _ in range(rnd.randint(0, size))} for i in range(n)}


def exploded(spark, sets, id_col):
    return spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], f"{id_col} long, e string")


@pytest.mark.parametrize("hot", [0, 5, 40, 1000])
def test_top_overlaps(spark, hot):
    items, docs = zipf_sets(25, 12, 1), zipf_sets(300, 60, 2)
    items[30] = {"w0", "w1"}  # nothing but hot words
    items[31] = {"nowhere"}
    found = {}
    for r in postings.top_overlaps(exploded(spark, items, "item_id"), exploded(spark, docs, "doc_id"), 4, hot).collect():
        found.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["hits"], r["n_words"]))
    expected = {}
    for i, a in items.items():
        hits = sorted((-len(a & b), d) for d, b in docs.items() if a & b)[:4]
        if hits:
            expected[i] = [(n + 1, d, -h, len(a)) for n, (h, d) in enumerate(hits)]
    assert {i: sorted(x) for i, x in found.items()} == expected


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 1.0])
def test_first_overlaps(spark, threshold):
    items, docs = zipf_sets(25, 30, 3), zipf_sets(300, 60, 4)
    with_sizes = exploded(spark, docs, "doc_id").join(spark.createDataFrame([(i, len(s)) for i, s in docs.items()], "doc_id long, n int"), "doc_id")
    found = {r["item_id"]: (r["doc_id"], r["overlap"]) for r in postings.first_overlaps(exploded(spark, items, "item_id"), with_sizes, threshold).collect()}
    expected = {}
    for i, a in items.items():
        for d, b in sorted(docs.items()):
            if a and b and len(a & b) / min(len(a), len(b)) >= threshold:
                expected[i] = (d, round(len(a & b) / min(len(a), len(b)), 6))
                break
    assert found == expected


def test_a_common_passage_pairs_nothing_by_itself(spark):
    """Every document and item holds one passage: only what is rare in an item meets documents."""
    passage = "all rights are reserved here and the rest of it is as it was"
    docs = spark.createDataFrame([(i, f"{passage} {'word%d ' % i * 3}") for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{passage} {' '.join(f'item{i}x{j}' for j in range(30))}") for i in range(10)], "item_id long, text string")
    grams = lambda rows, c: rows.select(c, F.explode(curate.char_grams(F.col("text"))).alias("e"))
    index = postings.Postings(grams(items, "item_id"), grams(docs, "doc_id"), hot=100)
    rare = index.items.where("NOT hot").join(index.docs, "code").count()
    every = index.items.join(index.docs, "code").count()
    assert rare < 0.05 * every
