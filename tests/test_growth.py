"""What must not grow faster than the input: ranges of documents, slices of texts, copies of blocks. Results against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import blocks, chunking, curate


def test_settled_items_meet_no_later_documents(spark, monkeypatch):
    """an item goes on to the next range of ids only while nothing matched; ids beyond floating numbers stay exact."""
    monkeypatch.setattr(curate, "FIRST_DOCS", 4)
    monkeypatch.setattr(curate, "WIDER", 2)
    rnd, big = random.Random(5), 2**60
    word = lambda: "".join(rnd.choice("abc") for _ in range(4))
    docs = [(big + 7 * i, " ".join(word() for _ in range(6))) for i in range(90)] + [(None, "aaaa bbbb"), (big, None)]
    items = [(big + i, " ".join(word() for _ in range(5))) for i in range(30)] + [(1, "unlike all the others"), (2, ""), (3, None)]
    of_docs, of_items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ranges = curate.id_ranges(of_docs.where("doc_id IS NOT NULL"))
    assert len(ranges) > 2 and ranges[-1][0] is None and ranges[0][0] < big + 7 * 10
    got = {r["item_id"]: (r["doc_id"], r["overlap"]) for r in curate.contaminated_ngrams(of_items, of_docs, 0.2).collect()}
    grams = lambda t: {t[i : i + 5] for i in range(len(t or "") - 4)}
    expected = {}
    for i, a in items:
        for d, b in sorted(x for x in docs if x[0] is not None and x[1]):
            x, y = grams(a), grams(b)
            if x and y and len(x & y) / min(len(x), len(y)) >= 0.2:
                expected.setdefault(i, (d, round(len(x & y) / min(len(x), len(y)), 6)))
    assert got == expected and 5 < len(got) < 31


def test_texts_leave_a_batch_in_slices(spark, monkeypatch):
    """F7, F8: a worker makes rows of a few texts at a time, of whatever size its batch is."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).coalesce(1)
    most = blocks.texts_to_rows(docs, "doc_id", F.col("text"), lambda texts: ([0], [[len(texts)]]), "n int").agg(F.max("n"), F.sum("n")).first()
    assert most[0] <= blocks.TEXTS and most[1] == 2000
    found = {(r["doc_id"], r["gram"]) for r in curate.gram_rows(docs.where("doc_id < 300"), "doc_id", F.col("text"), 3).collect()}
    assert found == {(i, t[j : j + 3]) for i in range(300) for t in [f"text {i}"] for j in range(len(t) - 2)}
    cut = chunking.chunk(docs.where("doc_id < 300"), chunking.ChunkConfig("fixed", 100, 0)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["chunk_ix"], r["content"]) for r in cut] == [(i, 0, f"text {i}") for i in range(300)]


def test_semantic_chunks_without_a_shuffle(spark):
    """parts end where the distance to the next sentence is above the 95th percentile; rows of one id stay apart."""
    text = " ".join(["The cat sat."] * 12 + ["Rates of interest rose."] * 12)
    docs = spark.createDataFrame([(1, text), (2, "One."), (2, "Two."), (3, ""), (4, None)], "doc_id long, text string")
    cut = chunking.chunk(docs, chunking.ChunkConfig("semantic", 2000, 0))
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "")
    got = sorted((r["doc_id"], r["chunk_ix"], r["content"]) for r in cut.collect())
    assert got == [(1, 0, " ".join(["The cat sat."] * 12)), (1, 1, " ".join(["Rates of interest rose."] * 12)), (2, 0, "One."), (2, 0, "Two."), (3, 0, "")]
    assert chunking._percentile(np.array([0.0, 1.0, 2.0]), 0.95) == pytest.approx(1.9)


def test_large_owners_are_cut_and_others_are_not(spark, tmp_path, monkeypatch):
    """late interaction over all cells, with owners and queries that are dealt over blocks; one block gives k rows a query."""
    from corpuslab.operators import cell_index

    monkeypatch.setattr(cell_index, "WHOLE", 10)
    monkeypatch.setattr(blocks, "FEWEST", 40)
    monkeypatch.setattr(blocks, "SLICE", 300)
    x = np.random.default_rng(7).normal(size=(240, 8))
    owner = [i // 4 if i < 160 else 40 if i < 200 else 41 + i // 8 for i in range(240)]
    rows = spark.createDataFrame([(i, owner[i], [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, owner long, embedding array<double>")
    index = cell_index.CellIndex.create(rows, str(tmp_path / "x"), owner_col="owner", n_cells=4)
    asked = rows.where("owner % 5 = 0").select(F.col("owner").alias("query_id"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    got = {(r["query_id"], r["rank"]): (r["owner"], r["score"]) for r in index.search(asked, 3).collect()}
    expected = {}
    for q in {o for o in owner if o % 5 == 0}:
        mine = x[[o == q for o in owner]]
        score = {o: round(float((mine @ x[[p == o for p in owner]].T).max(axis=1).sum()), 6) for o in set(owner)}
        for n, o in enumerate(sorted(score, key=lambda o: (-score[o], o))[:3]):
            expected[q, n + 1] = (o, pytest.approx(score[o]))
    assert got == expected
    inner = index._searched(asked, index.live().select("owner", "id", "vector"), 3)
    assert inner.where("query_id = 5").count() <= 3 * blocks.blocks_for(240) + 1


def test_copies_of_a_block_do_not_grow_with_the_square():
    """ten times the rows are copied no more often, until blocks are full."""
    assert blocks.blocks_for(50_000) == blocks.blocks_for(250_000) == blocks.GRID and blocks.blocks_for(0) == 1
    assert blocks.blocks_for(600_000) <= 19


def test_places_as_c_prints_them(spark):
    """halves that binary numbers hold go to even, all others by their exact value."""
    from corpuslab.functions.text import fixed_places

    values = sorted({h / n for n in (7, 16, 32, 40, 48, 80, 1000) for h in range(n + 1)} | {1.0005, 2.5, 0.125, 12345.6785, 99.95})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[fixed_places(F.col("v"), n).alias(f"p{n}") for n in (1, 2, 3)]).collect()
    for r in rows:
        assert [r["p1"], r["p2"], r["p3"]] == ["%.1f" % r["v"], "%.2f" % r["v"], "%.3f" % r["v"]]


def test_equal_means_tie(spark):
    """the same scores in another order are the same mean."""
    from corpuslab.plans.eval_queries import spread_of

    rows = [("b", "m", v) for v in (0.1, 0.2, 0.3)] + [("a", "m", v) for v in (0.3, 0.2, 0.1)]
    found = spread_of(spark.createDataFrame(rows, "run string, metric string, v double").coalesce(1)).first()
    assert (0.1 + 0.2) + 0.3 != (0.3 + 0.2) + 0.1 and (found["best_run"], found["worst_run"], found["spread"]) == ("a", "a", 0.0)


def test_keywords_without_a_shuffle(spark):
    """phrases by hand; no step deals the words out."""
    from corpuslab.functions import docmeta

    docs = spark.createDataFrame([(1, "Deep learning is fun. Deep learning models and x models"), (2, None), (3, "the of")], "doc_id long, text string")
    found = docmeta.rake_keywords(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["doc_id"], r["phrase"], r["score"], r["rank"]) for r in found.orderBy("rank").collect()] == [(1, "deep learning models", 7.0, 1), (1, "deep learning", 5.0, 2), (1, "models", 2.0, 3), (1, "fun", 1.0, 4)]
