"""Stored indexes and pruned joins: exact where they say so, and what they read and compare."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import cosine_join
from corpuslab.operators import substring_index
from corpuslab.operators.cell_index import CellIndex


def clustered(n, dim=16, centers=12, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(centers, dim))
    return [(int(i), [float(x) for x in means[i % centers] + spread * rng.normal(size=dim)]) for i in range(n)]


def unit(rows):
    x = np.array([v for _, v in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_are_read_by_folder(spark, tmp_path):
    rows = clustered(1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0])], df.schema)
    index = CellIndex.create(df.unionByName(odd), str(tmp_path / "i"), n_cells=24)
    assert index.live().count() == 1500
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    scores = np.round(unit(rows) @ unit(rows).T, 6)
    exact = {q: [i for i in np.lexsort((np.arange(1500), -scores[q])) if i != q][:5] for q in range(0, 1500, 50)}

    def found(n_probe):
        got = {}
        for r in index.nearest(asked, 5, n_probe, exclude_self=True).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        return got

    assert found(None) == exact
    some = found(3)
    assert sum(len(set(some[q]) & set(exact[q])) for q in exact) >= 0.9 * 5 * len(exact)
    one = index.nearest(asked.where("query_id = 50"), 5, 2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    read = index.live([0, 1]).select(F.input_file_name()).distinct().collect()
    assert {r[0].split("cell=")[1].split("/")[0] for r in read} == {"0", "1"}


def test_token_index(spark, tmp_path):
    rows = [(i, i // 6, v) for i, v in clustered(900, seed=2)]
    df = spark.createDataFrame(rows, "vec_id long, owner long, embedding array<double>")
    index = CellIndex.create(df, str(tmp_path / "t"), owner_col="owner", n_cells=16)
    asked = df.where("owner % 10 = 0").select(F.col("owner").alias("query_id"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))

    def brute(held):
        got = {}
        for q in range(0, 150, 10):
            x = np.array([v for _, o, v in rows if o == q])
            score = {o: round(float((x @ np.array(vs).T).max(axis=1).sum()), 6) for o, vs in held.items()}
            got[q] = sorted(score, key=lambda o: (-score[o], o))[:5]
        return got

    def found(n_probe=None):
        got = {}
        for r in index.search(asked, 5, n_probe, n_candidates=30).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["owner"])
        return got

    held = {}
    for _, o, v in rows:
        held.setdefault(o, []).append(v)
    exact = brute(held)
    assert found() == exact
    some = found(4)
    assert sum(len(set(some[q]) & set(exact[q])) for q in exact) >= 0.9 * 5 * len(exact)
    index.delete(df.where("owner % 10 = 0").select("owner"))
    held = {o: vs for o, vs in held.items() if o % 10}
    assert found() == brute(held)
    index.add(spark.createDataFrame([(5000, 10, rows[60][2])], df.schema), owner_col="owner")
    held[10] = [rows[60][2]]
    assert found() == brute(held)
    index.compact()
    again = CellIndex(spark, str(tmp_path / "t"))
    assert again.live().count() == sum(map(len, held.values()))
    index = again
    assert found() == brute(held)


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.0, -0.2])
def test_cosine_join_brute_force(spark, threshold):
    rows = clustered(300, dim=6, spread=0.4, seed=3) + [(1000, [0.0] * 6), (1001, [1.0] + [0.0] * 5), (1002, [2.0] + [0.0] * 5), (1003, None)]
    got = cosine_join.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold, block_rows=50).collect()
    known = [(i, v) for i, v in rows if v is not None]
    x = np.array([v for _, v in known])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = np.round(x @ x.T, 6)
    ids = [i for i, _ in known]
    expected = {(ids[a], ids[b]) for a in range(len(ids)) for b in range(len(ids)) if ids[a] < ids[b] and scores[a, b] >= threshold}
    assert len(got) == len({(r["i"], r["j"]) for r in got}) and {(r["i"], r["j"]) for r in got} == expected


def test_cosine_join_prunes_clusters(spark):
    """Clustered vectors are compared with their like alone; isotropic ones with all, once."""
    df = spark.createDataFrame(clustered(4000, dim=32, centers=40, spread=0.05), "vec_id long, embedding array<double>")
    met = cosine_join.meetings(cosine_join.placed(df, 0.95)).agg(F.sum(F.col("homes") * F.col("others"))).first()[0]
    assert met < 0.1 * 4000 * 4000
    rng = np.random.default_rng(1)
    units = rng.normal(size=(500, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    assert len(cosine_join.choose_pivots(units, math.acos(0.3))) == 1


def test_empty_join(spark):
    assert cosine_join.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"), 0.5).count() == 0


def test_substring_index(spark, tmp_path):
    texts = [f"Document {i} of the Größe {'xyz' if i % 40 == 0 else 'abc'} with 100% and _under_" for i in range(200)] + ["", None, "xy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = substring_index.SubstringIndex.create(docs, str(tmp_path / "s"))
    for pattern in ("XYZ", "größe xyz", "xy", "of the", "100%", "_under_", "nt 17", "nothing", "", "c with", "\\", "."):
        found = {r["doc_id"] for r in index.search(pattern).collect()}
        assert found == {i for i, t in enumerate(texts) if t is not None and pattern.lower() in t.lower()} or (pattern == "" and len(found) == 203)
    assert index.candidates("xyz").count() == 5 and index.candidates("of the") is None and index.candidates("nothing").count() == 0
    plan = index.candidates("xyz")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    page = index.page("document", 10, 5, 8).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["content"], r["total"]) for r in page] == [(i, "Document", 200) for i in range(10, 15)]
