"""Operators without SQL: answer correctness, semantic contamination, preparation, versions, run files, importers of files."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import answers, chunking, curate, prepare, retrieval, runs
from corpuslab.sources import importers, sinks


def cosines(a, b):
    model = retrieval.HashedWords()
    x, y = model(a), model(b)
    return x @ y.T


def test_matching_takes_the_most_similar_first():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        left, found = s.copy(), 0
        while left.size and left.max() >= 0.5:
            i, j = np.unravel_index(left.argmax(), left.shape)
            left[i, :], left[:, j], found = -1, -1, found + 1
        assert answers.matched_pairs(s, 0.5) == found


def test_answer_correctness(spark):
    long = ["the first claim is about rivers", "a second claim about high mountains", "something quite different here"]
    rows = [
        (1, ". ".join(long[:2]), ". ".join(long[:2])), (2, ". ".join(long[:2]), ". ".join(long[1:])), (3, "short", "tiny"), (4, long[0], ""), (5, "", long[0]), (6, None, None), (7, long[0], "ok"),
    ]
    got = {r["item_id"]: r for r in answers.answer_correctness(spark.createDataFrame(rows, "item_id long, answer string, reference string")).collect()}
    for i, given, wanted in rows:
        if not wanted:
            assert got[i]["value"] == 0
            continue
        a, b = ([c.strip() for c in (x or "").split(".") if len(c.strip()) > 10] for x in (given, wanted))
        best = 0
        if a and b:
            s = cosines(a, b)
            best = max(sum(s[i, j] >= 0.7 for i, j in zip(range(len(a)), p)) for p in itertools.permutations(range(max(len(a), len(b))), len(a)) if max(p) < len(b)) if len(a) <= len(b) else int((s >= 0.7).any())
        f1 = 1.0 if not a and not b else 2 * best / (len(a) + len(b))
        assert got[i]["tp"] == best and abs(got[i]["value"] - (0.5 * f1 + 0.5 * cosines([given or ""], [wanted])[0, 0])) < 1e-5


def test_score_run(spark):
    results = spark.createDataFrame([(1, "a b c d e f g h i j k", "a b c d e f g h i j k", 0.3), (2, "x", None, 0.9)], "item_id long, answer string, reference string, answer_correctness double")
    got = {r["item_id"]: r["answer_correctness"] for r in answers.score_run(results, {"answer_correctness": answers.answer_correctness}).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}


def test_semantic_contamination(spark):
    training = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four five six"), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "alpha beta gamma delta", "x"), (11, "six five four three two one", "y"), (12, "nothing of it", ""), (13, "", None)], "pair_id long, question string, answer string")
    got = {r["pair_id"]: (r["match_type"], r["source"]) for r in curate.contamination(items, training, share=0.95, cosine=0.85).collect()}
    assert got == {10: ("exact", None), 11: ("semantic", 2)}


def test_prepare(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("<b>The quick</b> text of a file that is long enough, see https://x.org/a for it.\n\n12\n\nMail me@x.org, which is gone at the end.")
    (tmp_path / "in" / "b.json").write_text(json.dumps([{"text": "first document of the list which is in it"}, {"n": 1}]))
    (tmp_path / "in" / "c.bin").write_bytes(b"\x00")
    (tmp_path / "in" / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "e.txt").write_text("   ")
    config = prepare.PrepareConfig("main", chunking=chunking.ChunkConfig("recursive", 100, 0))
    found = prepare.prepare(spark, str(tmp_path / "in"), str(tmp_path / "out"), config)
    docs = {r["content"]: r for r in found["documents"].collect()}
    assert set(docs) == {"The quick text of a file that is long enough, see for it. Mail , which is gone at the end.", "first document of the list which is in it"}
    first = docs["first document of the list which is in it"]
    assert json.loads(first["metadata"]["statistics"])["word_count"] == 9 and json.loads(first["metadata"]["language"])["language"] == "en"
    assert {r["source"].rsplit("/", 1)[-1]: r["error"] for r in found["errors"].collect()} == {"c.bin": "unknown file type", "d.pdf": "no reader for pdf"}
    assert found["chunks"].count() == 2
    base = f"{tmp_path}/out/{config.name()}"
    again = prepare.rechunk(spark, base, "main", chunking.ChunkConfig("fixed", 100, 0))
    assert again.count() == 2 and {r["method"] for r in again.collect()} == {"fixed"}
    ids = again.select("chunk_id", "doc_id").limit(1)
    sinks.delete_from_collection(spark, f"{base}/chunks", "main", ids)
    assert sinks.read_collection(spark, f"{base}/chunks", "main").count() == 1


def test_upsert_replaces_keys(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", [1.0], "old"), ("b", [2.0], "old"), ("n", None, "none")], "chunk_id string, embedding array<double>, text string")
    sinks.upsert_collection(rows, path, "x")
    sinks.upsert_collection(rows.where("chunk_id = 'a'"), path, "y")
    sinks.upsert_collection(spark.createDataFrame([("b", [3.0], "new"), ("c", [4.0], "new")], rows.schema), path, "x")
    assert {(r["chunk_id"], r["text"]) for r in sinks.read_collection(spark, path, "x").collect()} == {("a", "old"), ("b", "new"), ("c", "new")}
    assert sinks.read_collection(spark, path, "y").count() == 1


def test_versions(spark, tmp_path):
    path, copy = str(tmp_path / "v"), str(tmp_path / "w")
    one, two = (spark.createDataFrame([(1, q)], "pair_id long, question string") for q in ("a", "b"))
    with pytest.raises(ValueError):
        sinks.read_version(spark, path)
    assert [sinks.create_version(x, path) for x in (one, one, two)] == [1, 1, 2]
    assert sinks.read_version(spark, path).first()["question"] == "b" and sinks.read_version(spark, path, 1).first()["question"] == "a"
    assert sinks.publish(spark, path) == 2
    with pytest.raises(ValueError):
        sinks.create_version(one, path)
    assert {(r["version"], r["is_published"]) for r in sinks.list_versions(spark, path).collect()} == {(1, False), (2, True)}
    assert sinks.fork(spark, path, copy, 1) == 1 and sinks.read_version(spark, copy).first()["question"] == "a"


def test_scan_runs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "r1", "name": "Base run", "created_at": "2024-01-02", "metrics": {"precision_at_k": 0.5}, "results": [{"query": "q", "score": 0.2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "r2", "name": "other", "created_at": "2024-01-03"}))
    (tmp_path / "c.json").write_text("{broken")
    good, bad = runs.scan_runs(spark, str(tmp_path))
    assert {r["id"] for r in good.collect()} == {"r1", "r2"} and [r["file"].rsplit("/", 1)[-1] for r in bad.collect()] == ["c.json"]
    assert [r["id"] for r in runs.list_runs(good, "BASE").collect()] == ["r1"] and [r["id"] for r in runs.list_runs(good).collect()] == ["r2", "r1"]


def test_importers_of_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("answer\tquestion\nblue\twhich colour\n")
    (tmp_path / "b.tsv").write_text("which colour\tblue\n")
    for name in "ab":
        assert [(r["question"], r["expected_answer"]) for r in importers.import_pairs(spark, "msmarco", str(tmp_path / f"{name}.tsv")).collect()] == [("which colour", "blue")]
    (tmp_path / "n.json").write_text(json.dumps([{"question": "q1", "answer": "a1"}, {"question": "q2", "answer": "a2"}], indent=1))
    (tmp_path / "m.jsonl").write_text('{"question": "q1", "answer": "a1"}\n{bad\n{"question": "q2", "answer": "a2"}\n')
    for name in ("n.json", "m.jsonl"):
        assert {r["question"] for r in importers.import_pairs(spark, "natural_questions", str(tmp_path / name)).collect()} == {"q1", "q2"}


def test_topk_among(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    found = retrieval.vector_topk(rows, F.col("vec_id") == 1, 2, among=F.col("vec_id") > 3).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 4), (1, 5)]
