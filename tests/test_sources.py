"""Files of all types in one folder, and collections that are upserted, emptied and replaced."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import prepare
from corpuslab.sources import files, sinks


@pytest.fixture
def folder(tmp_path):
    long = "a description that is clearly longer than fifty characters in every row of it"
    (tmp_path / "a.csv").write_text(f'id,description\n1,"{long}, one"\n2,"{long},\n\ntwo"\n')
    (tmp_path / "b.csv").write_text("name,code\nAlice,A\n\nBob,\n")
    (tmp_path / "empty.csv").write_text("\n")
    (tmp_path / "broken.csv").write_text('a,b\n"x,1\n')
    (tmp_path / "list.json").write_text(json.dumps([{"text": "first"}, {"n": 1, "title": None}, {"text": 5, "body": "second"}, "third"]))
    (tmp_path / "cut.json").write_text('[{"text": "hello wor')
    (tmp_path / "word.json").write_text("hello")
    (tmp_path / "numbers.json").write_text('{"text": 12345678901234}')
    (tmp_path / "t.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "p.pdf").write_bytes(b"one|two")
    (tmp_path / "q.pdf").write_bytes(b" ")
    return str(tmp_path)


def name(r):
    return r["source"].rsplit("/", 1)[-1]


def test_every_file_is_a_document_or_an_error(spark, folder):
    docs, errors = prepare.load(spark, folder, pages_of=lambda blob: blob.decode().split("|"))
    found = {}
    for r in docs.collect():
        found.setdefault(name(r), []).append(r["content"])
    assert sorted(found["list.json"]) == ["first", "second", "third"] and found["t.txt"] == ["é"] and sorted(found["p.pdf"]) == ["one", "two"]
    assert found["numbers.json"] == ['{"text": 12345678901234}']
    assert len(found["a.csv"]) == 2 and all(c.startswith("description: a description") for c in found["a.csv"])
    assert sorted(found["b.csv"]) == ["name: Alice\ncode: A", "name: Bob"]
    bad = {name(r): r["error"] for r in errors.collect()}
    assert set(bad) == {"empty.csv", "broken.csv", "cut.json", "word.json", "q.pdf"} and not set(bad) & set(found)


def test_csv_files_as_one_table(spark, folder):
    one = files.read_csv(spark, f"{folder}/a.csv").select("content", "csv_columns").collect()
    other = files.read_csv_files(spark, folder).where(F.col("source").endswith("/a.csv")).select("content", "csv_columns").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_file_types(spark):
    rows = spark.createDataFrame([("x", "application/csv"), ("a.MD", None), ("b.zip", None)], "p string, m string")
    assert [r[0] for r in rows.select(files.file_type(F.col("p"), F.col("m"))).collect()] == ["csv", "md", None]


def keys(spark, path, collection):
    return sorted((r["chunk_id"], r["text"]) for r in sinks.read_collection(spark, path, collection).collect())


def test_collections(spark, tmp_path):
    path = str(tmp_path / "chunks")

    def chunks(*rows):
        return spark.createDataFrame([(i, t, [1.0] if t else None) for i, t in rows], "chunk_id string, text string, embedding array<double>")

    sinks.upsert_collection(chunks(("1", "a"), ("1", "b"), ("2", "c"), ("3", None)), path, "x")
    sinks.upsert_collection(chunks(("1", "other"),), path, "y")
    first = keys(spark, path, "x")
    assert len(first) == 2 and first[1] == ("2", "c") and first[0][1] in ("a", "b")
    sinks.upsert_collection(chunks(("2", "d"), ("2", "d"), ("4", "e")), path, "x")
    assert keys(spark, path, "x") == [first[0], ("2", "d"), ("4", "e")]
    sinks.delete_from_collection(spark, path, "x", spark.createDataFrame([("1",), ("2",), ("4",)], "chunk_id string"))
    assert keys(spark, path, "x") == [] and keys(spark, path, "y") == [("1", "other")]
    sinks.upsert_collection(chunks(("5", "f"),), path, "x")
    sinks.replace_collection(chunks(("6", None),), path, "x")
    assert keys(spark, path, "x") == []
    assert not [p for p in (tmp_path / "chunks").iterdir() if p.name.startswith("_staged")]
