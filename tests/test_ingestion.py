"""Paged rows in batches and streams, contents in keyed state, late events, folders prepared again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import chunking, prepare
from corpuslab.sources.paged import PagedSource
from corpuslab.streaming import streams


def paged(spark, tmp_path, n):
    place = str(tmp_path / "rows.jsonl")
    with open(place, "w") as f:
        f.writelines(json.dumps({"id": i, "text": f"row {i} é"}) + "\n" for i in range(n))
    tests = os.path.dirname(os.path.abspath(__file__))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([tests, known])
    os.environ["PAGED_ROWS"] = spark.sparkContext.environment["PAGED_ROWS"] = place
    spark.dataSource.register(PagedSource)
    options = {"fetcher": "page_fixture:fetch", "counter": "page_fixture:count", "page": "5", "partition": "13", "wait": "0.01"}
    import page_fixture

    page_fixture.PLACE = place
    return options


def test_paged_rows(spark, tmp_path):
    options = paged(spark, tmp_path, 60)
    batch = spark.read.format("paged").options(**options).load()
    rows = batch.select("row_number", F.from_json("json", "id long, text string").alias("r")).select("row_number", "r.*").orderBy("row_number").collect()
    assert [tuple(r) for r in rows] == [(i, i, f"row {i} é") for i in range(60)] and batch.rdd.getNumPartitions() == 5

    def run():
        stream = spark.readStream.format("paged").options(**options).load()
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        job.awaitTermination()
        return sorted(r["row_number"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(60))
    with open(tmp_path / "rows.jsonl", "a") as f:
        f.writelines(json.dumps({"id": i}) + "\n" for i in range(60, 75))
    assert run() == list(range(75))
    with pytest.raises(Exception, match="gone"):
        spark.read.format("paged").options(**(options | {"fetcher": "page_fixture:fails", "retries": "1"})).load().count()


def test_contents_are_remembered(spark, tmp_path):
    """A content's first document is remembered from run to run, and forgotten after its time."""
    folder = tmp_path / "in"
    folder.mkdir()

    def more(n, rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))

    def run(ttl="1 hour"):
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(folder))
        streams.run_again(streams.first_of_content(stream, ttl), str(tmp_path / "run"), timers=True)
        return {r["doc_id"]: r["duplicate_of"] for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()}

    more(1, [(5, "a"), (3, "a"), (4, "b"), (6, None), (7, None)])
    assert run() == {3: None, 5: 3, 4: None, 6: None, 7: None}
    more(2, [(1, "a"), (2, "c"), (8, "b")])
    assert run() == {3: None, 5: 3, 4: None, 6: None, 7: None, 1: 3, 2: None, 8: 4}


def test_late_events_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def more(*rows):
        events = spark.createDataFrame(rows, "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        events.coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(folder))
        streams.run_again(streams.tumbling_counts(stream), str(tmp_path / "run"))
        return {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(str(tmp_path / "run" / "out")).collect()}

    more(("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-02 10:00:00", 1.0))
    assert run() == {"2024-01-01": 1}
    # The first is within the watermark's day still open, the second later than its day's end.
    more(("a", "2024-01-02 01:00:00", 1.0), ("a", "2024-01-01 11:00:00", 1.0), ("a", "2024-01-03 02:00:00", 1.0))
    assert run() == {"2024-01-01": 1, "2024-01-02": 2}


def test_only_changed_files_are_prepared(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    long = "a text of this file that is long enough to be kept by the cleaning, number"
    for i in range(4):
        (folder / f"f{i}.txt").write_text(f"{long} {i}")
    (folder / "bad.bin").write_bytes(b"x")
    config = prepare.PrepareConfig("main", chunking=chunking.ChunkConfig("fixed", 200, 0))
    assert prepare.find_prepared(spark, out, config) is None

    def run():
        found = prepare.prepare_changed(spark, str(folder), out, config)
        docs = {r["source"].rsplit("/", 1)[-1]: (r["content"], r["batch"]) for r in found["documents"].collect()}
        assert {r["text"] for r in found["chunks"].collect()} == {c for c, _ in docs.values()}
        return docs, {r["source"].rsplit("/", 1)[-1] for r in found["errors"].collect()}

    first, errors = run()
    assert set(first) == {f"f{i}.txt" for i in range(4)} and errors == {"bad.bin"}
    assert run() == (first, errors)
    # Same length and time: taken for unchanged, so the new content shows that it was not read.
    before = os.stat(folder / "f0.txt")
    (folder / "f0.txt").write_text(f"{long} 9")
    os.utime(folder / "f0.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    (folder / "f1.txt").write_text(f"{long} one, which is another")
    (folder / "f2.txt").unlink()
    (folder / "bad.bin").unlink()
    (folder / "new.txt").write_text(f"{long} new")
    second, errors = run()
    assert errors == set() and second["f0.txt"] == first["f0.txt"] and second["f3.txt"] == first["f3.txt"]
    assert set(second) == {"f0.txt", "f1.txt", "f3.txt", "new.txt"} and second["f1.txt"][0].endswith("another") and second["f1.txt"][1] == second["new.txt"][1] != first["f1.txt"][1]
    assert prepare.find_prepared(spark, out, config)["documents"].count() == 4
