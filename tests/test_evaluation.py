"""The registry, presets, failing metrics, templates, exports, and stages that fail and go on."""

import json

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import evaluation


def answers(spark):
    return spark.createDataFrame([("1", "a claim about the big river", "the big river is here, a claim about nothing"), ("2", "x", "")], "item_id string, answer string, context string")


def test_registry_checks_inputs(spark):
    assert {m["name"] for m in evaluation.metric_info()} >= {"context_precision", "faithfulness", "answer_correctness"}
    with pytest.raises(ValueError, match="needs"):
        evaluation.evaluate({"answer_correctness": answers(spark)})
    with pytest.raises(ValueError, match="unknown metric"):
        evaluation.evaluate({"other": answers(spark)})


def test_presets_and_failing_metrics(spark):
    evaluation.register(evaluation.Metric("broken", ("answer",), lambda rows, t: rows.select("item_id", F.raise_error(F.lit("no such model")).cast("double").alias("value"))))
    try:
        found = evaluation.evaluate({"faithfulness": answers(spark), "broken": answers(spark)}).collect()
    finally:
        del evaluation.REGISTRY["broken"]
    assert {r["item_id"]: r["value"] for r in found if r["metric"] == "faithfulness"} == {"1": 1.0, "2": 0.0}
    bad = [r for r in found if r["metric"] == "broken"]
    assert len(bad) == 1 and bad[0]["value"] == 0.0 and "no such model" in bad[0]["error"]
    judged = spark.createDataFrame([(1, 1, "one two three four", "one two and"), (1, 2, "one two three four", "one")], "item_id long, rank int, question string, content string")
    values = {p: evaluation.evaluate({"precision_at_k": judged}, preset=p).first()["value"] for p in ("strict", "default", "lenient")}
    assert values == {"strict": 0.0, "default": 0.5, "lenient": 1.0}
    both = {"answer_correctness": answers(spark).withColumnRenamed("context", "reference"), "faithfulness": answers(spark)}
    assert {r["metric"] for r in evaluation.evaluate(both, preset="fast").collect()} == {"faithfulness"}


def test_retrieval_presets():
    asked = evaluation.RetrievalSettings(k=9)
    assert evaluation.with_preset(asked, "high_quality") == evaluation.RetrievalSettings(1500, 300, 9, True)


def test_stages_are_retried_and_resumed(spark, tmp_path):
    calls, waits = [], []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return spark.range(3)

    assert evaluation.with_retries(fails_twice, base=1.0, most=1.5, sleep=waits.append).count() == 3 and waits == [1.0, 1.5]
    with pytest.raises(ValueError):
        evaluation.with_retries(lambda: int("x"), sleep=waits.append)
    ran = []

    def stage(name, make, fail=()):
        def run(done):
            ran.append(name)
            if name in fail:
                raise RuntimeError(name)
            return make(done)

        return name, run

    def stages(fail=()):
        return [stage("a", lambda done: spark.range(5), fail), stage("b", lambda done: done["a"].where("id > 1"), fail)]

    with pytest.raises(RuntimeError):
        evaluation.run_stages(spark, stages(("b",)), str(tmp_path / "out"))
    assert evaluation.run_stages(spark, stages(), str(tmp_path / "out"))["b"].count() == 3
    assert ran == ["a", "b", "b"]


def test_exports_and_templates(spark, tmp_path):
    rows = spark.sql("SELECT 'q' AS query, TIMESTAMP '2024-01-02 03:04:05' AS at, 1.5D AS score, array('x', 'y') AS chunks")
    evaluation.export_run(rows, str(tmp_path / "run"))
    line = next(p for p in (tmp_path / "run").iterdir() if p.name.endswith(".json")).read_text()
    assert json.loads(line) == {"query": "q", "at": "2024-01-02 03:04:05", "score": 1.5, "chunks": ["x", "y"]}
    templates = spark.createDataFrame([("b", False, ["x"]), ("A", False, ["y", "z"]), ("c", True, ["x"]), ("d", False, [])], "name string, is_preset boolean, tags array<string>")
    assert [r["name"] for r in evaluation.list_templates(templates).collect()] == ["c", "A", "b", "d"]
    assert [r["name"] for r in evaluation.list_templates(templates, ["x", "z"]).collect()] == ["c", "A", "b"]
