"""Scenarios with results worked out by hand, and brute force where SQL is too slow."""

import html
import json

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.operators import chunking, curate, metrics, stats
from corpuslab.sources import files, importers, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "value, column, expected",
    [
        ("Hello    world   with    multiple   spaces", text.squeeze_whitespace, "Hello world with multiple spaces"),
        ("Paragraph one.\n\nParagraph two.", text.squeeze_whitespace, "Paragraph one. Paragraph two."),
        ("There are 42 items in the list.", text.strip_page_numbers, "There are 42 items in the list."),
        ("Content here\n\n42\n\nMore content", text.strip_page_numbers, "Content here\nMore content"),
        ("Short head\nThis line is certainly longer than thirty.", text.strip_short_lines, "This line is certainly longer than thirty."),
        ("a [1, 2] b (Smith et al., 2024) c [Doe99]", text.strip_citations, "a  b  c "),
        ("x@y.com and 555-123-4567", text.remove_pii, "[EMAIL] and [PHONE]"),
        ("“a”…", text.normalize_unicode, '"a"...'),
        ("é", text.normalize_unicode, "é"),
        ("<a href='u'>t</a> &lt;b&gt;x&lt;/b&gt; &amp;", text.strip_html, "t (u) x &"),
        ("keep", lambda c: text.apply_pattern(c, "(["), "keep"),
        ("```x@y.com``` x@y.com", lambda c: text.clean(c, preserve_code=True), "```x@y.com``` "),
    ],
)
def test_cleaning(spark, value, column, expected):
    assert one(spark, value, column) == expected


def test_html_entities_as_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(text.unescape_entities(F.col("html")).alias("a"), "html").collect()
    assert all(r["a"] == html.unescape(r["html"]) for r in rows)


def test_fixed_chunks():
    assert chunking.fixed_chunks("aaaa\nbbbb\ncccc", 9, 4) == ["aaaa\nbbbb", "bbbb\ncccc"]
    assert chunking.fixed_chunks("a" * 30 + "\nb", 10, 0) == ["a" * 30, "b"]
    assert chunking.fixed_chunks("", 10, 0) == [] and chunking.fixed_chunks(None, 10, 0) == []


def test_recursive_chunks():
    assert chunking.recursive_chunks("one two\n\nthree four", 10, 0) == ["one two", "three four"[:5], "four"]
    chunks = chunking.recursive_chunks("word " * 300, 100, 20)
    assert len(chunks) > 1 and max(map(len, chunks)) <= 100
    with pytest.raises(ValueError):
        chunking.ChunkConfig("recursive", 500, 500)


def test_ngram_contamination_brute_force(spark):
    items = [(1, "the quick brown fox"), (2, "zzzz"), (3, "lorem ipsum dolor")]
    docs = [(1, "a quick brown dog ran"), (2, "The  quick brown fox jumped"), (3, "nothing here"), (4, "dolor sit lorem ipsum")]
    got = {r["item_id"]: (r["doc_id"], r["overlap"]) for r in curate.contaminated_ngrams(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def grams(t):
        t = " ".join(t.lower().split())
        return {t[i : i + 5] for i in range(len(t) - 4)}

    expected = {}
    for i, a in items:
        for d, b in docs:
            x, y = grams(a), grams(b)
            if x and y and len(x & y) / min(len(x), len(y)) >= 0.3:
                expected.setdefault(i, (d, round(len(x & y) / min(len(x), len(y)), 6)))
    assert got == expected


def test_statistics(spark):
    assert abs(stats.incomplete_beta(2.0, 3.0, 0.4) - 0.5248) < 1e-9
    assert abs(stats.incomplete_beta(0.5, 0.5, 0.5) - 0.5) < 1e-9
    pairs = spark.createDataFrame([("a", float(i), float(i) + 1.0 + 0.1 * (i % 3)) for i in range(10)] + [("b", 1.0, 1.0)], "group string, a double, b double")
    t = {r["group"]: r for r in stats.paired_t_test(pairs).collect()}
    assert t["a"]["p"] < 0.001 and t["b"]["p"] == 1.0 and t["b"]["t"] == 0.0
    w = {r["group"]: r for r in stats.wilcoxon(pairs).collect()}
    assert w["a"]["w"] == 0.0 and w["a"]["p"] < 0.01 and w["b"]["p"] == 1.0


def test_metrics(spark):
    judged = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "item_id int, rank int, relevant boolean")
    ap = {r["item_id"]: r["value"] for r in metrics.context_precision(judged).collect()}
    assert ap == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}
    answers = spark.createDataFrame([(1, "the cat sat on the mat. dogs can fly higher", "the cat sat on a mat"), (2, "short", "x"), (3, "a long enough claim", "")], "item_id int, answer string, context string")
    assert {r["item_id"]: r["value"] for r in metrics.faithfulness(answers).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "first"}, {"id": 1}, "plain", {"body": "second"}]))
    (tmp_path / "b.json").write_text(json.dumps({"n": 5}))
    rows = files.read_json(spark, str(tmp_path)).collect()
    assert sorted(r["content"] for r in rows) == sorted(["first", "plain", "second", '{"n": 5}'])
    (tmp_path / "l.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "u.txt").write_bytes("日本".encode())
    assert {r["content"] for r in files.read_text(spark, str(tmp_path)).collect()} == {"café", "日本"}
    (tmp_path / "c.csv").write_text("id,name,description\n1,Al," + "long " * 30 + "\n2,Bo,\n")
    assert [r["content"].startswith("description: long") for r in files.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [True, False]


def test_importers(spark, tmp_path):
    squad = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [
        {"id": "1", "question": "q1", "is_impossible": False, "answers": [{"text": "a"}, {"text": "a"}, {"text": "b"}]},
        {"id": "2", "question": "q2", "is_impossible": True, "answers": []}, {"id": "3", "question": " ", "answers": [{"text": "x"}]}]}]}]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(squad))
    rows = importers.import_pairs(spark, "squad", str(path)).collect()
    assert [(r["question"], r["expected_answer"], r["alternative_answers"]) for r in rows] == [("q1", "a", ["b"])]
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"query_id": "1", "query": "q", "answers": ["No Answer Present."], "wellFormedAnswers": ["w"]}, {"query_id": "2", "query": "z", "answers": ["a", "b"]}]))
    rows = importers.import_pairs(spark, "msmarco", str(path)).orderBy("source_id").collect()
    assert [(r["expected_answer"], r["alternative_answers"]) for r in rows] == [("w", []), ("a", ["b"])]
    with pytest.raises(ValueError):
        importers.import_pairs(spark, "other", str(path))


def test_versions(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "q", "a")], "pair_id int, question string, answer string")
    path = str(tmp_path / "v")
    assert sinks.write_version(pairs, path, 1, published=True) == 1
    assert sinks.write_version(pairs, path, 2) == 1
    assert sinks.write_version(pairs.union(pairs), path, 2) == 2


def test_vectors_in_bounded_blocks(spark, monkeypatch):
    """Small blocks, ties at the precision of the result, and many tokens of one owner give what a whole scan gives."""
    import numpy as np
    from pyspark.sql import functions as F

    from corpuslab.operators import curate, retrieval

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(curate, "BLOCK_ROWS", 16)
    x = np.random.default_rng(4).normal(size=(120, 6))
    # Ties in the sixth digit: the smaller id comes first although its score is lower in the ninth.
    for i in range(1, 9):
        x[i] = x[0] + (9 - i) * 1e-5 * np.eye(6)[i % 6]
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b", [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    cos = np.round(unit @ unit.T, 6)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.vector_topk(rows, F.col("vec_id") % 4 == 0, 3).collect()}
    assert got == {(q, n + 1): v for q in range(0, 120, 4) for n, v in enumerate(sorted((i for i in range(120) if i != q), key=lambda i: (-cos[q, i], i))[:3])}
    pairs = {(r["i"], r["j"]) for r in curate.similar_vectors(rows, 0.5).collect()}
    assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if cos[i, j] >= 0.5}
    tokens = rows.select(F.col("label").alias("owner"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    asked = spark.createDataFrame([(q, d) for q in "ab" for d in "ab"], "query_id string, doc_id string")
    scores = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.maxsim(asked, tokens).collect()}
    part = {"a": x[:90], "b": x[90:]}
    assert all(abs(scores[q, d] - (part[q] @ part[d].T).max(axis=1).sum()) < 1e-5 for q in "ab" for d in "ab") and len(scores) == 4


def test_incomplete_beta_as_an_expression(spark):
    """The fold over columns agrees with the loop, over the whole range of parameters."""
    rows = [(a, b, x) for a in (0.5, 1.0, 2.5, 17.0, 50.0) for b in (0.5, 1.0, 3.0, 40.0) for x in (0.0, 1e-6, 0.05, 0.3, 0.5, 0.77, 0.999, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double, x double").withColumn("i", stats.incomplete_beta_column(F.col("a"), F.col("b"), F.col("x"))).collect()
    assert len(got) == len(rows) and all(abs(r["i"] - stats.incomplete_beta(r["a"], r["b"], r["x"])) < 1e-9 for r in got)
    few = spark.createDataFrame([(0.0, 0), (None, 3), (2.0, 1), (2.0, 5), (2.0, 300)], "t double, df int").select(stats.t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    assert few[0]["p"] is None and few[1]["p"] is None
    assert [round(r["p"], 4) for r in few[2:]] == [0.2952, 0.1019, 0.0455]


def test_untrusted_patterns_are_interrupted(spark):
    """A pattern of exponential time leaves its row as it is, in bounded time; other rows are replaced."""
    import time

    rows = spark.createDataFrame([("a" * 60 + "!",), ("aaab",), (None,)], "t string")
    began = time.time()
    got = [r[0] for r in rows.coalesce(1).select(text.apply_untrusted_pattern(F.col("t"), r"(a|aa)+b|(a|a)+\$", "X", 0.3)).collect()]
    assert got == ["a" * 60 + "!", "X", None] and time.time() - began < 30
    assert [r[0] for r in rows.select(text.apply_untrusted_pattern(F.col("t"), "(")).collect()] == [r[0] for r in rows.collect()]


def test_poisson_bootstrap(spark):
    """Weights are Poisson(1) and unrelated; the interval is that of the textbook; parts of any size agree."""
    import numpy as np

    w = stats.resample_weights(np.arange(3000), 400, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:50])[np.triu_indices(50, 1)]).max() < 0.3 and np.abs(np.corrcoef(w.T[:50])[np.triu_indices(50, 1)]).max() < 0.1
    rng = np.random.default_rng(1)
    values = rng.normal(5, 2, 2000)
    rows = [("a", i, float(v)) for i, v in enumerate(values)] + [("b", 0, 1.0), ("c", 0, None)]
    df = spark.createDataFrame(rows, "group string, ix long, value double")
    got = {r["group"]: r for r in stats.poisson_bootstrap(df.repartition(7)).collect()}
    assert set(got) == {"a", "b"} and got["b"]["low"] == got["b"]["high"] == 1.0
    se = values.std() / np.sqrt(len(values))
    assert abs(got["a"]["std_error"] / se - 1) < 0.1 and abs((got["a"]["high"] - got["a"]["low"]) / (2 * 1.96 * se) - 1) < 0.12
    assert {r["group"]: r for r in stats.poisson_bootstrap(df.coalesce(1)).collect()} == got
