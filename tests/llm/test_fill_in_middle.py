"""The fill-in-the-middle transformation against plain Python, and its defined cases."""

import hashlib
import random

from pyspark.sql import functions as F

from corpuslab.llm import fill_in_middle as fim


def by_hand(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"


def test_against_python(spark):
    rnd = random.Random(1)
    letters = ["a", " ", "\n", "\r", "\u0001", "\u0002", "0", "1", "<", "S", ">", "$", "\\", "é", "é", "\U0001f600", " ", "中", "﻿"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice((0, 1, 2, 5, 30, 400)))) for _ in range(400)]
    texts += ["a<P>b", "<S", None, "", "x" * 200_000, "\u0001\u0002" * 500]
    rows = [(i if i % 17 else None, t, "other") for i, t in enumerate(texts)] + [(1, "twice", "a"), (1, "twice", "a")]
    # Columns whose names the operator makes itself.
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    made = fim.transform(docs)
    found = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    mine = [(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in found]
    assert sorted(mine, key=key) == sorted([(i, t or "", *by_hand(i, t)) for i, t, _ in rows], key=key)
    assert all(r["back"] == r["text"] for r in found)
    assert {"plain", "psm", "spm"} == {r["form"] for r in found}


def test_words_and_lines(spark):
    texts = ["one two  three\nfour", " lead", "tail \n", "", "a\n\nb\n", "x\u0001y\u0002 z\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {"words": [4, 1, 2, 0, 3, 3], "lines": [2, 1, 1, 0, 3, 1]}
    for unit, expected in counts.items():
        found = fim.transform(docs, unit, rates=fim.Rates(transformed=100)).orderBy("doc_id").collect()
        assert [r["n"] for r in found] == expected
        for r in found:
            if r["form"] != "plain":
                assert r["prefix"] + r["middle"] + r["suffix"] == r["text"]


def test_empty_table_and_digests(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = fim.digests(fim.transform(docs))
    assert found.count() == 0
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
