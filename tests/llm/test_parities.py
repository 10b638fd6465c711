"""Parities of sets: a lower bound of their difference, and what it spares the Jaccard join."""

import random

import numpy as np
import pytest

from corpuslab.llm import jaccard_join

from .test_crowds import brute, template_texts
from .test_llm import families


def folded(h, n_words):
    return np.bitwise_xor.reduce(np.frombuffer(jaccard_join.parities(h), np.uint64).reshape(-1, n_words), axis=0)


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for size in (1, 2, 63, 511, 513, 900, 3000):
        for share in (0, 0.5, 0.9, 1):
            x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            y = np.unique(np.concatenate([x[: int(size * share)], rng.integers(0, 1 << 63, 1 + size // 3, dtype=np.uint64)]))
            longest = min(len(jaccard_join.parities(h)) for h in (x, y)) // 8
            for n_words in {jaccard_join.FOLD, longest}:
                apart = int(np.bitwise_count(folded(x, n_words) ^ folded(y, n_words)).sum())
                assert apart <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("small, k, num, den", [(0, 3, 9, 10), (4, 5, 4, 5), (64, 3, 9, 10), (64, 5, 1, 2)])
def test_block_sizes_brute_force(spark, monkeypatch, small, k, num, den):
    """Blocks joined by pairs, by pivots or by either give the same, long texts beside short ones included."""
    monkeypatch.setattr(jaccard_join, "SMALL_BLOCK", small)
    rnd = random.Random(small + k)
    texts = families(small + k) + template_texts(20, small)
    long = [f"l{i}" for i in range(1000)]
    for _ in range(12):
        texts.append(" ".join(x if rnd.random() > 0.02 else f"e{rnd.randrange(9)}" for x in long[: rnd.choice((500, 530, 1000))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, k, num, den).collect()}
    assert found == dict(enumerate(brute(texts, k, num, den)))


def test_related_texts_make_no_sets(spark, monkeypatch):
    """Texts that share half of their words meet in blocks; their whole sets are not made, those of a linked pair are."""
    rnd = random.Random(3)
    shared = [f"s{i}" for i in range(120)]
    texts = [" ".join([*shared, *(f"own{n}x{i}" for i in range(120))]) for n in range(40)]
    linked = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(200))]
    linked.append(linked[0] + " end")
    made, maker = [], jaccard_join._sets_of

    def counted(wanted, texts, k):
        made.append(wanted.count())
        return maker(wanted, texts, k)

    monkeypatch.setattr(jaccard_join, "_sets_of", counted)
    docs = spark.createDataFrame(list(enumerate(texts + linked)), "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).select("component_id").distinct().count() == 41
    assert made == [2]
