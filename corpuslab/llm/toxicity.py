"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

A document's features are the distinct character n-grams of its words (with word boundaries, and
whole words), hashed. A feature's value is its naive Bayes log-count ratio: the log of the share of
toxic documents that have it over the share of the others that do, with ``prior`` documents that
have it added to both classes in proportion to their sizes, so that rare features stay near 0.
Features with a ratio below ``least_ratio`` tell the classes apart too little and are left out. A
logistic regression is trained on those values by AdaGrad.

The classifier is fitted on a bounded sample: the ``n_train`` labelled documents with the
smallest hashes (whole texts). Everything else runs on every document. Scoring keeps one
scalar for each n-gram; a word's n-grams are looked up once in a worker and kept.

Defined cases: null and empty texts have no features and get the score of the bias; null labels
are no training rows; without training rows, or with one label only, the score is the share of
label 1 smoothed by one half; documents labelled more than once count each time; repeated rows
get equal scores; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_udf, short_batches

WORD = re.compile(r"[^\W\d_]+")
N_BITS = 18
SIZES = (2, 3, 4, 5)
#: Words whose n-grams a worker keeps, and texts whose new words are hashed together.
WORDS_KEPT = 500_000
TEXTS_TOGETHER = 200


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word): the hashed n-grams of many words in boundary marks, and the whole words."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    within = np.arange(len(points)) - starts[owner]
    left = lengths[owner] - within
    ids, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        has = np.flatnonzero(left >= n)
        h[has] = (h[has] + points[has + n - 1]) * np.uint64(0x9E3779B97F4A7C15)
        if n in SIZES:
            ids.append(_mixed(h[has] + np.uint64(n)) >> np.uint64(64 - N_BITS))
            owners.append(owner[has])
    powers = _mixed(np.arange(1, int(lengths.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points + np.uint64(7)) * powers[within])])
    ids.append(_mixed(upto[starts + lengths] - upto[starts]) >> np.uint64(64 - N_BITS))
    owners.append(np.arange(len(marked)))
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a whole text."""
    words = list(set(WORD.findall(text.lower()))) if text else []
    return np.unique(ngrams(words)[0]) if words else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    #: For each n-gram: its ratio times its weight.
    values: np.ndarray
    bias: float


def fit(texts: list[str | None], labels: list[int], prior: float = 10.0, least_ratio: float = 0.3, rounds: int = 100, rate: float = 0.1, decay: float = 1e-4) -> Model:
    size = 1 << N_BITS
    y = np.asarray(labels, np.float64)
    n, n_toxic = len(y), float(y.sum())
    share = (n_toxic + 0.5) / (n + 1.0)
    if not 0 < n_toxic < n:
        return Model(np.zeros(size), float(np.log(share / (1.0 - share))))
    with_it, toxic_with_it = np.zeros(size), np.zeros(size)
    for text, label in zip(texts, labels):
        ids = features(text)
        with_it[ids] += 1.0
        toxic_with_it[ids] += label
    toxic_share = (toxic_with_it + prior * n_toxic / n) / n_toxic
    other_share = (with_it - toxic_with_it + prior * (n - n_toxic) / n) / (n - n_toxic)
    ratio = np.log(toxic_share / other_share)
    ratio[np.abs(ratio) < least_ratio] = 0.0
    # A second reading keeps the few features that count, so that memory follows those.
    found = [ids[ratio[ids] != 0.0].astype(np.int32) for ids in (features(t) for t in texts)]
    ids = np.concatenate(found)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in found])
    values = ratio[ids]
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    b, b2 = float(np.log(share / (1.0 - share))), 1e-8
    for _ in range(rounds):
        z = np.clip(np.bincount(rows, values * w[ids], n) + b, -30.0, 30.0)
        error = 1.0 / (1.0 + np.exp(-z)) - y
        grad = np.bincount(ids, values * error[rows], size) / n + decay * w
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
        grad_b = float(error.mean())
        b2 += grad_b * grad_b
        b -= rate * grad_b / np.sqrt(b2)
    return Model(ratio * w, float(b))


def train(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], n_train: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the ``n_train`` labelled rows with the smallest hashes among those ``usable`` by id.

    Where an id has several documents, the one whose text has the smallest hash stands for it.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & usable(F.col("id")))
    chosen = marks.orderBy(F.xxhash64("id", F.lit(29)), "id", "label").limit(n_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The chosen ids are n_train rows at most, whatever the input.
    chosen = chosen.groupBy("id", "label").agg(F.count("*").cast("int").alias("times"))
    nth = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("text"), "text"))
    sample = rows.join(F.broadcast(chosen), "id").withColumn("nth", nth).where("nth = 1").select("id", "label", "text", "times").collect()
    sample = [r for r in sorted(sample, key=lambda r: (r["id"], r["label"])) for _ in range(r["times"])]
    return fit([r["text"] for r in sample], [r["label"] for r in sample])


class Scorer:
    """Scores texts; it keeps the n-grams that count of the words it has met, up to a bound.

    Most words have none and share one empty entry.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        new = list(words.difference(self.known))
        if not new:
            return
        ids, owner = ngrams(new)
        counts = self.model.values[ids] != 0.0
        found: dict[int, list[int]] = {}
        for i, w in zip(ids[counts].tolist(), owner[counts].tolist()):
            found.setdefault(w, []).append(i)
        none: tuple[int, ...] = ()
        self.known.update((w, tuple(found[n]) if n in found else none) for n, w in enumerate(new))

    def __call__(self, texts) -> list[float]:
        scores: list[float] = []
        texts = list(texts)
        values = self.model.values
        for first in range(0, len(texts), TEXTS_TOGETHER):
            sets = [set(WORD.findall(t.lower())) if t else set() for t in texts[first : first + TEXTS_TOGETHER]]
            self.learn(set().union(*sets))
            for words in sets:
                ids = list({i for found in map(self.known.__getitem__, words) if found for i in found})
                z = self.model.bias + (float(values[np.sort(np.array(ids))].sum()) if ids else 0.0)
                scores.append(float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z))))))
        return scores


_scorer: list = [None, None]


def scorer_of(name: str, shared) -> Scorer:
    """The worker's scorer for a model; a worker that runs several tasks keeps it."""
    if _scorer[0] != name:
        _scorer[:] = name, Scorer(shared.value)
    return _scorer[1]


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of label 1 of the whole text."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the input
    name = xxhash.xxh3_64_hexdigest(model.values.tobytes()) + repr(model.bias)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(name, shared)
        for texts in batches:
            yield pd.Series(scorer(texts), dtype="float64")

    return docs.withColumn(out_col, arrow_udf(score, "double")(F.col(text_col)))
