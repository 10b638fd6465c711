"""Language of texts by a linear-chain conditional random field over words.

Each word has a label, its language. A word's emission scores are sums of learned weights over
its affixes, its character n-grams and itself (the lexicon), hashed; the scores of a label after
another are learned as well. Forward-backward over a line's words gives each word's probability
of each label, so code-switched text keeps its parts apart; a document's language is the label
with the largest mean probability over all of its words, and that mean is its score.

The field is fitted by full-batch AdaGrad on a bounded sample: for each language the
``n_per_lang`` usable documents with the smallest hashes (whole texts), every word labelled with
its document's language. Every document is labelled whole. Lines are the chains; a line of more
than ``CHAIN`` words is cut into consecutive chains of that length.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages
are no training rows; with one learned language every text with a letter gets it; without any,
everything is ``und``; ties go to the language first by code point; repeated rows get equal
results; an empty table gives no rows. Only the named columns are read.
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
LINE_BREAKS = re.compile(r"[\n\r]+")
CHAIN = 256
N_BITS = 16
PREFIXES, SUFFIXES, INNER = (1, 2, 3), (1, 2, 3, 4), (2, 3)
UNKNOWN = "und"
#: Distinct words whose emissions a worker keeps, and words of a forward-backward pass.
WORDS_KEPT = 250_000
PASS_WORDS = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def featurize(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of many words at once: affixes, inner n-grams and the words themselves.

    Code points are hashed by position arrays; a feature's kind and length are part of its hash.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    within = np.arange(len(points)) - starts[owner]
    left = lengths[owner] - within
    features, owners = [], []

    def add(first: np.ndarray, n: int, kind: int) -> None:
        h = np.full(len(first), kind * 16 + n, np.uint64)
        for i in range(n):
            h = (h + points[first + i]) * np.uint64(0x9E3779B97F4A7C15)
        features.append(_mixed(h) >> np.uint64(64 - N_BITS))
        owners.append(owner[first])

    for n in PREFIXES:
        add(starts[lengths >= n], n, 1)
    for n in SUFFIXES:
        add((starts + lengths - n)[lengths >= n], n, 2)
    for n in INNER:
        add(np.flatnonzero(left >= n), n, 3)
    powers = _mixed(np.arange(1, int(lengths.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(points + np.uint64(7)) * powers[within])])
    features.append(_mixed(upto[starts + lengths] - upto[starts]) >> np.uint64(64 - N_BITS))
    owners.append(np.arange(len(words)))
    return np.concatenate(features).astype(np.int64), np.concatenate(owners)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Emission scores of words: sums of their features' weights."""
    features, owner = featurize(words)
    return np.stack([np.bincount(owner, weights[features, j], len(words)) for j in range(weights.shape[1])], axis=1)


def chains(text: str) -> list[list[str]]:
    found = []
    for line in LINE_BREAKS.split(text.lower()):
        # Numerals such as fractions count as word characters; a word needs a letter.
        words = [w for w in WORD.findall(line) if w.isalpha() or any(map(str.isalpha, w))]
        found.extend(words[i : i + CHAIN] for i in range(0, len(words), CHAIN))
    return found


def potentials(emit: np.ndarray) -> np.ndarray:
    return np.exp(emit - emit.max(axis=1, keepdims=True))


def forward_backward(psi: np.ndarray, lengths: np.ndarray, trans: np.ndarray, want_pairs: bool = False):
    """Label probabilities of each word of chains that lie one after another in ``psi``.

    Chains advance together: step t handles the t-th word of every chain that has one. Returns
    the probabilities in the order of ``psi`` and, if wanted, the expected label pairs.
    """
    n_labels = psi.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")
    move = np.exp(trans)
    alpha = np.empty_like(psi)
    before = np.full((len(order), n_labels), 1.0 / n_labels)
    for t in range(steps):
        at = starts[: active[t]] + t
        now = psi[at] * (before[: active[t]] @ move if t else before[: active[t]])
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = before = now
    probs = np.empty_like(psi)
    pairs = np.zeros((n_labels, n_labels))
    after = np.ones((len(order), n_labels))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        now = alpha[at] * after[:k]
        now /= now.sum(axis=1, keepdims=True)
        probs[at] = now
        ahead = psi[at] * after[:k]
        if want_pairs and t:
            joint = alpha[at - 1][:, :, None] * move[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        ahead = ahead @ move.T
        after[:k] = ahead / ahead.sum(axis=1, keepdims=True)
    return probs, pairs


@dataclass(frozen=True)
class Field:
    labels: tuple[str, ...]
    weights: np.ndarray  # features x labels
    trans: np.ndarray


def fit(texts: list[str], langs: list[str], rounds: int = 15, rate: float = 0.3, decay: float = 1e-6) -> Field:
    labels = tuple(sorted(set(langs)))
    n_labels, size = len(labels), 1 << N_BITS
    weights, trans = np.zeros((size, n_labels)), np.zeros((n_labels, n_labels))
    types: dict[str, int] = {}
    ids, gold, lengths = [], [], []
    for text, lang in zip(texts, langs):
        for chain in chains(text):
            ids.extend(types.setdefault(w, len(types)) for w in chain)
            gold.extend([labels.index(lang)] * len(chain))
            lengths.append(len(chain))
    if n_labels < 2 or not ids:
        return Field(labels, weights, trans)
    ids, gold, lengths = np.array(ids), np.array(gold), np.array(lengths)
    columns, rows = featurize(list(types))
    observed = np.zeros((len(types), n_labels))
    np.add.at(observed, (ids, gold), 1.0)
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths) - lengths] = False
    seen_pairs = np.zeros((n_labels, n_labels))
    np.add.at(seen_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1.0)
    w2, t2 = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(rounds):
        by_type = potentials(np.stack([np.bincount(rows, weights[columns, j], len(types)) for j in range(n_labels)], axis=1))
        expected, pairs = np.zeros_like(observed), np.zeros_like(trans)
        for span, part in passes(lengths):
            probs, some = forward_backward(by_type[ids[span]], part, trans, True)
            pairs += some
            for j in range(n_labels):
                expected[:, j] += np.bincount(ids[span], probs[:, j], len(types))
        gap = (expected - observed) / len(ids)
        grad = np.stack([np.bincount(columns, gap[rows, j], size) for j in range(n_labels)], axis=1) + decay * weights
        w2 += grad * grad
        weights -= rate * grad / np.sqrt(w2)
        grad = (pairs - seen_pairs) / len(ids) + 1e-3 * trans
        t2 += grad * grad
        trans -= rate * grad / np.sqrt(t2)
    return Field(labels, weights, trans)


def passes(lengths: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Consecutive chains in groups of about ``PASS_WORDS`` words, with the words' slice."""
    upto = np.cumsum(lengths)
    first, begun = 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(upto, begun + PASS_WORDS, side="right")))
        yield slice(begun, int(upto[last - 1])), lengths[first:last]
        first, begun = last, int(upto[last - 1])


class Labeller:
    """Labels texts; it keeps the potentials of the words it has met, up to a bound."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 14, len(field.labels)))

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of the words in the table of potentials."""
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        new = list(set(words).difference(self.known))
        if new:
            at = len(self.known)
            while at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[at : at + len(new)] = potentials(emissions(new, self.field.weights))
            self.known.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def __call__(self, texts) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        texts = list(texts)
        at = 0
        while at < len(texts):
            words: list[str] = []
            lengths: list[int] = []
            counts: list[int] = []
            while at < len(texts) and len(words) < PASS_WORDS:
                before = len(words)
                for chain in chains(texts[at]) if texts[at] else ():
                    words.extend(chain)
                    lengths.append(len(chain))
                counts.append(len(words) - before)
                at += 1
            self._label(words, np.array(lengths, np.int64), np.array(counts, np.int64), langs, scores)
        return langs, scores

    def _label(self, words, lengths, counts, langs, scores) -> None:
        labels = self.field.labels
        if not labels or not words:
            langs.extend([UNKNOWN] * len(counts))
            scores.extend([0.0] * len(counts))
            return
        ids = self.look_up(words)
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = np.zeros((len(counts), len(labels)))
        for span, part in passes(lengths):
            probs, _ = forward_backward(self.rows[ids[span]], part, self.field.trans)
            for j in range(len(labels)):
                sums[:, j] += np.bincount(owner[span], probs[:, j], len(counts))
        for total, n in zip(sums, counts):
            best = int(total.argmax())
            langs.append(labels[best] if n else UNKNOWN)
            scores.append(float(min(1.0, total[best] / n)) if n else 0.0)


def train(docs: DataFrame, usable: Callable[[Column], Column], n_per_lang: int = 250, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """A field of the ``n_per_lang`` documents of each language with the smallest hashes.

    Ids and languages alone are ranked; texts are read for the chosen rows. Where ids repeat, as many
    rows of one are taken as were chosen, so the sample is bounded whatever the ids are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & usable(F.col("id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(31)), "id")
    chosen = rows.select("id", "lang").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n_per_lang)
    chosen = chosen.groupBy("id", "lang").agg(F.count("*").alias("wanted"))
    among = F.row_number().over(Window.partitionBy("id", "lang").orderBy(F.xxhash64("text"), "text"))
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).withColumn("among", among).where(F.col("among") <= n_per_lang)
    sample = sample.where("among <= wanted").select("id", "lang", "text").collect()
    sample.sort(key=lambda r: (r["lang"], r["id"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


_labeller: list = [None, None]


def labeller_of(name: str, shared) -> Labeller:
    """The worker's labeller for a field; a worker that runs several tasks keeps it."""
    if _labeller[0] != name:
        _labeller[:] = name, Labeller(shared.value)
    return _labeller[1]


def label_documents(docs: DataFrame, field: Field, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the two columns named, in place of columns that have those names."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # half a MB for each label
    name = xxhash.xxh3_64_hexdigest(field.weights.tobytes() + field.trans.tobytes())

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = labeller_of(name, shared)
        for texts in batches:
            langs, scores = labeller(texts)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    made = arrow_udf(label, "lang_pred string, score double")(F.col(text_col))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    return docs.withColumn("__label", made).select(*kept, F.col("__label.lang_pred").alias(lang_out), F.col("__label.score").alias(score_out))


def word_labels(text: str | None, field: Field) -> list[tuple[str, str, float]]:
    """(word, label, probability) of each word of a text, for code-switched text."""
    found = chains(text or "")
    if not found or not field.labels:
        return []
    words = [w for chain in found for w in chain]
    psi = potentials(emissions(words, field.weights))
    probs, _ = forward_backward(psi, np.array([len(c) for c in found]), field.trans)
    return [(w, field.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, probs)]
