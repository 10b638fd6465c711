"""Light document metadata: statistics, language by marker words, keywords."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import texts_to_rows

# Marker words of languages; ASCII ones, since words are ASCII letters.
MARKERS = {
    "en": ("the", "is", "are", "was", "were", "have", "has", "been", "will", "would"),
    "es": ("el", "la", "los", "las", "es", "son", "fue", "han", "pero"),
    "fr": ("le", "la", "les", "est", "sont", "avoir", "avec", "pour", "mais"),
    "de": ("der", "die", "das", "ist", "sind", "war", "haben", "werden", "mit", "aber"),
    "pt": ("o", "a", "os", "as", "foi", "ter", "com", "para"),
    "it": ("il", "la", "i", "le", "sono", "stato", "avere", "con", "per"),
}
MARKER_COUNT = 10
# English stop words without an apostrophe (words are runs of letters).
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but "
    "by cannot could did do does doing down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or "
    "other ought our ours ourselves out over own same she should so some such than that the their theirs them themselves "
    "then there these they this those through to too under until up very was we were what when where which while who "
    "whom why with would you your yours yourself yourselves"
).split()


def ascii_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z]+\b"), F.lit(0))


def syllables(word: Column) -> Column:
    """Vowel runs after dropping one final e; one at least, and one for up to three letters."""
    stem = F.regexp_replace(F.lower(word), "e$", "")
    runs = F.size(F.regexp_extract_all(stem, F.lit("[aeiouy]+"), F.lit(0)))
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(runs, F.lit(1)))


def two_places(value: Column) -> Column:
    """Two places, half to even on the hundredfold value; the same arithmetic in any engine."""
    return F.rint(value * 100.0) / F.lit(100.0)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and readability of each document, rounded to two places (half to even)."""
    words = docs.select(
        F.col(id_col),
        F.length(text_col).alias("char_count"),
        ascii_words(F.col(text_col)).alias("words"),
        F.size(F.filter(F.split(text_col, "[.!?]+"), lambda x: F.trim(x) != "")).alias("sentence_count"),
    )
    counted = words.select(
        "*",
        F.size("words").alias("word_count"),
        F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)).alias("letters"),
        F.aggregate("words", F.lit(0), lambda a, w: a + syllables(w)).alias("syllable_count"),
    )
    none = (F.col("word_count") == 0) | (F.col("sentence_count") == 0)
    per_sentence = F.try_divide(F.col("word_count").cast("double"), F.col("sentence_count"))
    per_word = F.try_divide(F.col("syllable_count").cast("double"), F.col("word_count"))
    ease = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 206.835 - 1.015 * per_sentence - 84.6 * per_word))
    grade = F.greatest(F.lit(0.0), 0.39 * per_sentence + 11.8 * per_word - 15.59)
    return counted.select(
        id_col,
        F.col("word_count").cast("long").alias("word_count"),
        F.col("char_count").cast("long").alias("char_count"),
        F.col("sentence_count").cast("long").alias("sentence_count"),
        F.col("syllable_count").cast("long").alias("syllable_count"),
        two_places(F.coalesce(F.try_divide(F.col("letters").cast("double"), F.col("word_count")), F.lit(0.0))).alias("avg_word_length"),
        two_places(F.when(none, 0.0).otherwise(ease)).alias("flesch_ease"),
        two_places(F.when(none, 0.0).otherwise(grade)).alias("fk_grade"),
    )


def detect_language(words: Column) -> Column:
    """(language, confidence) by distinct marker words; ties go to the first language."""
    hits = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, m)))).alias("hits"), F.lit(-n).alias("order"), F.lit(code).alias("code")) for n, (code, m) in enumerate(MARKERS.items())]
    best = F.greatest(*hits)
    return F.struct(
        F.when(best["hits"] > 0, best["code"]).otherwise("unknown").alias("language"),
        F.round(best["hits"] / F.lit(float(MARKER_COUNT)), 3).alias("confidence"),
    )


_LETTERS, _STOPS = re.compile("[a-z]+"), frozenset(STOPWORDS)


def rake(sentences: list[str], top: int) -> list[tuple[str, float]]:
    """The best phrases of one document's lower-case sentences, and their scores.

    Phrases are islands between stop words inside a sentence. A word scores the mean length of its
    phrases, a phrase the sum of its words. Ties keep the order of first appearance.
    """
    islands: dict[tuple[int, int], list[str]] = {}
    breaks = 0
    for s, sentence in enumerate(sentences):
        for word in _LETTERS.findall(sentence):
            if len(word) < 2 or word in _STOPS:
                breaks += 1
            else:
                islands.setdefault((s, breaks), []).append(word)
    lengths, counts = Counter(), Counter()
    for words in islands.values():
        for word in words:
            lengths[word] += len(words)
            counts[word] += 1
    best: dict[str, float] = {}
    for words in islands.values():
        phrase = " ".join(words)
        best[phrase] = max(best.get(phrase, 0.0), sum(lengths[w] / counts[w] for w in words))
    rounded = [(phrase, math.floor(score * 1e6 + 0.5) / 1e6) for phrase, score in best.items()]
    return sorted(rounded, key=lambda x: -x[1])[:top]


def rake_keywords(docs: DataFrame, top: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RAKE phrases: (doc, phrase, score, rank), document by document where they are read; nothing is shuffled."""

    def rows_of(lists: list) -> tuple[list[int], list]:
        found = [(at, *x, n + 1) for at, sentences in enumerate(lists) if sentences for n, x in enumerate(rake(sentences, top))]
        return [x[0] for x in found], [[x[i] for x in found] for i in (1, 2, 3)]

    sentences = F.split(F.lower(text_col), "[.!?\\n]")
    return texts_to_rows(docs, id_col, sentences, rows_of, "phrase string, score double, rank int")
