"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the same grams
in the templates. A hit votes for the diagonal ``document position - template position``; a copy
of a template, however its surroundings move it, puts its votes on one diagonal, and a copy with
words added or lost puts them on neighbouring ones. Diagonals with enough votes are merged with
their neighbours and verified: grams count only where their words are the template's, and the
span's share of the template's grams must reach a threshold.
Phrases (templates of a few words) must match whole, on a single diagonal.

The templates are constants of this module, so the table the hits are joined with is bounded by
them, and grams that are in no template are dropped before rows are made of them.

Defined cases: null and empty texts have no words and no labels (score 0); places that overlap
count each; repeated rows (same id and text) get the same result each; an empty table gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, row_key, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases match whole and count as base places.
    phrase: bool = False


# The base phrases and their labels.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
# Notices of well-known licenses, lower case, words only.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("lgpl", "gnu lesser general public license as published by the free software foundation"),
    Template("mit", "licensed under the mit license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEMPLATES = PHRASES + NOTICES


def doc_words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null gives an empty array."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def rolling_grams(words: Column, k: int = K) -> Column:
    """Array of (hash, position) of all k-word grams, in order."""
    grams = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]).alias("gram"), i.alias("at")))
    return F.slice(grams, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def spelled(grams: Column, words: Column, k: int = K) -> Column:
    """The same array with the words of each gram."""
    return F.transform(grams, lambda g: F.struct(g["gram"].alias("gram"), g["at"].alias("at"), F.array_join(F.slice(words, g["at"] + 1, k), " ").alias("said")))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(t, gram, tpos, said) of every template gram; as many rows as the constants have words."""
    rows = ", ".join(f"({t}, '{x.text}')" for t, x in enumerate(templates))
    table = spark.sql(f"SELECT t, split(text, ' ') AS words FROM VALUES {rows} AS v(t, text)")
    grams = table.select("t", F.explode(spelled(rolling_grams(F.col("words"), k), F.col("words"), k)).alias("g"))
    return grams.select("t", F.col("g.gram").alias("gram"), F.col("g.at").alias("tpos"), F.col("g.said").alias("said"))


def scan(
    docs: DataFrame,
    templates=TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_votes: int = 3,
    drift: int = 2,
    least_share: float = 0.75,
) -> tuple[DataFrame, DataFrame]:
    """The documents' word counts, and the verified spans.

    The first frame has doc_id, uid and n_words for each row; the second uid, label, phrase,
    first_word, last_word and share for each span. ``uid`` stands for id and text.
    """
    spark = docs.sparkSession
    table = template_grams(spark, templates)
    known = [r[0] for r in table.select("gram").distinct().collect()]
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("uid"),
        doc_words(F.col(text_col)).alias("words"),
    )
    hits = F.filter(rolling_grams(F.col("words")), lambda g: g["gram"].isin(known))
    scanned = words.select("doc_id", "uid", F.size("words").cast("long").alias("n_words"), spelled(hits, F.col("words")).alias("hits"))
    scanned = written(scanned, "license-hits")

    votes = scanned.select("uid", F.explode("hits").alias("h")).select("uid", F.col("h.gram").alias("gram"), F.col("h.at").alias("at"), F.col("h.said").alias("said"))
    # Hashes bring grams together, their words decide.
    votes = votes.join(F.broadcast(table), ["gram", "said"]).withColumn("diagonal", F.col("at") - F.col("tpos"))
    diagonals = votes.groupBy("uid", "t", "diagonal").agg(F.collect_set("tpos").alias("tposs"))

    facts = [(x.label, x.phrase, len(x.text.split()) - K + 1) for x in templates]
    label = F.get(F.array(*[F.lit(x[0]) for x in facts]), F.col("t"))
    phrase = F.get(F.array(*[F.lit(x[1]) for x in facts]), F.col("t"))
    n_grams = F.get(F.array(*[F.lit(x[2]) for x in facts]), F.col("t"))
    diagonals = diagonals.select("uid", "t", "diagonal", "tposs", label.alias("label"), phrase.alias("phrase"), n_grams.alias("n_grams"))

    whole = diagonals.where(F.col("phrase") & (F.size("tposs") == F.col("n_grams")))
    whole = whole.select("uid", "label", "phrase", F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("n_grams")).cast("long").alias("last_word"), F.lit(1.0).alias("share"))

    voted = diagonals.where(~F.col("phrase") & (F.size("tposs") >= F.least(F.col("n_grams"), F.lit(least_votes))))
    along = Window.partitionBy("uid", "t").orderBy("diagonal")
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > drift).cast("int"), F.lit(0))
    voted = voted.withColumn("starts", starts).withColumn("run", F.sum("starts").over(along))
    merged = voted.groupBy("uid", "t", "label", "phrase", "n_grams", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("tposs"))).alias("seen"),
        F.min(F.col("diagonal") + F.array_min("tposs")).cast("long").alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("tposs") + (K - 1)).cast("long").alias("last_word"),
    )
    merged = merged.withColumn("share", F.size("seen") / F.col("n_grams")).where(F.col("share") >= least_share)
    return scanned.select("doc_id", "uid", "n_words"), whole.unionByName(merged.select("uid", "label", "phrase", "first_word", "last_word", "share"))


def label_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: word count, base places, labels and score."""
    rows, spans = scan(docs, **options)
    by_doc = spans.groupBy("uid").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    found = rows.join(by_doc, "uid", "left")
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.when(F.col("score") > 1, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
