"""Curation of question-answer sets: validation, duplicates, contamination, splits, versions.

Pairs are rows (pair_id, question, answer); pair_id gives the order in which "first" is meant.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..functions import text
from ..functions.ranking import global_position
from . import blocks, cosine_join
from .joins import small_side
from .postings import stored
from .retrieval import embed, vector_topk

# Question phrases that ask for more than one fact.
MULTI_HOP = ("and also", "in addition", "as well as", "both", "which of these", "compare", "what are the")


def validate(pairs: DataFrame, min_question: int = 5, min_answer: int = 1) -> DataFrame:
    """One row for each issue: pair_id, severity, field, message. Duplicates include empty questions."""
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    first = F.row_number().over(Window.partitionBy(F.lower(q)).orderBy("pair_id"))
    marked = pairs.select("pair_id", q.alias("q"), a.alias("a"), first.alias("nth"))

    def issue(severity: str, field: str, message: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), message.alias("message"))

    found = F.array(
        F.when(F.col("q") == "", issue("error", "question", F.lit("Empty question"))).when(
            F.length("q") < min_question, issue("warning", "question", F.format_string("Question too short (%d chars)", F.length("q")))
        ),
        F.when(F.col("a") == "", issue("error", "expected_answer", F.lit("Empty answer"))).when(
            F.length("a") < min_answer, issue("warning", "expected_answer", F.format_string("Answer too short (%d chars)", F.length("a")))
        ),
        F.when(F.col("nth") > 1, issue("warning", "question", F.lit("Duplicate question"))),
    )
    issues = marked.select("pair_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    return issues.select("pair_id", "i.severity", "i.field", "i.message")


def distributions(pairs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, value, n): how often each value of some columns stands, with a default for null."""
    named = pairs.select(*[F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c) for c, default in fields.items()])
    long = named.unpivot([], list(fields), "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def duplicate_share(pairs: DataFrame, most: float = 0.1) -> DataFrame:
    """n, n_duplicates (questions after the first, in any case), their share, and whether that is an error."""
    q = F.lower(F.trim(F.coalesce("question", F.lit(""))))
    counted = pairs.groupBy(q.alias("q")).agg(F.count("*").alias("n"))
    found = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    share = F.coalesce(F.try_divide(F.col("n_duplicates").cast("double"), F.col("n")), F.lit(0.0))
    return found.select("n", "n_duplicates", F.round(share, 6).alias("share"), (share > most).alias("too_many"))


def with_lineage(pairs: DataFrame, created_from: str = "generation", model: str | None = None, chunk_id: str | None = None, chunk_text: str | None = None) -> DataFrame:
    """Adds ``lineage``: the source chunk's id and a short hash of its text, the model and how the pair was made."""
    content = F.substring(F.sha2(F.col(chunk_text), 256), 1, 16) if chunk_text else F.lit(None).cast("string")
    source = F.col(chunk_id).cast("string") if chunk_id else F.lit(None).cast("string")
    return pairs.withColumn("lineage", F.struct(source.alias("source_chunk_id"), F.lit(model).cast("string").alias("generation_model"), content.alias("chunk_content_hash"), F.lit(created_from).alias("created_from")))


def with_missing_hashes(pairs: DataFrame) -> DataFrame:
    """Fills in content hashes that older pairs lack; those there are stay."""
    return pairs.withColumn("content_hash", F.coalesce("content_hash", text.content_hash(F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))))


def migration_status(pairs: DataFrame) -> DataFrame:
    """How many pairs have a content hash, and how many do not yet."""
    return pairs.agg(F.count("content_hash").alias("migrated"), F.count_if(F.col("content_hash").isNull()).alias("pending"))


def duplicates(pairs: DataFrame, key: Column) -> DataFrame:
    """All pairs with the id of the first pair of the same key (null for the first itself)."""
    first = F.min("pair_id").over(Window.partitionBy(key))
    return pairs.withColumn("first_id", first).withColumn("duplicate_of", F.when(F.col("first_id") != F.col("pair_id"), F.col("first_id"))).drop("first_id")


def dedup_exact(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept pairs, and removed pairs with the kept pair's place in the deduplicated list (from 0)."""
    marked = duplicates(pairs, text.content_hash(F.col("question"), F.col("answer")))
    kept = marked.where("duplicate_of IS NULL").drop("duplicate_of")
    places = global_position(kept.select("pair_id"), F.floor(F.col("pair_id") / 4096), "pair_id", out="duplicate_index")
    removed = marked.where("duplicate_of IS NOT NULL")
    removed = removed.join(places.withColumnRenamed("pair_id", "duplicate_of"), "duplicate_of")
    return kept, removed.select(*pairs.columns, "duplicate_index")


def contaminated_exact(pairs: DataFrame, training: DataFrame) -> DataFrame:
    """Pairs whose question, answer or both together stand in the training pairs. Empty texts count for nothing."""

    def keys(frame: DataFrame) -> DataFrame:
        q, a = text.hash_normal(F.col("question")), text.hash_normal(F.col("answer"))
        both = F.concat_ws("|||", q, a)
        hashes = F.array(F.when(q != "", F.sha2(q, 256)), F.when(a != "", F.sha2(a, 256)), F.when((q != "") & (a != ""), F.sha2(both, 256)))
        return frame.select("pair_id", F.explode(F.filter(hashes, lambda h: h.isNotNull())).alias("hash"))

    return keys(pairs).join(keys(training).select("hash").distinct(), "hash", "left_semi").select("pair_id").distinct()


def char_grams(text: Column, n: int = 5) -> Column:
    """Distinct n-grams of a text's characters. A set of slices in Python: expressions would count characters anew for each gram."""

    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([list({t[i : i + n] for i in range(len(t) - n + 1)}) if t else [] for t in texts])

    return F.pandas_udf(grams, "array<string>").asNondeterministic()(text)


def gram_rows(docs: DataFrame, id_col: str, value: Column, n: int) -> DataFrame:
    """(id, gram): the distinct n-grams of each document's characters."""

    def rows_of(texts: list) -> tuple[list[int], list]:
        sets = [{t[i : i + n] for i in range(len(t) - n + 1)} if t else () for t in texts]
        return [at for at, s in enumerate(sets) for _ in s], [[g for s in sets for g in s]]

    return blocks.texts_to_rows(docs, id_col, value, rows_of, "gram string")


#: Documents, in the order of their ids, that items meet first; each further step takes ``WIDER`` times as many, the last one all.
FIRST_DOCS, WIDER = 256, 16
#: Items and documents that meet in one group on average.
ITEMS_A_BLOCK, DOCS_A_BLOCK = 8192, 2048


def contaminated_ngrams(items: DataFrame, corpus: DataFrame, threshold: float = 0.3, n: int = 5) -> DataFrame:
    """First corpus document (by id) whose grams overlap an item's by ``threshold`` of the smaller set.

    The first documents settle most items, and a document of a larger id changes nothing for them:
    so the documents are taken in widening ranges of ids, and only items without a match go on to
    the next. Items that nothing matches meet every document. Rows of one id are one set.
    """
    left = items.where("item_id IS NOT NULL").select("item_id", text.hash_normal(F.col("text")).alias("t")).where(F.length("t") >= n)
    docs = corpus.where("doc_id IS NOT NULL").select("doc_id", "text")
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}"
    lower, found = None, []
    for upper, about in id_ranges(docs):
        some = docs if lower is None else docs.where(F.col("doc_id") > lower)
        some = some if upper is None else some.where(F.col("doc_id") <= upper)
        left = stored(left, "gram-items")
        n_left = left.count()
        if not n_left:
            break
        first = stored(_first_matches(left, n_left, some, about, threshold, n, kinds), "gram-matches")
        found.append(first)
        left, lower = left.join(small_side(first.select("item_id")), "item_id", "left_anti"), upper
    if not found:
        return items.sparkSession.createDataFrame([], f"{kinds}, overlap double")
    return reduce(DataFrame.unionByName, found)


def id_ranges(docs: DataFrame) -> list[tuple]:
    """Upper ends of widening ranges of ids, the last one open, and about how many documents each has."""
    n, sizes = docs.count(), []
    while isinstance(docs.schema["doc_id"].dataType, NumericType) and 4 * FIRST_DOCS * WIDER ** len(sizes) < n:
        sizes.append(FIRST_DOCS * WIDER ** len(sizes))
    ends = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s / n) for s in sizes]), F.lit(100_000))).first()[0] if sizes else []
    return [*zip(ends, sizes), (None, n)]


def _first_matches(items: DataFrame, n_items: int, docs: DataFrame, n_docs: int, threshold: float, n: int, kinds: str) -> DataFrame:
    """item_id, doc_id and overlap of the first match of each item (item_id, t) among some documents."""
    n_asked = -(-n_items // ITEMS_A_BLOCK)
    n_held = max(-(-n_docs // DOCS_A_BLOCK), min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n_docs // 16)), 1)
    a, b = F.pmod(F.xxhash64("item_id"), F.lit(n_asked)).cast("int"), F.pmod(F.xxhash64("doc_id"), F.lit(n_held)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = items.select("item_id", "t", a.alias("a")).withColumn("b", each(n_held))
    right = docs.select("doc_id", text.hash_normal(F.col("text")).alias("d"), b.alias("b")).where(F.length("d") >= n).withColumn("a", each(n_asked))

    def grams(ids, texts) -> dict:
        """The grams of each id."""
        found: dict = {}
        for key, t in zip(ids, texts):
            found.setdefault(key, set()).update(t[i : i + n] for i in range(len(t) - n + 1))
        return found

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = grams(asked["item_id"], asked["t"])
        held = held.sort_values("doc_id", kind="stable")
        ids, starts = np.unique(held["doc_id"].to_numpy(), return_index=True)
        ends = [*starts[1:], len(held)]
        at = 0
        while known and at < len(ids):
            names, sizes = list(known), np.array([len(s) for s in known.values()])
            lists: dict[str, list[int]] = {}
            for i, s in enumerate(known.values()):
                for g in s:
                    lists.setdefault(g, []).append(i)
            arrays = {g: np.array(x) for g, x in lists.items()}
            left_over, found = np.ones(len(names), bool), []
            # The lists are made anew when half of their items have a match: all that is made is twice the first at most.
            while at < len(ids) and 2 * left_over.sum() > len(names):
                own = set().union(*grams([0] * (ends[at] - starts[at]), held["d"].iloc[starts[at] : ends[at]]).values())
                met = [arrays[g] for g in own if g in arrays]
                if met:
                    share = np.bincount(np.concatenate(met), minlength=len(names)) / np.minimum(sizes, len(own)).astype(np.float64)
                    for i in np.flatnonzero(left_over & (share >= threshold)):
                        found.append((names[i], ids[at], share[i]))
                        left_over[i] = False
                at += 1
            yield pd.DataFrame(found, columns=["item_id", "doc_id", "overlap"])
            known = {name: known[name] for name, more in zip(names, left_over) if more}

    met = blocks.meet(left, right, ["a", "b"], scan, f"{kinds}, overlap double")
    return met.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.round(F.min_by("overlap", "doc_id"), 6).alias("overlap"))


def contamination(items: DataFrame, training: DataFrame, share: float = 0.3, cosine: float | None = None, embedder=None) -> DataFrame:
    """One row for each contaminated item (pair_id, question, answer): match_type, source and score.

    Three checks, each only on what the one before left: the hashed question, answer or both in the
    training texts (doc_id, text); character 5-grams of the question, first document by id; and, where
    a ``cosine`` is given, the nearest training text by embedding. Empty texts match nothing.
    """
    hashes = training.where(text.hash_normal(F.col("text")) != "").select(F.sha2(text.hash_normal(F.col("text")), 256).alias("hash")).distinct()
    parts = F.array(F.col("question"), F.col("answer"), F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    asked = items.select("pair_id", F.explode(parts).alias("part")).where(text.hash_normal(F.col("part")) != "")
    exact = asked.select("pair_id", F.sha2(text.hash_normal(F.col("part")), 256).alias("hash")).join(hashes, "hash", "left_semi").select("pair_id").distinct()
    found = exact.select("pair_id", F.lit("exact").alias("match_type"), F.lit(None).cast("long").alias("source"), F.lit(1.0).alias("score"))
    rest = items.join(exact, "pair_id", "left_anti")
    grams = contaminated_ngrams(rest.select(F.col("pair_id").alias("item_id"), F.col("question").alias("text")), training, share)
    grams = grams.select(F.col("item_id").alias("pair_id"), F.lit("ngram").alias("match_type"), F.col("doc_id").alias("source"), F.col("overlap").alias("score"))
    found = found.unionByName(grams)
    if cosine is not None:
        rest = rest.join(grams, "pair_id", "left_anti").where(text.hash_normal(F.col("question")) != "")
        both = rest.select(F.col("pair_id").alias("of"), F.col("question").alias("text"), F.lit(True).alias("asked")).unionByName(training.select(F.col("doc_id").alias("of"), "text", F.lit(False).alias("asked")))
        rows = embed(both, "text", embedder=embedder)
        near = vector_topk(rows, F.col("asked"), 1, id_col="of", among=~F.col("asked"), exclude_self=False).where(F.col("score") >= cosine)
        near = near.select(F.col("query_id").alias("pair_id"), F.lit("semantic").alias("match_type"), F.col("vec_id").alias("source"), "score")
        found = found.unionByName(near)
    return found


#: Rows of a block of vectors on average.
BLOCK_ROWS = cosine_join.BLOCK_ROWS


def similar_vectors(rows: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Pairs i < j of rows with a cosine of at least ``threshold``: all of them, pruned by angles to pivots."""
    return cosine_join.similar_vectors(rows, threshold, id_col, vec_col, BLOCK_ROWS)


def answer_type(question: Column, answer: Column, context: Column) -> Column:
    a, q = F.trim(F.lower(answer)), F.lower(question)
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda x: x != ""))
    hops = F.lit(False)
    for phrase in MULTI_HOP:
        hops = hops | F.contains(q, F.lit(phrase))
    return (
        F.when(a.isin("yes", "no", "true", "false"), "yes_no")
        .when(hops, "multi_hop")
        .when((F.coalesce(context, F.lit("")) != "") & F.contains(F.lower(context), a), "extractive")
        .when(words > 10, "abstractive")
        .otherwise("extractive")
    )


def hash_fraction(*parts: Column) -> Column:
    """A fixed number in [0, 1) for the parts: the first 64 bits of their SHA-256."""
    digest = F.substring(F.sha2(F.concat_ws("|||", *parts), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def split_by_hash(pairs: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    u = hash_fraction(F.col("question"), F.col("answer"), F.lit(str(seed)))
    return pairs.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def split_by_ratio(rows: DataFrame, id_col: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Ranks by MD5 of id and seed and cuts at whole counts; ratios that do not add up to 1 are scaled."""
    total = sum(ratios)
    train, val, _ = (r / total for r in ratios) if abs(total - 1.0) > 0.01 else ratios
    keyed = rows.withColumn("__h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))))
    ranked = global_position(keyed, F.substring("__h", 1, 3), "__h", id_col, out="__pos")
    n = rows.count()
    first, second = int(n * train), int(n * train) + int(n * val)
    return ranked.withColumn("split", F.when(F.col("__pos") < first, "train").when(F.col("__pos") < second, "val").otherwise("test")).drop("__pos", "__h")


def isolate(rows: DataFrame, split: str) -> DataFrame:
    """Rows of one split; raises where there are no labels or none of that split."""
    if "split" not in rows.columns:
        raise ValueError("rows carry no split labels")
    kept = rows.where(F.col("split") == split)
    if kept.isEmpty():
        raise ValueError(f"no rows in split {split}")
    return kept


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """question and change (added, removed, modified); the last duplicate of a question in a version wins."""

    def last(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("question").agg(F.max_by("answer", "pair_id").alias(name), F.lit(True).alias(f"in_{name}"))

    both = last(old, "old").join(last(new, "new"), "question", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("question", change.alias("change")).where("change IS NOT NULL")


def unknown_chunks(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pair_id, chunk_id) for ids in ``source_chunk_ids`` that no chunk has."""
    each = pairs.select("pair_id", F.explode("source_chunk_ids").alias("chunk_id"))
    return each.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("pair_id", "chunk_id")
