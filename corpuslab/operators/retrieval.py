"""Exact retrieval: cosine top-k in blocks, late-interaction reranking, contexts, word-overlap search."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed_places, word_set
from . import blocks
from .postings import top_overlaps


class Embedder(Protocol):
    """What turns texts into vectors; models plug in here."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashedWords:
    """The default embedder: signed hashed bag of words, unit length. No model, no claim of quality."""

    def __init__(self, dim: int = 128) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, value in zip(out, texts):
            h = np.fromiter(map(_word_hash, (value or "").lower().split()), np.uint64)
            np.add.at(row, (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    model = embedder or HashedWords()

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model(list(texts))))

    return df.withColumn(out_col, F.pandas_udf(run, "array<double>")(F.col(text_col)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.nullif(norms, F.lit(0.0)), F.lit(0.0))


#: Rows and queries that meet in one group, at most: with them a group's memory is bounded at any size of the input.
BLOCK_ROWS, BLOCK_QUERIES = blocks.ROWS, blocks.ROWS


def vector_topk(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", among: Column | None = None, exclude_self: bool = True) -> DataFrame:
    """query_id, vec_id, score and rank of each query's ``k`` nearest other rows: an exact scan in blocks.

    ``among`` tells which rows can be found, all by default. Where queries are not among them, an
    equal id names another row (``exclude_self=False``).
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), is_query.alias("asked"), (F.lit(True) if among is None else among).alias("held")).where("id IS NOT NULL")
    top = nearest_rows(base.where("asked").select(F.col("id").alias("q"), F.col("v").alias("qv")), base.where("held").select("id", "v"), k, exclude_self)
    return top.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """q, id, score (cosine) and rank of the ``k`` rows (id, v) nearest to each query (q, qv).

    Every block of rows meets every block of queries once, as a matrix product; each keeps the
    ``k`` rows of a query that come first at the precision and in the order of the result. The
    numbers of blocks follow from the numbers of rows and queries.
    """
    n_blocks, n_groups = blocks.blocks_for(rows.count(), BLOCK_ROWS), blocks.blocks_for(queries.count(), BLOCK_QUERIES)
    kinds = f"q {queries.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}"
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("q", "qv", F.pmod(F.xxhash64("q", "qv"), F.lit(n_groups)).cast("int").alias("g"), each(n_blocks).alias("b"))
    right = rows.select("id", "v", each(n_groups).alias("g"), F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("b"))

    def unit(vectors) -> np.ndarray:
        x = blocks.matrix(vectors)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, y = unit(asked["qv"]), unit(held["v"])
        names, ids = asked["q"].to_numpy(), held["id"].to_numpy()
        for some in blocks.slices(len(x), len(y)):
            parts = []
            for q, row in zip(names[some], np.round(x[some] @ y.T, 6)):
                others = np.flatnonzero(ids != q) if exclude_self else np.arange(len(ids))
                best = others[first_k(-row[others], ids[others], k)]
                parts.append(pd.DataFrame({"q": q, "id": ids[best], "score": row[best]}))
            yield pd.concat(parts)

    met = blocks.meet(left, right, ["g", "b"], scan, f"{kinds}, score double").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_k(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest values, in order, ties by id."""
    some = np.arange(len(values))
    if len(values) > k:
        some = np.flatnonzero(~(values > np.partition(values, k - 1)[k - 1]))
    return some[np.lexsort((ids[some], values[some]))[:k]]


def maxsim(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Late interaction: the sum over query tokens of the best dot product with a document token.

    ``candidates`` has (query_id, doc_id), ``tokens`` one row for each token: (owner, token,
    vector), with ``token`` naming it within its owner. Tokens of a pair meet in blocks, however
    many an owner has: the best of each query token in each block, then over all, then the sum.
    Only owners of more than a block are cut, so that a token is copied once for each of its pairs.
    """
    counts = tokens.groupBy("owner").agg(F.count("*").alias("n"))
    n_q = F.greatest(F.ceil(F.col("n") / BLOCK_QUERIES), F.lit(1)).cast("int")
    n_d = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("int")
    of_q = counts.select(F.col("owner").alias("query_id"), n_q.alias("nq"))
    of_d = counts.select(F.col("owner").alias("doc_id"), n_d.alias("nd"))
    pairs = candidates.join(of_q, "query_id").join(of_d, "doc_id")

    def dealt(side: str, own: str, other: str) -> DataFrame:
        """Each token of one side in its own block, for each block of the other."""
        mine = tokens.select(F.col("owner").alias(side), "token", "vector")
        met = pairs.join(mine, side).withColumn("own", F.pmod(F.xxhash64("token"), F.col(own)).cast("int"))
        return met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left = dealt("query_id", "nq", "nd").select("query_id", "doc_id", F.col("own").alias("qb"), F.col("other").alias("db"), F.col("query_id").alias("q"), F.col("doc_id").alias("d"), "token", "vector")
    right = dealt("doc_id", "nd", "nq").select("query_id", "doc_id", F.col("other").alias("qb"), F.col("own").alias("db"), "vector")
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, y = blocks.matrix(asked["vector"]), blocks.matrix(held["vector"])
        found = asked[["q", "d", "token"]]
        for some in blocks.slices(len(x), len(y)):
            yield found[some].assign(best=(x[some] @ y.T).max(axis=1))

    best = blocks.meet(left, right, ["query_id", "doc_id", "qb", "db"], score, f"q {kinds['q']}, d {kinds['d']}, token {kinds['token']}, best double")
    best = best.groupBy(F.col("q").alias("query_id"), F.col("d").alias("doc_id"), "token").agg(F.max("best").alias("best"))
    scored = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("best"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order))


def overlap_search(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents that hold most of an item's distinct words: item_id, doc_id, hits, n_words, rank.

    Words that very many documents hold pair no items with documents, see ``postings``.
    """
    a = items.select("item_id", F.explode(word_set(F.col("text"))).alias("e"))
    b = docs.select("doc_id", F.explode(word_set(F.col("text"))).alias("e"))
    return top_overlaps(a, b, k)


def contexts(retrieved: DataFrame) -> DataFrame:
    """item_id and the contents in rank order, a blank line between; a fixed sentence where there are none."""
    joined = retrieved.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("x"))
    value = F.array_join(F.transform("x", lambda e: e["content"]), "\n\n")
    return joined.select("item_id", F.when(value == "", "No relevant context found.").otherwise(value).alias("context"))


def scored_contexts(retrieved: DataFrame) -> DataFrame:
    """As ``contexts``, each text under its rank and score."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (score: "), fixed_places(F.col("score"), 3), F.lit(")\n"))
    return contexts(retrieved.withColumn("content", F.concat(head, "content")))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def processing_hash(raw_id: Column, embedder: Column, chunking: Column) -> Column:
    """Eight digits that name how a data set was processed."""
    parts = F.concat(F.lit("raw:"), raw_id.cast("string"), F.lit("|emb:"), F.coalesce(embedder, F.lit("deferred")), F.lit("|chunk:"), chunking)
    return F.substring(F.sha2(parts, 256), 1, 8)


def config_hash(config: dict, length: int = 16) -> str:
    """A stable name for a configuration, under which derived tables are kept."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:length]
