"""Queries of stored indexes, built from the tables and then searched."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cell_index import CellIndex
from ..operators.substring_index import SubstringIndex
from ..session import shared_dir
from .base import query, table

#: Consecutive vectors that stand for the tokens of one document.
TOKENS = 8


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def ivf_topk(spark, sf_dir):
    """A trained cell index, with all cells read: exact."""
    rows = table(spark, sf_dir, "embeddings")
    index = CellIndex.create(rows, scratch(spark, "ivf"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = index.nearest(asked, 10, exclude_self=True)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("owner", F.floor(F.col("vec_id") / TOKENS))


def _asked(rows):
    return rows.where("owner % 5 = 0").select(F.col("owner").alias("query_id"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))


_SCORES = """b AS (SELECT a.owner AS query_id, c.owner AS owner, a.vec_id, max(list_inner_product(a.v, c.v)) AS m FROM e a JOIN held c ON a.owner % 5 = 0 GROUP BY ALL),
s AS (SELECT query_id, owner, round(sum(m), 6) AS score FROM b GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner) AS rank FROM s) WHERE rank <= 10"""
_TOKENS = f"e AS (SELECT vec_id, vec_id // {TOKENS} AS owner, embedding::DOUBLE[] AS v FROM embeddings)"


def _found(index, rows):
    return index.search(_asked(rows), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_TOKENS}, held AS (SELECT * FROM e), {_SCORES}")
def token_index_search(spark, sf_dir):
    """Late interaction over an index of token vectors, with all cells read: exact."""
    rows = _tokens(spark, sf_dir)
    return _found(CellIndex.create(rows, scratch(spark, "tokens"), owner_col="owner"), rows)


@query(f"WITH {_TOKENS}, held AS (SELECT * FROM e WHERE owner % 3 <> 0 UNION ALL SELECT vec_id, owner, list_transform(v, lambda x: -x) FROM e WHERE owner % 6 = 0), {_SCORES}")
def token_index_updates(spark, sf_dir):
    """Every third document is deleted, and every sixth added again with other vectors."""
    rows = _tokens(spark, sf_dir)
    index = CellIndex.create(rows, scratch(spark, "tokens"), owner_col="owner")
    index.delete(rows.where("owner % 3 = 0").select("owner"))
    again = rows.where("owner % 6 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.add(again, owner_col="owner")
    return _found(index, rows)


_PAGES = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{p}' AS pattern, doc_id, left(text, 100) AS content, length(text) AS full_length, count(*) OVER () AS total FROM documents WHERE contains(lower(text), lower('{p}')) ORDER BY doc_id LIMIT 5 OFFSET 3)"
    for p in ("Ability", "ing the", "qu", "not there at all")
)


@query(_PAGES)
def substring_pages(spark, sf_dir):
    """Pages of substring searches by trigram lists: a rarer pattern, a common one, one too short, and one that nothing holds."""
    index = SubstringIndex.create(table(spark, sf_dir, "documents"), scratch(spark, "trigrams"))
    pages = [index.page(p, 3, 5, 100).select(F.lit(p).alias("pattern"), "*") for p in ("Ability", "ing the", "qu", "not there at all")]
    return reduce(DataFrame.unionByName, [p.select("pattern", "doc_id", "content", "full_length", "total") for p in pages])
