"""Queries of whole evaluations: presets, templates, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation
from .base import query, spread_table, table
from .eval_queries import SEARCH, K, judged

_AT = {"default": 0.3, "strict": 0.5, "lenient": 0.2}


@query("WITH " + SEARCH + ", " + ", ".join(f"{p} AS (SELECT item_id, avg((hits / n_words::DOUBLE > {t}::DOUBLE)::INT::DOUBLE) AS v FROM ranked WHERE rank <= {K} GROUP BY item_id)" for p, t in _AT.items()).replace("default AS", '"default" AS')
       + " " + " UNION ALL ".join(f"SELECT '{p}' AS preset, count(*) AS n, round(avg(v), 6) AS precision_at_k FROM \"{p}\"" for p in _AT))
def preset_precision(spark, sf_dir):
    """The same retrieval judged under each preset."""
    found = judged(spark, sf_dir, K).select("item_id", "doc_id", "rank")
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    rows = evaluation.stored(found.join(items, "item_id").join(docs, "doc_id"), "judged")
    parts = [evaluation.evaluate({"precision_at_k": rows}, preset=p).select(F.lit(p).alias("preset"), "value") for p in _AT]
    return reduce(DataFrame.unionByName, parts).groupBy("preset").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("precision_at_k"))


@query("SELECT p_partkey AS id, p_name AS name, p_size > 40 AS is_preset FROM part WHERE p_brand IN ('Brand#12', 'Brand#23') OR p_type = 'ECONOMY' ORDER BY is_preset DESC, lower(p_name), p_partkey")
def templates_by_tag(spark, sf_dir):
    """Parts stand for templates, with brand and type as tags."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 40).alias("is_preset"), F.array("p_brand", "p_type").alias("tags"))
    return evaluation.list_templates(rows, ["Brand#12", "Brand#23", "ECONOMY"]).select("id", "name", "is_preset")


@query("SELECT doc_id, 'store' AS found_in FROM documents WHERE contains(text, 'a') AND doc_id % 2 = 0")
def routed_search(spark, sf_dir):
    """The first place that has matches."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("a"))).select("doc_id")
    nowhere = docs.where("doc_id < 0").withColumn("found_in", F.lit("nowhere"))
    return evaluation.first_with_rows(nowhere, docs.where("doc_id % 2 = 0").withColumn("found_in", F.lit("store")), docs.withColumn("found_in", F.lit("documents")))
