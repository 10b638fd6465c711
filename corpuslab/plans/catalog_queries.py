"""Catalog, conversation and star-schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_set
from .base import query, spread_table, table


@query("SELECT coalesce(CASE WHEN (props->>'$.k')::INT % 10 = 0 THEN NULL ELSE props->>'$.k' END, 'unknown') AS key, count(*) AS n FROM events GROUP BY 1")
def json_group_count(spark, sf_dir):
    """Counts by a nested JSON key; some keys are blanked, so that the default is seen."""
    key = F.get_json_object("props", "$.k")
    key = F.coalesce(F.when(key.cast("int") % 10 != 0, key), F.lit("unknown"))
    return table(spark, sf_dir, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, min(lang) AS lang, min(doc_id) AS first_id FROM documents GROUP BY source")
def source_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("doc_id").alias("first_id"))


@query("SELECT count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS n_chars, count(*) FILTER (WHERE n_chars > 5000) AS n_long FROM documents")
def corpus_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("n_chars") > 5000).alias("n_long")
    )


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def left_join_names(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars < 300)")
def anti_join_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("lang = 'es' AND n_chars < 300").select("source").distinct()
    return docs.join(gone, "source", "left_anti").select("doc_id")


@query("""WITH tasks AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0), runs AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
SELECT id, CASE status WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS tab, 'task' AS kind FROM tasks UNION ALL SELECT id, 'completed', 'run' FROM runs WHERE id NOT IN (SELECT id FROM tasks)""")
def jobs_union(spark, sf_dir):
    """Tasks, and runs that no task stands for."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    tasks = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), status.alias("tab"), F.lit("task").alias("kind"))
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().join(tasks.select("id"), "id", "left_anti")
    return tasks.unionByName(runs.select("id", F.lit("completed").alias("tab"), F.lit("run").alias("kind")))


_COUNT = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query(f"SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 0 ELSE {_COUNT} END)::BIGINT AS prompt_tokens, sum(CASE WHEN role = 'assistant' THEN {_COUNT} ELSE 0 END)::BIGINT AS completion_tokens, sum({_COUNT})::BIGINT AS total_tokens FROM conversations GROUP BY conv_id")
def token_usage(spark, sf_dir):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    done = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(done, 0).otherwise(n)).alias("prompt_tokens"), F.sum(F.when(done, n).otherwise(0)).alias("completion_tokens"), F.sum(n).alias("total_tokens")
    )


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.trim("text") != ""))
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("SELECT conv_id, turn, CASE WHEN lower(sender) IN ('bot', 'assistant') THEN 'assistant' WHEN lower(sender) = 'system' THEN 'system' ELSE 'user' END AS role FROM (SELECT *, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 'BOT' WHEN turn % 5 = 0 THEN NULL ELSE upper(role) END AS sender FROM conversations)")
def role_normalize(spark, sf_dir):
    sender = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), "BOT").when(F.col("turn") % 5 == 0, None).otherwise(F.upper("role"))
    lower = F.lower(sender)
    role = F.when(lower.isin("bot", "assistant"), "assistant").when(lower == "system", "system").otherwise("user")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"))


@query("SELECT d.doc_id, d.n_chars FROM documents d JOIN (SELECT source, max(n_chars) AS m FROM documents GROUP BY source) s ON d.source = s.source AND d.n_chars = s.m")
def longest_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    longest = docs.groupBy("source").agg(F.max("n_chars").alias("n_chars"))
    return docs.join(longest, ["source", "n_chars"], "left_semi").select("doc_id", "n_chars")


@query("SELECT lang, count(DISTINCT w) AS n_words FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY lang")
def vocabulary_by_language(spark, sf_dir):
    words = spread_table(spark, sf_dir, "documents").select("lang", F.explode(word_set(F.col("text"))).alias("w"))
    return words.groupBy("lang").agg(F.countDistinct("w").alias("n_words"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_revenue(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def windowed_rank(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_anti_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rich = orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    pending = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").join(pending, "c_custkey", "left_anti").select("c_custkey")
