"""Retrieval and evaluation queries. Benchmark items are the queries, documents the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics, retrieval
from ..sources import sinks
from .base import query, spread_table, table
from .curate_queries import pairs_of

K, EXPANDED = 5, 15
_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"
SEARCH = f"""iw AS (SELECT item_id, len({_SET.format('text')}) AS n_words, unnest({_SET.format('text')}) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest({_SET.format('text')}) AS w FROM documents),
hits AS (SELECT item_id, n_words, doc_id, count(*) AS hits FROM iw JOIN dw USING (w) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM hits),
judged AS (SELECT item_id, doc_id, rank, hits, hits / n_words::DOUBLE > 0.3::DOUBLE AS relevant FROM ranked WHERE rank <= {EXPANDED}),
top AS (SELECT * FROM judged WHERE rank <= {K})"""


def judged(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The first k documents of each item with their judgement."""
    items = table(spark, sf_dir, "benchmark")
    found = retrieval.overlap_search(items, spread_table(spark, sf_dir, "documents"), k)
    rel = F.col("hits") / F.col("n_words").cast("double") > metrics.DEFAULT.relevance
    return found.select("item_id", "doc_id", "rank", "hits", rel.alias("relevant"))


@query(f"WITH {SEARCH} SELECT t.item_id, t.doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS jaccard FROM (SELECT top.*, {_SET.format('i.text')} AS a, {_SET.format('d.text')} AS b FROM top JOIN benchmark i USING (item_id) JOIN documents d USING (doc_id)) t")
def jaccard(spark, sf_dir):
    top = judged(spark, sf_dir, K)
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "a")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b"))
    both = top.join(items, "item_id").join(docs, "doc_id")
    return both.select("item_id", "doc_id", F.round(metrics.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"WITH {SEARCH} SELECT item_id, doc_id, rank, relevant FROM top")
def judge_relevance(spark, sf_dir):
    """Judges the whole texts again, as the fallback of a model judge does."""
    top = judged(spark, sf_dir, K).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "a")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b"))
    both = top.join(items, "item_id").join(docs, "doc_id")
    return both.select("item_id", "doc_id", "rank", metrics.relevant(F.col("a"), F.lit(None).cast("string"), F.col("b")).alias("relevant"))


_AP = "SELECT item_id, round(coalesce(sum(CASE WHEN relevant THEN p ELSE 0 END) / nullif(sum(relevant::INT), 0), 0), 6) AS value FROM (SELECT *, sum(relevant::INT) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank::DOUBLE AS p FROM top) GROUP BY item_id"


@query(f"WITH {SEARCH} {_AP}")
def context_precision(spark, sf_dir):
    return metrics.context_precision(judged(spark, sf_dir, K))


@query(f"WITH {SEARCH} SELECT item_id, round(avg(relevant::INT::DOUBLE), 6) AS value FROM top GROUP BY item_id")
def precision_at_k(spark, sf_dir):
    return metrics.precision_at_k(judged(spark, sf_dir, K))


@query(f"WITH {SEARCH} SELECT item_id, round(coalesce(sum((relevant AND rank <= {K})::INT)::DOUBLE / nullif(sum(relevant::INT), 0), 0), 6) AS value FROM judged GROUP BY item_id")
def recall_at_k(spark, sf_dir):
    return metrics.recall_at_k(judged(spark, sf_dir, EXPANDED), K)


_CLAIMS = "list_filter(list_transform(string_split({}, '.'), lambda x: trim(x)), lambda x: length(x) > 10)"


@query(f"SELECT item_id, unnest({_CLAIMS.format('text')}) AS claim FROM benchmark")
def extract_claims(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(metrics.claims(F.col("text"))).alias("claim"))


_CONTEXT = "ctx AS (SELECT item_id, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents d USING (doc_id) GROUP BY item_id)"


@query(f"""WITH {SEARCH}, {_CONTEXT}, a AS (SELECT item_id, {_CLAIMS.format('i.text')} AS cs, {_SET.format('context')} AS seen FROM benchmark i JOIN ctx USING (item_id))
SELECT item_id, round(CASE WHEN len(seen) = 0 THEN 0 WHEN len(cs) = 0 THEN 1 ELSE len(list_filter(cs, lambda c: len(list_intersect({_SET.format('c')}, seen)) / len({_SET.format('c')})::DOUBLE > 0.5::DOUBLE)) / len(cs)::DOUBLE END, 6) AS value FROM a""".replace("lambda x: x <> ''))", "lambda y: y <> ''))"))
def faithfulness(spark, sf_dir):
    top = judged(spark, sf_dir, K).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    answers = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer")).join(retrieval.contexts(top), "item_id")
    return metrics.faithfulness(answers)


@query(f"WITH {SEARCH}, {_CONTEXT} SELECT item_id, md5(context) AS context_md5, length(context) AS n_chars FROM ctx")
def format_context(spark, sf_dir):
    top = judged(spark, sf_dir, K).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return retrieval.contexts(top).select("item_id", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n_chars"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    found = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def cosine_relevancy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


_MAXSIM = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT a.label AS query_id, c.label AS doc_id, a.vec_id, max(list_inner_product(a.v, c.v)) AS m FROM e a JOIN e c ON TRUE GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM b GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def _labels(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    tokens = rows.select(F.col("label").alias("owner"), F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    owners = rows.select("label").distinct()
    pairs = owners.withColumnRenamed("label", "query_id").crossJoin(owners.withColumnRenamed("label", "doc_id"))
    return pairs, tokens


@query(f"WITH {_MAXSIM} SELECT query_id, doc_id, score, rank FROM m")
def maxsim_rerank(spark, sf_dir):
    """Eight labels stand for documents of many token vectors; every label is asked for every label."""
    pairs, tokens = _labels(spark, sf_dir)
    return retrieval.maxsim(pairs, tokens).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_MAXSIM}, near AS (SELECT a.vec_id AS query_vec, a.label AS query_id, c.label AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, c.v), 6) DESC, c.vec_id) AS r FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
k AS (SELECT DISTINCT query_vec, query_id, doc_id FROM near WHERE r <= 20)
SELECT query_vec, doc_id, score, row_number() OVER (PARTITION BY query_vec ORDER BY score DESC, doc_id) AS rank FROM k JOIN s USING (query_id, doc_id)""")
def two_stage_retrieval(spark, sf_dir):
    """First the labels of the twenty nearest vectors, then late interaction over those."""
    rows = table(spark, sf_dir, "embeddings")
    near = retrieval.vector_topk(rows, F.col("vec_id") % 50 == 0, k=20).select(F.col("query_id").alias("query_vec"), "vec_id")
    first = near.join(rows.select("vec_id", F.col("label").alias("doc_id")), "vec_id").select("query_vec", "doc_id").distinct()
    asked = first.join(rows.select(F.col("vec_id").alias("query_vec"), F.col("label").alias("query_id")), "query_vec")
    _, tokens = _labels(spark, sf_dir)
    scores = retrieval.maxsim(asked.select("query_id", "doc_id").distinct(), tokens).select("query_id", "doc_id", "score")
    again = Window.partitionBy("query_vec").orderBy(F.desc("score"), "doc_id")
    found = asked.join(scores, ["query_id", "doc_id"]).withColumn("rank", F.row_number().over(again).cast("long"))
    return found.select("query_vec", "doc_id", "score", "rank")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    """A sampling operator: the first rows by MD5 of id and seed."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|42"))), "doc_id").limit(50)


@query("SELECT doc_id, left(text, 2000) AS content, length(text) AS full_length, (SELECT count(*) FROM documents WHERE contains(lower(text), 'the')) AS total FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 20 OFFSET 40")
def search_page(spark, sf_dir):
    """One page of a substring search, with the count of all matches."""
    found = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lower(F.lit("The"))))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("doc_id").offset(40).limit(20)
    return page.select("doc_id", F.substring("text", 1, 2000).alias("content"), F.length("text").cast("long").alias("full_length")).join(F.broadcast(total))


# Two runs over the items: the first five documents, and the second five.
RUNS = f"""res AS (SELECT CASE WHEN rank <= {K} THEN 'a' ELSE 'b' END AS run, item_id, relevant, hits, rank FROM judged WHERE rank <= {2 * K}),
scored AS (SELECT run, item_id, avg(relevant::INT::DOUBLE) AS precision_at_k, max(hits) / 100.0::DOUBLE AS jaccard, (item_id % 10)::DOUBLE AS latency, CASE WHEN item_id % 9 = 0 THEN 'timeout' END AS error FROM res GROUP BY run, item_id)"""


def scored_runs(spark, sf_dir):
    rows = judged(spark, sf_dir, 2 * K).withColumn("run", F.when(F.col("rank") <= K, "a").otherwise("b"))
    return rows.groupBy("run", "item_id").agg(
        F.avg(F.col("relevant").cast("double")).alias("precision_at_k"), (F.max("hits") / F.lit(100.0)).alias("jaccard"),
        F.first((F.col("item_id") % 10).cast("double")).alias("latency"), F.first(F.when(F.col("item_id") % 9 == 0, "timeout")).alias("error"),
    )


@query(f"""WITH {SEARCH}, {RUNS} SELECT run, count(*) AS n, count(*) FILTER (WHERE error IS NULL) AS n_good, round(avg(precision_at_k) FILTER (WHERE error IS NULL), 6) AS precision_at_k,
round(avg(jaccard) FILTER (WHERE error IS NULL), 6) AS jaccard, round(avg(latency), 6) AS avg_latency, round(sum(latency) FILTER (WHERE error IS NULL) / count(*), 6) AS avg_latency_of_good FROM scored GROUP BY run""")
def run_aggregates(spark, sf_dir):
    return metrics.run_aggregates(scored_runs(spark, sf_dir), ["precision_at_k", "jaccard"])


@query(f"WITH {SEARCH}, {RUNS} SELECT run, item_id, round((precision_at_k + jaccard) / 2, 6) AS mean_score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round((precision_at_k + jaccard) / 2, 6), item_id) AS r FROM scored) WHERE r <= 5")
def worst_questions(spark, sf_dir):
    rows = scored_runs(spark, sf_dir).withColumn("mean_score", F.round((F.col("precision_at_k") + F.col("jaccard")) / 2, 6))
    order = Window.partitionBy("run").orderBy("mean_score", "item_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r <= 5").select("run", "item_id", "mean_score")


@query(f"""WITH {SEARCH}, {RUNS}, u AS (SELECT run, 'precision_at_k' AS metric, precision_at_k AS v FROM scored UNION ALL SELECT run, 'jaccard', jaccard FROM scored)
SELECT run, metric, round(min(v) * 100, 1) AS low, round(max(v) * 100, 1) AS high, round(avg(v) * 100, 1) AS mean FROM u GROUP BY run, metric""")
def metric_distribution(spark, sf_dir):
    long = scored_runs(spark, sf_dir).unpivot("run", ["precision_at_k", "jaccard"], "metric", "v")
    return long.groupBy("run", "metric").agg(*[F.round(f("v") * 100, 1).alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"))])


@query(f"""WITH {SEARCH}, {RUNS}, u AS (SELECT run, 'precision_at_k' AS metric, avg(precision_at_k) AS v FROM scored GROUP BY run UNION ALL SELECT run, 'jaccard', avg(jaccard) FROM scored GROUP BY run)
SELECT metric, first(run ORDER BY v DESC, run) AS best_run, first(run ORDER BY v, run) AS worst_run, round((max(v) - min(v)) * 100, 4) AS spread FROM u GROUP BY metric""")
def run_spread(spark, sf_dir):
    return spread_of(scored_runs(spark, sf_dir).unpivot("run", ["precision_at_k", "jaccard"], "metric", "v"))


def spread_of(scores: DataFrame) -> DataFrame:
    """Best and worst run of each metric, of (run, metric, v). Means are exact: those that are equal tie in any order of addition."""
    long = scores.groupBy("run", "metric").agg(F.avg(F.col("v").cast("decimal(24,18)")).cast("double").alias("v"))
    return long.groupBy("metric").agg(F.min_by("run", F.struct(-F.col("v"), "run")).alias("best_run"), F.min_by("run", F.struct("v", "run")).alias("worst_run"), F.round((F.max("v") - F.min("v")) * 100, 4).alias("spread"))


@query(f"WITH {SEARCH}, {RUNS} SELECT item_id, round(max(jaccard) FILTER (WHERE run = 'a'), 6) AS a, round(max(jaccard) FILTER (WHERE run = 'b'), 6) AS b FROM scored GROUP BY item_id")
def per_question_pivot(spark, sf_dir):
    return scored_runs(spark, sf_dir).groupBy("item_id").pivot("run", ["a", "b"]).agg(F.round(F.max("jaccard"), 6))


@query(f"""WITH {SEARCH}, {RUNS} SELECT run, item_id, printf('%.1f%%', (CASE WHEN jaccard = 0 THEN 0 ELSE jaccard END) * 100) AS jaccard, printf('%.1f%%', precision_at_k * 100) AS precision_at_k, printf('%.2f', latency) AS latency FROM scored""")
def run_csv_rows(spark, sf_dir):
    rows = scored_runs(spark, sf_dir).withColumns({c: F.lit(0.0) for c in ("score", "context_precision", "recall_at_k")})
    rows = rows.withColumns({"query": F.col("run"), "predicted_answer": F.lit(""), "ground_truth": F.col("item_id").cast("string")})
    out = sinks.run_csv_rows(rows)
    return out.select(F.col("query").alias("run"), F.col("ground_truth").cast("long").alias("item_id"), "jaccard", "precision_at_k", "latency")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30') AS last_week, round(avg(value), 6) AS mean_value FROM events")
def recent_runs(spark, sf_dir):
    """Events stand for runs; "now" is fixed."""
    recent = (F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(recent).alias("last_week"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT count(*) AS total, round((count(*) FILTER (WHERE quality = 1) + count(*) FILTER (WHERE toxic = 1)) * 100.0 / count(*), 1) AS completion, round(count(*) FILTER (WHERE quality = 1) * 100.0 / (count(*) FILTER (WHERE quality = 1) + count(*) FILTER (WHERE toxic = 1)), 1) AS approval FROM labels")
def annotation_rates(spark, sf_dir):
    yes, no = F.count_if(F.col("quality") == 1), F.count_if(F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").agg(
        F.count("*").alias("total"), F.round(F.try_divide((yes + no) * 100.0, F.count("*")), 1).cast("double").alias("completion"), F.round(F.try_divide(yes * 100.0, yes + no), 1).cast("double").alias("approval")
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, judge, score and aggregate."""
    expanded = judged(spark, sf_dir, EXPANDED)
    top = expanded.where(F.col("rank") <= K)
    ap = metrics.context_precision(top).withColumnRenamed("value", "context_precision")
    p = metrics.precision_at_k(top).withColumnRenamed("value", "precision_at_k")
    r = metrics.recall_at_k(expanded, K).withColumnRenamed("value", "recall_at_k")
    joined = ap.join(p, "item_id").join(r, "item_id")
    return joined.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("context_precision", "precision_at_k", "recall_at_k")])


@query(f"""WITH {SEARCH}, ap AS ({_AP}), pk AS (SELECT item_id, round(avg(relevant::INT::DOUBLE), 6) AS value FROM top GROUP BY item_id),
rk AS (SELECT item_id, round(coalesce(sum((relevant AND rank <= {K})::INT)::DOUBLE / nullif(sum(relevant::INT), 0), 0), 6) AS value FROM judged GROUP BY item_id)
SELECT count(*) AS n, round(avg(ap.value), 6) AS context_precision, round(avg(pk.value), 6) AS precision_at_k, round(avg(rk.value), 6) AS recall_at_k FROM ap JOIN pk USING (item_id) JOIN rk USING (item_id)""")
def evaluation_run(spark, sf_dir):
    return flagship(spark, sf_dir)
