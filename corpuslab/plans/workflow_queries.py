"""Queries over whole workflows: validation, contamination, comparison and export of runs, retrieval with its lookups, catalogs."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import answers, curate, retrieval, runs, stats
from ..sources import importers
from ..session import shared_dir
from .base import query, spread_table, table
from .curate_queries import PAIRS, pairs_of
from .eval_queries import RUNS, SEARCH, _CONTEXT, K, judged, scored_runs
from .stats_queries import _LABEL, FACTS, TAIL
from .stats_queries import RUNS as PAIRED
from .stats_queries import runs as paired_runs

_TYPED = """typed AS (SELECT *, CASE WHEN conv_id % 4 = 1 THEN 'extractive' WHEN conv_id % 4 = 2 THEN 'yes_no' END AS answer_type, CASE conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' END AS difficulty, CASE WHEN conv_id % 7 = 0 THEN FALSE WHEN conv_id % 7 > 3 THEN TRUE END AS is_answerable FROM pairs)"""


def _typed(spark, sf_dir):
    c = F.col("conv_id")
    return pairs_of(spark, sf_dir).withColumns({
        "answer_type": F.when(c % 4 == 1, "extractive").when(c % 4 == 2, "yes_no"), "difficulty": F.when(c % 3 == 0, "easy").when(c % 3 == 1, "hard"),
        "is_answerable": F.when(c % 7 == 0, False).when(c % 7 > 3, True),
    })


@query(f"""WITH {PAIRS}, {_TYPED}, u AS (SELECT 'answer_type' AS field, coalesce(answer_type, 'abstractive') AS value FROM typed UNION ALL SELECT 'difficulty', coalesce(difficulty, 'medium') FROM typed
UNION ALL SELECT 'is_answerable', coalesce(is_answerable, TRUE)::VARCHAR FROM typed) SELECT field, value, count(*) AS n FROM u GROUP BY field, value""")
def validation_distributions(spark, sf_dir):
    return curate.distributions(_typed(spark, sf_dir), {"answer_type": "abstractive", "difficulty": "medium", "is_answerable": "true"})


@query(f"""WITH {PAIRS}, d AS (SELECT row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY pair_id) AS nth FROM (SELECT pair_id, question FROM pairs UNION ALL SELECT pair_id + 500, translate(question, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM pairs WHERE conv_id % 3 = 0))
SELECT count(*) AS n, count(*) FILTER (WHERE nth > 1) AS n_duplicates, round(count(*) FILTER (WHERE nth > 1) / count(*)::DOUBLE, 6) AS share, count(*) FILTER (WHERE nth > 1) / count(*)::DOUBLE > 0.1 AS too_many FROM d""")
def duplicate_share(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir).select("pair_id", "question", "conv_id")
    return curate.duplicate_share(pairs.unionByName(pairs.where("conv_id % 3 = 0").withColumn("question", F.translate("question", ascii_lowercase, ascii_uppercase))))


@query(f"""WITH {PAIRS} SELECT pair_id, conv_id::VARCHAR AS source_chunk_id, substr(sha256(answer), 1, 16) AS chunk_content_hash, 'import' AS created_from FROM pairs""")
def pair_lineage(spark, sf_dir):
    made = curate.with_lineage(pairs_of(spark, sf_dir), "import", chunk_id="conv_id", chunk_text="answer")
    return made.select("pair_id", "lineage.source_chunk_id", "lineage.chunk_content_hash", "lineage.created_from")


_HASHED = "hashed AS (SELECT pair_id, question, answer, CASE WHEN conv_id % 2 = 0 THEN 'known' END AS content_hash FROM pairs)"


@query(f"WITH {PAIRS}, {_HASHED} SELECT pair_id, coalesce(content_hash, sha256(lower(trim(question)) || '|||' || lower(trim(answer)))) AS content_hash FROM hashed")
def migrated_hashes(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir).withColumn("content_hash", F.when(F.col("conv_id") % 2 == 0, "known"))
    return curate.with_missing_hashes(pairs).select("pair_id", "content_hash")


@query(f"WITH {PAIRS}, {_HASHED} SELECT count(content_hash) AS migrated, count(*) - count(content_hash) AS pending FROM hashed")
def migration_status(spark, sf_dir):
    return curate.migration_status(pairs_of(spark, sf_dir).withColumn("content_hash", F.when(F.col("conv_id") % 2 == 0, "known")))


_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_GRAMS = "SELECT DISTINCT id, substr(t, i, 5) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 3)) AS i FROM {})"
_CHECK = f"""ev AS (SELECT pair_id, question, answer FROM pairs WHERE conv_id % 10 = 0 UNION ALL SELECT item_id + 1000000, text, '' FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT doc_id + 2000000, '  ' || replace(text, ' ', '   '), NULL FROM documents WHERE doc_id < 5),
tr AS (SELECT doc_id, text FROM documents WHERE n_chars < 2000), th AS (SELECT DISTINCT {_NORM.format('text')} AS h FROM tr),
ex AS (SELECT pair_id FROM ev WHERE (question <> '' AND {_NORM.format('question')} IN (SELECT h FROM th)) OR (coalesce(answer, '') <> '' AND {_NORM.format('answer')} IN (SELECT h FROM th)) OR {_NORM.format("coalesce(question, '') || ' ' || coalesce(answer, '')")} IN (SELECT h FROM th)),
a AS ({_GRAMS.format(f"(SELECT pair_id AS id, {_NORM.format('question')} AS t FROM ev WHERE pair_id NOT IN (SELECT pair_id FROM ex))")}), b AS ({_GRAMS.format(f"(SELECT doc_id AS id, {_NORM.format('text')} AS t FROM tr)")}),
na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id),
met AS (SELECT a.id AS pair_id, b.id AS doc_id, count(*) AS hits FROM a JOIN b USING (g) GROUP BY ALL),
ng AS (SELECT pair_id, min(doc_id) AS source, round(arg_min(hits / least(na.n, nb.n)::DOUBLE, doc_id), 6) AS score FROM met JOIN na ON na.id = pair_id JOIN nb ON nb.id = doc_id WHERE hits / least(na.n, nb.n)::DOUBLE >= 0.3::DOUBLE GROUP BY pair_id)"""


@query(f"WITH {PAIRS}, {_CHECK} SELECT pair_id, 'exact' AS match_type, NULL::BIGINT AS source, 1.0::DOUBLE AS score FROM ex UNION ALL SELECT pair_id, 'ngram', source, score FROM ng")
def contamination_report(spark, sf_dir):
    """Exact hits first, then n-grams of what is left. The semantic check has no SQL; tests hold it against brute force."""
    docs = table(spark, sf_dir, "documents")
    evals = pairs_of(spark, sf_dir).where("conv_id % 10 = 0").select("pair_id", "question", "answer")
    items = table(spark, sf_dir, "benchmark").where("item_id % 4 = 0").select((F.col("item_id") + 1000000).alias("pair_id"), F.col("text").alias("question"), F.lit("").alias("answer"))
    copies = docs.where("doc_id < 5").select((F.col("doc_id") + 2000000).alias("pair_id"), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   "))).alias("question"), F.lit(None).cast("string").alias("answer"))
    training = spread_table(spark, sf_dir, "documents").where("n_chars < 2000").select("doc_id", "text")
    return curate.contamination(evals.unionByName(items).unionByName(copies), training)


_COMPARED = f"""k AS (SELECT *, round(least(1, 2 * {TAIL}), 6) AS p, mean_d / sd_d AS d FROM z), r AS (SELECT *, row_number() OVER (ORDER BY p, "group") AS rank, count(*) OVER () AS m FROM k),
c AS (SELECT *, least(1, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS adj FROM r)"""


@query(f"""WITH {PAIRED}, {FACTS}, {_COMPARED} SELECT "group", n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_d, 6) AS difference, 't_test' AS test, p, round(adj, 6) AS adjusted, adj < 0.05 AS significant, round(d, 6) AS d, {_LABEL} AS effect FROM c""")
def compare_metrics(spark, sf_dir):
    return runs.compare_metrics(paired_runs(spark, sf_dir))


@query(f"""WITH {PAIRED}, {FACTS}, {_COMPARED}, l AS (SELECT "group", adj < 0.05 AS sig, mean_d, printf('  - %d: %.3f -> %.3f (', "group", round(mean_a, 6), round(mean_b, 6)) || CASE WHEN mean_d > 0 THEN 'improved' WHEN mean_d < 0 THEN 'degraded' ELSE 'unchanged' END || CASE WHEN adj < 0.05 THEN ' (significant)' ELSE '' END || ', ' || {_LABEL} || ' effect)' AS line FROM c),
s AS (SELECT count(*) FILTER (WHERE sig AND mean_d > 0) AS improvements, count(*) FILTER (WHERE sig AND mean_d < 0) AS degradations, count(*) AS n, string_agg(line, chr(10) ORDER BY "group") AS lines FROM l)
SELECT improvements, degradations, n - improvements - degradations AS no_change, printf('Comparison Summary (alpha=0.05):' || chr(10) || '  - Significant improvements: %d' || chr(10) || '  - Significant degradations: %d' || chr(10) || '  - No significant change: %d' || chr(10) || chr(10) || 'Metric Details:' || chr(10), improvements, degradations, n - improvements - degradations) || lines AS summary FROM s""")
def comparison_summary(spark, sf_dir):
    return runs.comparison_summary(runs.compare_metrics(paired_runs(spark, sf_dir)))


@query(f"""WITH {SEARCH}, {RUNS}, g AS (SELECT run, avg(precision_at_k) AS p, avg(latency) AS l FROM scored GROUP BY run)
SELECT run, 0 AS place, 'Context Precision' AS label, '0.0%' AS value FROM g UNION ALL SELECT run, 1, 'Precision@K', printf('%.1f%%', round(p, 6) * 100) FROM g UNION ALL SELECT run, 2, 'Recall@K', '0.0%' FROM g UNION ALL SELECT run, 3, 'Avg Latency', printf('%.2fs', round(l, 6)) FROM g""")
def run_csv_summary(spark, sf_dir):
    found = scored_runs(spark, sf_dir).groupBy("run").agg(F.round(F.avg("precision_at_k"), 6).alias("precision_at_k"), F.round(F.avg("latency"), 6).alias("avg_latency"))
    return runs.csv_summary(found.withColumns({c: F.lit(None).cast("double") for c in ("context_precision", "recall_at_k")}))


@query(f"""WITH {SEARCH}, {RUNS} SELECT run, item_id, printf('%.1f', precision_at_k * 100) AS precision_at_k, CASE WHEN item_id % 3 = 0 THEN '' ELSE printf('%.1f', jaccard * 100) END AS jaccard, CASE WHEN error IS NULL THEN printf('%.3f', latency) ELSE '' END AS latency FROM scored""")
def run_csv_bench(spark, sf_dir):
    rows = scored_runs(spark, sf_dir).withColumn("jaccard", F.when(F.col("item_id") % 3 != 0, F.col("jaccard"))).withColumn("latency", F.when(F.col("error").isNull(), F.col("latency")))
    return runs.bench_csv_rows(rows, ["precision_at_k", "jaccard"])


@query("SELECT o_orderkey AS id, 'run ' || o_orderpriority AS name, o_orderdate::DATE::VARCHAR AS created_at FROM orders WHERE contains(lower('run ' || o_orderpriority), 'urgent') ORDER BY o_orderdate::DATE::VARCHAR DESC, o_orderkey LIMIT 20")
def run_list(spark, sf_dir):
    """The newest runs whose name holds a word; orders stand for runs."""
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("run "), "o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"))
    return runs.list_runs(named, "URGENT", 20)


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, 0.0::DOUBLE AS score FROM r WHERE rank <= 5")
def retrieve_with_scores(spark, sf_dir):
    """Retrieval without a reranker: every document's score is 0."""
    found = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5)
    return found.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.lit(0.0).alias("score"))


_SCORED = "s AS (SELECT item_id, doc_id, rank, hits / n_words::DOUBLE AS score FROM ranked WHERE rank <= 5)"


@query(f"WITH {SEARCH}, {_SCORED} SELECT item_id, md5(string_agg('[' || rank || '] (score: ' || printf('%.3f', score) || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM s JOIN documents d USING (doc_id) GROUP BY item_id")
def format_context_scored(spark, sf_dir):
    found = retrieval.overlap_search(table(spark, sf_dir, "benchmark"), spread_table(spark, sf_dir, "documents"), K)
    found = found.withColumn("score", F.col("hits") / F.col("n_words").cast("double")).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    return retrieval.scored_contexts(found).select("item_id", F.md5("context").alias("context_md5"))


@query(f"WITH {SEARCH}, {_CONTEXT} SELECT item_id, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS prompt_md5 FROM ctx JOIN benchmark USING (item_id)")
def prompts(spark, sf_dir):
    top = judged(spark, sf_dir, K).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    asked = retrieval.contexts(top).join(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question"), "item_id")
    return asked.select("item_id", F.md5(retrieval.prompt(F.col("context"), F.col("question"))).alias("prompt_md5"))


@query("SELECT c_custkey, coalesce(s_name, n_name, 'default') AS backend FROM customer LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON n_nationkey = c_nationkey")
def collection_backend(spark, sf_dir):
    """A lookup with two sources and a default."""
    first = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    second = table(spark, sf_dir, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    both = table(spark, sf_dir, "customer").join(first, "c_custkey", "left").join(second, "c_nationkey", "left")
    return both.select("c_custkey", F.coalesce("s_name", "n_name", F.lit("default")).alias("backend"))


@query("SELECT doc_id, left(sha256('raw:' || doc_id || '|emb:' || CASE WHEN doc_id % 3 = 0 THEN 'deferred' ELSE lang END || '|chunk:' || CASE WHEN doc_id % 2 = 0 THEN 'deferred' ELSE 'recursive|size:1000|overlap:200' END), 8) AS config_hash FROM documents")
def processing_config_hash(spark, sf_dir):
    chunking = F.when(F.col("doc_id") % 2 == 0, F.lit("deferred")).otherwise(F.lit("recursive|size:1000|overlap:200"))
    embedder = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.processing_hash(F.col("doc_id"), embedder, chunking).alias("config_hash"))


@query("SELECT DISTINCT p_name AS name, 'processed_' || replace(replace(p_name, '-', '_'), ' ', '_') AS collection FROM part")
def collection_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("processed_"), F.translate("p_name", "- ", "__")).alias("collection")).distinct()


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS ws FROM conversations), n AS (SELECT *, greatest(1, len(ws) // 10) AS size FROM w), p AS (SELECT conv_id, turn, ws, size, unnest(range(0, len(ws), size)) AS first FROM n)
SELECT conv_id, turn, first // size AS piece, CASE WHEN first > 0 THEN ' ' ELSE '' END || array_to_string(ws[first + 1 : first + size], ' ') AS content FROM p""")
def streamed_pieces(spark, sf_dir):
    """Answers cut into about ten groups of words, as they are streamed."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("ws"))
    rows = rows.withColumn("size", F.greatest(F.lit(1), F.floor(F.size("ws") / 10).cast("int"))).where(F.size("ws") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.size("ws") - 1, F.col("size")), lambda i: F.concat(F.when(i > 0, " ").otherwise(""), F.array_join(F.slice("ws", i + 1, F.col("size")), " ")))
    return rows.select("conv_id", "turn", F.posexplode(pieces).alias("piece", "content")).withColumn("piece", F.col("piece").cast("long"))


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def collection_rows(spark, sf_dir):
    """The rows of one collection: an equi-join whose filters reach both scans."""
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region WHERE r_name LIKE 'A%')")
def scalar_subquery(spark, sf_dir):
    key = table(spark, sf_dir, "region").where("r_name LIKE 'A%'").agg(F.min("r_regionkey").alias("n_regionkey"))
    return table(spark, sf_dir, "nation").join(key, "n_regionkey").select("n_nationkey", "n_name")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct()


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20")
def latest_rows(spark, sf_dir):
    """A top-k report."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(20)


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'de' AND contains(lower(text), 'der')) AS total FROM documents WHERE lang = 'de' AND contains(lower(text), 'der') ORDER BY doc_id LIMIT 10 OFFSET 5")
def filtered_page(spark, sf_dir):
    """One page after all filters, with the total of the filtered rows, in one pass."""
    found = table(spark, sf_dir, "documents").where((F.col("lang") == "de") & F.contains(F.lower("text"), F.lit("der"))).select("doc_id")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("doc_id").offset(5).limit(10).join(F.broadcast(total))


@query("SELECT t.name, EXISTS (SELECT 1 FROM nation WHERE n_name = t.name) AS taken FROM (VALUES ('FRANCE'), ('ATLANTIS'), ('GERMANY')) t(name)")
def names_taken(spark, sf_dir):
    asked = spark.createDataFrame([("FRANCE",), ("ATLANTIS",), ("GERMANY",)], "name string")
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("taken")).distinct()
    return asked.join(known, "name", "left").select("name", F.coalesce("taken", F.lit(False)).alias("taken"))


@query("SELECT a.doc_id AS result_id, min(b.doc_id) AS candidate_id FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 3 = 0 GROUP BY a.doc_id")
def rerank_matches(spark, sf_dir):
    """Reranked texts find their candidate by content, the first of equals; contents meet as hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("candidate_id"))
    return docs.where("doc_id % 3 = 0").join(first, "h").select(F.col("doc_id").alias("result_id"), "candidate_id")


@query("SELECT source, list_aggregate(list_slice(list_sort(list(doc_id)), 1, 20), 'sum')::BIGINT AS sum_of_first, count(*) AS n FROM documents GROUP BY source")
def truncated_lists(spark, sf_dir):
    """The first twenty of each group, and how many there are."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    first = docs.withColumn("nth", nth).where("nth <= 20").groupBy("source").agg(F.sum("doc_id").alias("sum_of_first"))
    return first.join(docs.groupBy("source").agg(F.count("*").alias("n")), "source").select("source", "sum_of_first", "n")


@query()
def answer_correctness(spark, sf_dir):
    """Claims and embeddings of assistant turns against the next pair's; embeddings have no SQL, tests hold it against brute force."""
    pairs = pairs_of(spark, sf_dir)
    other = F.lead("answer").over(Window.partitionBy("conv_id").orderBy("pair_id"))
    return answers.answer_correctness(pairs.select(F.col("pair_id").alias("item_id"), "answer", F.coalesce(other, F.col("answer")).alias("reference")))


# Files of the three import formats, made of conversations, and read back by the importers.
_IMPORTED = "SELECT source_id, question, expected_answer, n_alternatives, answer_type FROM imported WHERE trim(question) <> '' AND trim(expected_answer) <> ''"


def _counted(pairs):
    return pairs.select("source_id", "question", "expected_answer", F.size("alternative_answers").alias("n_alternatives"), "answer_type")


def _lines(spark, rows, name):
    """Rows as a folder of JSON lines."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct("*"))).write.text(path)
    return path


@query(f"""WITH {PAIRS}, imported AS (SELECT pair_id::VARCHAR AS source_id, trim(question) AS question, CASE WHEN pair_id % 7 = 0 THEN '[UNANSWERABLE]' ELSE answer END AS expected_answer, CASE WHEN pair_id % 7 = 0 THEN 0 ELSE 1 END AS n_alternatives, 'extractive' AS answer_type FROM pairs) {_IMPORTED}""")
def import_squad(spark, sf_dir):
    """One file for each conversation: unanswerable questions, and answers that are given twice or blank."""
    told = F.array(*[F.struct(x.alias("text")) for x in (F.col("answer"), F.lit(" "), F.concat("answer", F.lit("!")), F.col("answer"))])
    asked = F.struct(F.col("pair_id").cast("string").alias("id"), F.concat(F.lit(" "), "question", F.lit("  ")).alias("question"), (F.col("pair_id") % 7 == 0).alias("is_impossible"), told.alias("answers"))
    files = pairs_of(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(asked).alias("qas"))
    page = F.struct(F.array(F.struct(F.col("conv_id").cast("string").alias("title"), F.array(F.struct(F.lit("context").alias("context"), "qas")).alias("paragraphs"))).alias("data"))
    return _counted(importers.squad_pairs(files.select(F.to_json(page).alias("value"))))


@query(rf"""WITH {PAIRS}, imported AS (SELECT pair_id::VARCHAR AS source_id, trim(question) AS question, CASE pair_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN array_to_string(list_slice(regexp_split_to_array(answer, '\s+'), 1, 2), ' ') ELSE answer END AS expected_answer,
CASE WHEN pair_id % 3 = 1 THEN 1 ELSE 0 END AS n_alternatives, CASE WHEN pair_id % 3 = 0 THEN 'yes_no' ELSE 'extractive' END AS answer_type FROM pairs) {_IMPORTED}""")
def import_natural_questions(spark, sf_dir):
    """A third answered yes, a third by tokens of the document and by text, a third flat."""
    kind, spans = F.col("pair_id") % 3, "array<struct<text:string,start_token:int,end_token:int>>"
    short = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("start_token"), F.lit(2).alias("end_token")), F.struct(F.col("question").alias("text"), F.lit(0).alias("start_token"), F.lit(0).alias("end_token")))
    notes = F.when(kind == 0, F.array(F.struct(F.lit("YES").alias("yes_no_answer"), F.array().cast(spans).alias("short_answers"))))
    notes = notes.when(kind == 1, F.array(F.struct(F.lit("NONE").alias("yes_no_answer"), short.cast(spans).alias("short_answers"))))
    rows = pairs_of(spark, sf_dir).select(
        F.col("pair_id").alias("example_id"), F.when(kind < 2, F.col("question")).alias("question_text"), F.when(kind == 2, F.col("question")).alias("question"),
        F.when(kind == 1, F.col("answer")).alias("document_text"), F.when(kind == 2, F.col("answer")).alias("answer"), notes.alias("annotations"),
    )
    return _counted(importers.natural_questions(spark, _lines(spark, rows, "natural-questions")))


@query(f"""WITH {PAIRS}, imported AS (SELECT pair_id::VARCHAR AS source_id, trim(question) AS question, answer AS expected_answer, CASE WHEN pair_id % 3 = 1 THEN 1 ELSE 0 END AS n_alternatives, 'abstractive' AS answer_type FROM pairs WHERE pair_id % 3 < 2) {_IMPORTED}""")
def import_msmarco(spark, sf_dir):
    """A third with a well-formed answer alone, a third with several, a third with none."""
    kind, none = F.col("pair_id") % 3, F.lit(importers.NO_ANSWER)
    rows = pairs_of(spark, sf_dir).select(
        F.col("pair_id").alias("query_id"), F.col("question").alias("query"), F.when(kind == 1, F.array("answer", F.lit(" "), "question")).otherwise(F.array(none)).alias("answers"),
        F.when(kind == 0, F.array("answer")).otherwise(F.array(F.lit("[]"))).alias("wellFormedAnswers"),
    )
    return _counted(importers.msmarco(spark, _lines(spark, rows, "msmarco")))
