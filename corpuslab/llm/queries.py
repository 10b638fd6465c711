"""The thin queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fill_in_middle, html_main, jaccard_join, language_id, license_scan, line_dedup, mixing, sharding, simhash_join, token_alignment, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: how rows are held out."""
    return F.crc32(doc_id.cast("string")) % n


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = mixing.mix(docs)
    # Each row meets its document's plan, so that no task has to write out all repeats of a row.
    rows = docs.select(F.col("doc_id").alias("id"), mixing.order_key("doc_id", "text", mixing.SEED).alias("key"), mixing.source_key(F.col("source")).alias("of"), mixing.word_count(F.col("text")).alias("words"))
    met = (F.col("key") == F.col("order_key")) & (F.col("of") == F.col("source_key")) & F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size"))
    return rows.join(plan, met).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_passes")).alias("taken"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    field = language_id.train(docs, lambda i: remainder(i, 3) != 1)
    labelled = language_id.label_documents(docs.select("doc_id", "text"), field)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that lose lines are rewritten; every document is returned."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leaked item of each contaminated document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("uid")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: remainder(i, 4) != 2)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_main.extract_main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transform(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the mix that SQL can work out: sizes and targets."""
    return op2_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the license scan that SQL can work out: the base phrases' places."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the sharding that SQL can work out: sizes, and that shards and places are whole."""
    rows = op10_slot_sharding(spark, sf_dir)
    by_shard = rows.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("places"))
    whole = by_shard.agg(F.bool_and((F.col("top") == F.col("n") - 1) & (F.col("places") == F.col("n"))).alias("gapless"))
    return rows.select("doc_id", "size", "law").join(F.broadcast(whole))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_main_text": op9_main_text,
    "op10_slot_sharding": op10_slot_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_simhash_join": op13_simhash_join,
    "mix_targets": mix_targets,
    "license_base_places": license_base_places,
    "shard_sizes": shard_sizes,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "mix_targets": r"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size / weight AS bound, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS FIRST)),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, weight * max(level) FILTER (WHERE level <= bound) OVER ()) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "license_base_places": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a, list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c FROM d)
SELECT doc_id, len(w) AS n_words, len(a) + len(b) + len(c) AS n_base, list_min(list_concat(a, b, c)) AS first_word, list_max(list_concat(a, b, c)) AS last_word,
array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p""",
    "op11_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "shard_sizes": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'bytes' AS law, TRUE AS gapless FROM documents",
}
