"""Curation and chunking queries. Pairs are user turns with the assistant turn that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import chunking, curate
from .base import query, spread_table, sql_text, table

PAIRS = """p0 AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, conv_id * 1000 + turn AS pair_id, text AS question, t2 AS answer FROM p0 WHERE role = 'user' AND r2 = 'assistant')"""


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"r2": F.lead("role").over(by_turn), "t2": F.lead("text").over(by_turn)})
    kept = turns.where((F.col("role") == "user") & (F.col("r2") == "assistant"))
    return kept.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("question"), F.col("t2").alias("answer"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS hash FROM documents")
def normalized_hash(spark, sf_dir):
    return spread_table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.hash_normal(F.col("text")), 256).alias("hash"))


_HASH = "sha256(lower(trim(question)) || '|||' || lower(trim(answer)))"


@query(f"WITH {PAIRS} SELECT pair_id, {_HASH} AS hash FROM pairs")
def content_hash(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("pair_id", text.content_hash(F.col("question"), F.col("answer")).alias("hash"))


# Every pair once more under a later id, so that there are duplicates.
_TWICE = "twice AS (SELECT pair_id, question, answer FROM pairs UNION ALL SELECT pair_id + 500, '  ' || question || ' ', answer FROM pairs WHERE conv_id % 3 = 0)"


def _twice(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    again = pairs.where("conv_id % 3 = 0").select((F.col("pair_id") + 500).alias("pair_id"), F.concat(F.lit("  "), "question", F.lit(" ")).alias("question"), "answer")
    return pairs.select("pair_id", "question", "answer").unionByName(again)


@query(f"""WITH {PAIRS}, {_TWICE}, f AS (SELECT *, min(pair_id) OVER (PARTITION BY {_HASH}) AS first_id FROM twice),
k AS (SELECT pair_id AS first_id, row_number() OVER (ORDER BY pair_id) - 1 AS duplicate_index FROM f WHERE pair_id = first_id)
SELECT pair_id, duplicate_index FROM f JOIN k USING (first_id) WHERE pair_id <> first_id""")
def dedup_exact(spark, sf_dir):
    return curate.dedup_exact(_twice(spark, sf_dir))[1].select("pair_id", "duplicate_index")


@query(f"""WITH {PAIRS}, {_TWICE}, f AS (SELECT pair_id, min(pair_id) OVER (PARTITION BY sha256(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')))) AS first_id FROM twice)
SELECT pair_id, 'duplicate_of_index_' || first_id AS source FROM f WHERE pair_id <> first_id""")
def internal_duplicates(spark, sf_dir):
    marked = curate.duplicates(_twice(spark, sf_dir), F.sha2(text.hash_normal(F.col("question")), 256)).where("duplicate_of IS NOT NULL")
    return marked.select("pair_id", F.concat(F.lit("duplicate_of_index_"), F.col("duplicate_of").cast("string")).alias("source"))


_BROKEN = "broken AS (SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN '  ' WHEN pair_id % 7 = 0 THEN 'abc' ELSE question END AS question, CASE WHEN pair_id % 11 = 0 THEN '' ELSE answer END AS answer FROM twice)"


@query(f"""WITH {PAIRS}, {_TWICE}, {_BROKEN}, m AS (SELECT pair_id, trim(question) AS q, trim(answer) AS a, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY pair_id) AS nth FROM broken)
SELECT pair_id, 'error' AS severity, 'question' AS field, 'Empty question' AS message FROM m WHERE q = ''
UNION ALL SELECT pair_id, 'warning', 'question', 'Question too short (' || length(q) || ' chars)' FROM m WHERE q <> '' AND length(q) < 5
UNION ALL SELECT pair_id, 'error', 'expected_answer', 'Empty answer' FROM m WHERE a = ''
UNION ALL SELECT pair_id, 'warning', 'question', 'Duplicate question' FROM m WHERE nth > 1""")
def validate_pairs(spark, sf_dir):
    question = F.when(F.col("pair_id") % 5 == 0, "  ").when(F.col("pair_id") % 7 == 0, "abc").otherwise(F.col("question"))
    answer = F.when(F.col("pair_id") % 11 == 0, "").otherwise(F.col("answer"))
    return curate.validate(_twice(spark, sf_dir).select("pair_id", question.alias("question"), answer.alias("answer")))


_hops = " OR ".join(f"contains(lower(question), {sql_text(x)})" for x in curate.MULTI_HOP)


@query(f"""WITH {PAIRS}, c AS (SELECT conv_id, first(text ORDER BY turn) AS context FROM conversations GROUP BY conv_id)
SELECT pair_id, CASE WHEN trim(lower(answer)) IN ('yes', 'no', 'true', 'false') THEN 'yes_no' WHEN {_hops} THEN 'multi_hop'
 WHEN context <> '' AND contains(lower(context), trim(lower(answer))) THEN 'extractive'
 WHEN len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) > 10 THEN 'abstractive' ELSE 'extractive' END AS answer_type
FROM pairs LEFT JOIN c USING (conv_id)""")
def infer_answer_type(spark, sf_dir):
    contexts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    pairs = pairs_of(spark, sf_dir).join(contexts, "conv_id", "left")
    return pairs.select("pair_id", curate.answer_type(F.col("question"), F.col("answer"), F.col("context")).alias("answer_type"))


_N = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query(f"""WITH {PAIRS}, {_TWICE}, h AS (SELECT pair_id, {_N.format('question')} AS q, {_N.format('answer')} AS a FROM twice),
k AS (SELECT pair_id, sha256(q) AS h FROM h WHERE q <> '' UNION ALL SELECT pair_id, sha256(a) FROM h WHERE a <> '' UNION ALL SELECT pair_id, sha256(q || '|||' || a) FROM h WHERE q <> '' AND a <> '')
SELECT DISTINCT pair_id FROM k WHERE pair_id % 1000 < 500 AND h IN (SELECT h FROM k WHERE pair_id % 1000 >= 500)""")
def contamination_exact(spark, sf_dir):
    pairs = _twice(spark, sf_dir)
    return curate.contaminated_exact(pairs.where("pair_id % 1000 < 500"), pairs.where("pair_id % 1000 >= 500"))


_GRAMS = "SELECT DISTINCT {0}, substr(t, i, 5) AS g FROM (SELECT {0}, t, unnest(range(1, length(t) - 3)) AS i FROM (SELECT {0}, " + _N.format("text") + " AS t FROM {1}) WHERE length(t) > 4)"


@query(f"""WITH a AS ({_GRAMS.format('item_id', 'benchmark')}), b AS ({_GRAMS.format('doc_id', 'documents')}), na AS (SELECT item_id, count(*) AS na FROM a GROUP BY item_id), nb AS (SELECT doc_id, count(*) AS nb FROM b GROUP BY doc_id),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM a JOIN b USING (g) GROUP BY item_id, doc_id), o AS (SELECT item_id, doc_id, hits / least(na, nb)::DOUBLE AS overlap FROM h JOIN na USING (item_id) JOIN nb USING (doc_id))
SELECT item_id, min(doc_id) AS doc_id, round(arg_min(overlap, doc_id), 6) AS overlap FROM o WHERE overlap >= 0.3::DOUBLE GROUP BY item_id""")
def contamination_ngram(spark, sf_dir):
    return curate.contaminated_ngrams(table(spark, sf_dir, "benchmark"), spread_table(spark, sf_dir, "documents"))


_DUPS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id < b.vec_id), k AS (SELECT * FROM d WHERE score >= 0.3::DOUBLE)"""


@query(f"WITH {_DUPS} SELECT i, j, score FROM k")
def semantic_dup_pairs(spark, sf_dir):
    return curate.similar_vectors(table(spark, sf_dir, "embeddings"), 0.3)


@query(f"WITH {_DUPS} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT j FROM k)")
def dedup_semantic(spark, sf_dir):
    """Of every pair the later goes, whether or not the earlier goes as well."""
    rows = table(spark, sf_dir, "embeddings")
    gone = curate.similar_vectors(rows, 0.3).select(F.col("j").alias("vec_id")).distinct()
    return rows.join(gone, "vec_id", "left_anti").select("vec_id")


_U = "(('0x' || substr(sha256(question || '|||' || answer || '|||42'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


@query(f"WITH {PAIRS} SELECT pair_id, CASE WHEN {_U} < 0.8::DOUBLE THEN 'train' WHEN {_U} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split FROM pairs")
def split_hash(spark, sf_dir):
    return curate.split_by_hash(pairs_of(spark, sf_dir)).select("pair_id", "split")


_RATIO = "r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), s AS (SELECT doc_id, CASE WHEN pos < (n * 0.8::DOUBLE)::DECIMAL(20,6)::BIGINT - 0 AND pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)".replace("pos < (n * 0.8::DOUBLE)::DECIMAL(20,6)::BIGINT - 0 AND ", "")


@query(f"WITH {_RATIO} SELECT doc_id, split FROM s")
def split_ratio(spark, sf_dir):
    return curate.split_by_ratio(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"WITH {_RATIO} SELECT doc_id FROM s WHERE split = 'val'")
def split_isolation(spark, sf_dir):
    return curate.isolate(split_ratio(spark, sf_dir), "val").select("doc_id")


@query(f"""WITH {PAIRS}, a AS (SELECT question, arg_max(answer, pair_id) AS x FROM pairs WHERE conv_id % 3 <> 0 GROUP BY question),
b AS (SELECT question, arg_max(CASE WHEN conv_id % 5 = 0 THEN answer || '!' ELSE answer END, pair_id) AS y FROM pairs WHERE conv_id % 3 <> 1 GROUP BY question)
SELECT question, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (question) WHERE x IS DISTINCT FROM y""")
def version_diff(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    changed = F.when(F.col("conv_id") % 5 == 0, F.concat("answer", F.lit("!"))).otherwise(F.col("answer"))
    return curate.version_diff(pairs.where("conv_id % 3 <> 0"), pairs.where("conv_id % 3 <> 1").withColumn("answer", changed))


@query(f"""WITH {PAIRS}, c AS (SELECT pair_id, unnest([conv_id, conv_id + 50]) AS chunk_id FROM pairs)
SELECT pair_id, chunk_id FROM c WHERE chunk_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)""")
def unknown_chunk_ids(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir).withColumn("source_chunk_ids", F.array(F.col("conv_id"), F.col("conv_id") + 50))
    chunks = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.col("doc_id").alias("chunk_id"))
    return curate.unknown_chunks(pairs, chunks)


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'de'), b AS (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND doc_id % 2 = 0)
SELECT source, 'both' AS part FROM (SELECT source FROM a INTERSECT SELECT source FROM b) UNION ALL SELECT source, 'first' FROM (SELECT source FROM a EXCEPT SELECT source FROM b)""")
def set_ops(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.where("lang = 'de'").select("source")
    b = docs.where("lang = 'es' AND doc_id % 2 = 0").select("source")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("first")))


@query()
def chunk_fixed(spark, sf_dir):
    """A sequential fold; tests hold it against hand-computed cases."""
    return chunking.chunk(spread_table(spark, sf_dir, "documents"), chunking.ChunkConfig("fixed", 500, 100))


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunk(spread_table(spark, sf_dir, "documents"), chunking.ChunkConfig("recursive", 1000, 200))


@query()
def chunk_semantic(spark, sf_dir):
    return chunking.chunk(spread_table(spark, sf_dir, "documents"), chunking.ChunkConfig("semantic", 2000, 0))


@query()
def chunk_counts(spark, sf_dir):
    chunks = chunk_recursive(spark, sf_dir)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).cast("long").alias("longest"))
