"""Question-answer importers for three public formats, and their registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQUAD = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,"
    "is_impossible:boolean,answers:array<struct<text:string>>>>>>>>"
)
NQ = (
    "question_text string, question string, document_text string, example_id string, answer string, "
    "annotations array<struct<yes_no_answer:string,short_answers:array<struct<text:string,start_token:int,end_token:int>>>>"
)
MSMARCO = "query_id string, query string, answers array<string>, wellFormedAnswers array<string>"
NO_ANSWER = "No Answer Present."
COLUMNS = ("source_id", "question", "expected_answer", "alternative_answers", "answer_type")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def squad(spark: SparkSession, path: str, with_impossible: bool = False) -> DataFrame:
    return squad_pairs(spark.read.text(path, wholetext=True), with_impossible)


def squad_pairs(values: DataFrame, with_impossible: bool = True) -> DataFrame:
    """Questions with an answer; alternatives are the other distinct non-blank answers. ``values`` has whole files."""
    raw = values.select(F.from_json("value", SQUAD).alias("x")).select("x.*")
    qas = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
    texts = F.filter(F.col("q.answers.text"), lambda t: ~_blank(t))
    impossible = F.coalesce("q.is_impossible", F.lit(False))
    rows = qas.select(
        F.col("q.id").alias("source_id"), F.trim("q.question").alias("question"), impossible.alias("impossible"),
        F.when(impossible, F.lit("[UNANSWERABLE]")).otherwise(F.get(texts, F.lit(0))).alias("expected_answer"),
        F.when(impossible, F.array().cast("array<string>")).otherwise(F.array_except(F.array_distinct(texts), F.slice(texts, 1, 1))).alias("alternative_answers"),
        F.lit("extractive").alias("answer_type"), F.substring("context", 1, 200).alias("context_preview"),
    )
    kept = rows.where(~_blank(F.col("question")) & F.col("expected_answer").isNotNull())
    return (kept if with_impossible else kept.where("NOT impossible")).select(*COLUMNS, "context_preview")


def natural_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines where a file has more than one and begins with an object, else one JSON value (a list or an object)."""
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    by_line = (F.size(lines) > 1) & F.startswith(F.ltrim(F.get(lines, F.lit(0))), F.lit("{")) & F.endswith(F.rtrim(F.get(lines, F.lit(0))), F.lit("}"))
    whole = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return natural_question_pairs(files.select(F.explode(F.when(by_line, lines).otherwise(whole)).alias("value")))


def natural_question_pairs(values: DataFrame) -> DataFrame:
    """Yes/no answers, short answers by text or token slice, or flat question and answer. Broken records give nothing."""
    raw = values.select(F.from_json("value", NQ).alias("x")).select("x.*")
    note = F.get("annotations", F.lit(0))
    tokens = F.split(F.coalesce("document_text", F.lit("")), r"\s+")

    def short(a: Column) -> Column:
        span = F.array_join(F.slice(tokens, a["start_token"] + 1, F.greatest(a["end_token"] - a["start_token"], F.lit(0))), " ")
        return F.when(~_blank(a["text"]), F.trim(a["text"])).otherwise(span)

    texts = F.filter(F.transform(F.coalesce(note["short_answers"], F.array()), short), lambda t: ~_blank(t))
    yes_no = F.lower(note["yes_no_answer"])
    answer = F.when(yes_no.isin("yes", "no"), yes_no).otherwise(F.coalesce(F.get(texts, F.lit(0)), F.col("answer")))
    rows = raw.select(
        F.col("example_id").alias("source_id"), F.trim(F.coalesce("question_text", "question")).alias("question"), answer.alias("expected_answer"),
        F.when(yes_no.isin("yes", "no"), F.array().cast("array<string>")).otherwise(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0)))).alias("alternative_answers"),
        F.when(yes_no.isin("yes", "no"), "yes_no").otherwise("extractive").alias("answer_type"),
    )
    return rows.where(~_blank(F.col("question")) & ~_blank(F.col("expected_answer")))


def msmarco(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or tab-separated query and answer where the file ends in .tsv."""
    if not path.endswith(".tsv"):
        return msmarco_pairs(spark.read.text(path))
    # The columns by the names in the first line, by position where it has none.
    head = (spark.read.text(path).first() or [""])[0].lower().split("\t")
    asked = next((i for i, name in enumerate(head) if name in ("query", "question")), None)
    told = next((i for i, name in enumerate(head) if name in ("answer", "answers")), None)
    named = asked is not None or told is not None
    raw = spark.read.csv(path, sep="\t", header=named, schema=", ".join(f"c{i} string" for i in range(max(2, len(head)))))
    q, a = F.col(f"c{asked or 0}"), F.col(f"c{1 if told is None else told}")
    raw = raw.select(F.md5(q).alias("query_id"), q.alias("query"), F.array(a).alias("answers"), F.lit(None).cast("array<string>").alias("wellFormedAnswers"))
    return _msmarco(raw)


def msmarco_pairs(values: DataFrame) -> DataFrame:
    """Records of JSON lines; broken ones give nothing."""
    return _msmarco(values.select(F.from_json("value", MSMARCO).alias("x")).select("x.*"))


def _msmarco(raw: DataFrame) -> DataFrame:

    def good(answers: Column) -> Column:
        return F.filter(F.coalesce(answers, F.array()), lambda t: ~_blank(t) & (t != NO_ANSWER) & (t != "[]"))

    texts = F.when(F.size(good(F.col("answers"))) > 0, good(F.col("answers"))).otherwise(good(F.col("wellFormedAnswers")))
    rows = raw.select(
        F.col("query_id").alias("source_id"), F.trim("query").alias("question"), F.get(texts, F.lit(0)).alias("expected_answer"),
        F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))).alias("alternative_answers"), F.lit("abstractive").alias("answer_type"),
    )
    return rows.where(~_blank(F.col("question")) & F.col("expected_answer").isNotNull())


IMPORTERS = {"squad": (squad, (".json",)), "natural_questions": (natural_questions, (".json", ".jsonl")), "msmarco": (msmarco, (".json", ".jsonl", ".tsv"))}


def import_pairs(spark: SparkSession, name: str, path: str, answer_type: str | None = None, difficulty: str | None = None, max_pairs: int | None = None, **options) -> DataFrame:
    """Pairs of a known format with overrides; unknown names and endings raise. ``options`` go to the reader: SQuAD's unanswerable questions come with ``with_impossible=True``."""
    if name not in IMPORTERS:
        raise ValueError(f"unknown importer {name}")
    reader, endings = IMPORTERS[name]
    if not path.endswith(endings):
        raise ValueError(f"{name} reads {', '.join(endings)}")
    pairs = reader(spark, path, **options)
    if answer_type:
        pairs = pairs.withColumn("answer_type", F.lit(answer_type))
    pairs = pairs.withColumn("difficulty", F.lit(difficulty or "medium"))
    return pairs.orderBy("source_id").limit(max_pairs) if max_pairs else pairs
