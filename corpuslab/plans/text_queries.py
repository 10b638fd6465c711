"""Cleaning and metadata queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import docmeta, text
from .base import SAMPLE_SQL, query, spread_table, sql_text, table, with_samples


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_samples(spread_table(spark, sf_dir, "documents"))


def _replaced(pattern: str, by: str, of: str = "text") -> str:
    return f"regexp_replace({of}, {sql_text(pattern)}, {sql_text(by)}, 'g')"


@query(SAMPLE_SQL + f"SELECT doc_id, {_replaced(text.EMAIL, '[EMAIL]')} AS text FROM t")
def redact_emails(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.redact_emails(F.col("text")).alias("text"))


@query(SAMPLE_SQL + f"SELECT doc_id, {_replaced(text.PHONE, '[PHONE]')} AS text FROM t")
def redact_phones(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.redact_phones(F.col("text")).alias("text"))


@query(SAMPLE_SQL + f"SELECT doc_id, {_replaced(text.PHONE, '', _replaced(text.EMAIL, ''))} AS text FROM t")
def remove_pii(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.remove_pii(F.col("text"), redact=False).alias("text"))


@query(SAMPLE_SQL + f"SELECT doc_id, {_replaced('(?i)' + text.URL, '')} AS text FROM t")
def strip_urls(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.strip_urls(F.col("text")).alias("text"))


@query(f"SELECT page_id, unnest(regexp_extract_all(url || ' and ' || url, {sql_text('(?i)' + text.URL)})) AS url FROM pages")
def extract_urls(spark, sf_dir):
    both = F.concat("url", F.lit(" and "), "url")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.extract_urls(both)).alias("url"))


_citations = "text"
for _p in text.CITATIONS:
    _citations = _replaced(_p, "", _citations)


@query(SAMPLE_SQL + f"SELECT doc_id, {_citations} AS text FROM t")
def strip_citations(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.strip_citations(F.col("text")).alias("text"))


@query(SAMPLE_SQL + "SELECT doc_id, " + _replaced(r"(?m)^\s*\d+\s*$", "", r"regexp_replace(text, '\n\s*\d+\s*\n', chr(10), 'g')") + " AS text FROM t")
def strip_page_numbers(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.strip_page_numbers(F.col("text")).alias("text"))


@query(SAMPLE_SQL + r"SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) > 30 OR regexp_replace(x, '\s+', '', 'g') = ''), chr(10)), '') AS text FROM t")
def strip_short_lines(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.strip_short_lines(F.col("text")).alias("text"))


@query(SAMPLE_SQL + r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x{00a0}]+', ' ', 'g')) AS text FROM t")
def squeeze_whitespace(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.squeeze_whitespace(F.col("text")).alias("text"))


_typography = "text"
for _old, _new in text.REPLACEMENTS:
    _typography = f"replace({_typography}, {sql_text(_old)}, {sql_text(_new)})"


@query(SAMPLE_SQL + f"SELECT doc_id, {_typography} AS text FROM t")
def unicode_replacements(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.replace_typography(F.col("text")).alias("text"))


@query(SAMPLE_SQL + f"SELECT doc_id, {_typography.replace('text', 'nfc_normalize(text)')} AS text FROM t")
def unicode_nfc(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.normalize_unicode(F.col("text")).alias("text"))


_tags = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<a\s[^>]*href=[\"''\x27]([^\"''\x27]*)[\"''\x27][^>]*>([^<]*)</a>', '\2 (\1)', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))".replace("''", "")


@query(f"SELECT page_id, {_tags} AS text FROM pages")
def html_tags_to_text(spark, sf_dir):
    return spread_table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html"), entities=False).alias("text"))


@query()
def html_to_text(spark, sf_dir):
    """With entities decoded, which DuckDB cannot; tests hold it against html.unescape."""
    return spread_table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(SAMPLE_SQL + "SELECT doc_id, " + _replaced(text.PHONE, "", _replaced(text.EMAIL, "", _citations.replace("text", _replaced("(?i)" + text.URL, ""), 1))) + " AS text FROM t WHERE trim(text) <> ''")
def clean_pipeline(spark, sf_dir):
    docs = _texts(spark, sf_dir).where(F.trim("text") != "")
    return docs.select("doc_id", text.clean(F.col("text")).alias("text"))


@query()
def clean_outside_code(spark, sf_dir):
    """Code fences and inline code are left as they are; tests hold it against a Python form."""
    return _texts(spark, sf_dir).select("doc_id", text.clean(F.col("text"), preserve_code=True).alias("text"))


_WORDS = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))"
_SYLLABLES = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(w), 'e$', ''), '[aeiouy]+'))) END"


@query(f"""
WITH a AS (SELECT doc_id, length(text) AS c, {_WORDS} AS ws,
  len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) AS s FROM documents),
b AS (SELECT *, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS l,
  coalesce(list_sum(list_transform(ws, lambda w: {_SYLLABLES})), 0) AS y FROM a)
SELECT doc_id, n::BIGINT AS word_count, c::BIGINT AS char_count, s::BIGINT AS sentence_count, y::BIGINT AS syllable_count,
  round_even((CASE WHEN n = 0 THEN 0 ELSE l::DOUBLE / n END) * 100::DOUBLE, 0) / 100::DOUBLE AS avg_word_length,
  round_even((CASE WHEN n = 0 OR s = 0 THEN 0 ELSE least(100, greatest(0, 206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / s) - 84.6::DOUBLE * (y::DOUBLE / n))) END) * 100::DOUBLE, 0) / 100::DOUBLE AS flesch_ease,
  round_even((CASE WHEN n = 0 OR s = 0 THEN 0 ELSE greatest(0, 0.39::DOUBLE * (n::DOUBLE / s) + 11.8::DOUBLE * (y::DOUBLE / n) - 15.59::DOUBLE) END) * 100::DOUBLE, 0) / 100::DOUBLE AS fk_grade FROM b""")
def text_statistics(spark, sf_dir):
    return docmeta.text_statistics(spread_table(spark, sf_dir, "documents"))


_hits = ", ".join(f"struct_pack(h := len(list_intersect(ws, [{', '.join(map(sql_text, m))}])), o := {-n}, c := '{code}')" for n, (code, m) in enumerate(docmeta.MARKERS.items()))
_LANGUAGE = f"""a AS (SELECT doc_id, lang, list_distinct(list_transform({_WORDS}, lambda x: lower(x))) AS ws FROM documents),
b AS (SELECT doc_id, lang, list_max([{_hits}]) AS m FROM a),
g AS (SELECT doc_id, lang, CASE WHEN m.h > 0 THEN m.c ELSE 'unknown' END AS language, round(m.h / 10.0::DOUBLE, 3) AS confidence FROM b)"""


def _languages(spark, sf_dir):
    words = F.array_distinct(F.transform(docmeta.ascii_words(F.col("text")), lambda x: F.lower(x)))
    docs = spread_table(spark, sf_dir, "documents").withColumn("words", words)
    return docs.select("doc_id", "lang", docmeta.detect_language(F.col("words")).alias("x")).select("doc_id", "lang", "x.*")


@query(f"WITH {_LANGUAGE} SELECT doc_id, language, confidence FROM g")
def detect_language(spark, sf_dir):
    return _languages(spark, sf_dir).select("doc_id", "language", "confidence")


@query(f"WITH {_LANGUAGE} SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = language) AS n_right FROM g GROUP BY lang")
def language_accuracy(spark, sf_dir):
    right = F.count_if(F.col("lang") == F.col("language")).alias("n_right")
    return _languages(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), right)


@query(f"""
WITH sent AS (SELECT doc_id, s, sentence FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]')) AS sentence, generate_subscripts(regexp_split_to_array(lower(text), '[.!?\\n]'), 1) AS s FROM documents)),
w AS (SELECT doc_id, s, unnest(regexp_extract_all(sentence, '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(sentence, '[a-z]+'), 1) AS i FROM sent),
f AS (SELECT *, (length(word) < 2 OR word IN ({', '.join(map(sql_text, docmeta.STOPWORDS))}))::INT AS stop FROM w),
g AS (SELECT *, sum(stop) OVER (PARTITION BY doc_id ORDER BY s, i ROWS UNBOUNDED PRECEDING) AS island FROM f),
k AS (SELECT * FROM g WHERE stop = 0),
p AS (SELECT doc_id, s, island, string_agg(word, ' ' ORDER BY i) AS phrase, count(*) AS n FROM k GROUP BY ALL),
e AS (SELECT k.doc_id, k.s, k.island, k.word, p.n FROM k JOIN p USING (doc_id, s, island)),
sc AS (SELECT doc_id, word, sum(n) / count(*)::DOUBLE AS x FROM e GROUP BY ALL),
ps AS (SELECT e.doc_id, e.s, e.island, sum(x) AS score FROM e JOIN sc USING (doc_id, word) GROUP BY ALL),
u AS (SELECT doc_id, phrase, round(max(score), 6) AS score, min((s, island)) AS first FROM p JOIN ps USING (doc_id, s, island) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank FROM u)
SELECT doc_id, phrase, score, rank::INT AS rank FROM r WHERE rank <= 15""")
def rake_keywords(spark, sf_dir):
    return docmeta.rake_keywords(spread_table(spark, sf_dir, "documents"))


@query("""
WITH l AS (SELECT * FROM (SELECT 'text' AS name, 0 AS pref, avg(length(text)) AS mean FROM documents UNION ALL SELECT 'lang', 9, avg(length(lang)) FROM documents UNION ALL SELECT 'source', 9, avg(length(source)) FROM documents))
SELECT name AS text_column, round(mean, 6) AS mean_length FROM l ORDER BY pref, mean DESC, name LIMIT 1""")
def suggest_text_column(spark, sf_dir):
    from ..sources.files import suggest_text_column as suggest

    return suggest(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query("""
SELECT o_orderkey AS row_key, 'o_orderpriority: ' || o_orderpriority || chr(10) || 'o_orderstatus: ' || o_orderstatus AS content FROM orders""")
def csv_text_columns(spark, sf_dir):
    """No column is long on average, so every text column is used."""
    from ..sources.files import rows_to_text

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return rows_to_text(rows, ["o_orderpriority", "o_orderstatus"]).select(F.col("o_orderkey").alias("row_key"), "content")
