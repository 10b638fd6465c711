"""Streaming queries. Append mode holds back windows that the watermark has not closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams
from .base import query


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2""")
def tumbling_counts(spark, sf_dir):
    out = streams.run_to_end(streams.tumbling_counts(streams.read_events(spark, f"{sf_dir}/events.parquet")), "tumbling")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS is_new FROM events),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s, m GROUP BY user_id, sid, mark HAVING max(ts) + INTERVAL 30 MINUTE <= mark""")
def session_counts(spark, sf_dir):
    out = streams.run_to_end(streams.sessions(streams.read_events(spark, f"{sf_dir}/events.parquet")), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def dedup_stream(spark, sf_dir):
    """Each event twice; the second is dropped by its id."""
    events = streams.read_events(spark, f"{sf_dir}/events.parquet").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = streams.run_to_end(streams.first_of_each(events, "event_id"), "dedup")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS duplicate_of FROM documents")
def ingest_documents(spark, sf_dir):
    """Documents as a stream; contents are kept in keyed state."""
    stream = streams.first_of_content(streams.read_table(spark, f"{sf_dir}/documents.parquet"))
    return streams.run_to_end(stream, "ingest", timers=True).select("doc_id", "duplicate_of")
