"""Streaming extensions as queries: the stream is drained and its result compared like any other."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.sources.files import scratch
from corpusloom.streaming import events as E


@query("X1_stream_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def x1(spark, d):
    stream = E.tumbling(E.read_events(spark, f"{d}/events.parquet"))
    return E.run_changes(stream, scratch(spark, "stream-out"), scratch(spark, "stream"), ["window_start", "event_type"])


@query("X2_stream_distinct", "SELECT event_id, event_type FROM events")
def x2(spark, d):
    stream = E.without_repeats(E.read_events(spark, f"{d}/events.parquet")).select("event_id", "event_type")
    path = scratch(spark, "stream-out")
    E.append_files(stream, path, scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(path)


@query(
    "X3_stream_sessions",
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM g GROUP BY user_id, s",
)
def x3(spark, d):
    stream = E.sessions(E.read_events(spark, f"{d}/events.parquet"))
    return E.run_changes(stream, scratch(spark, "stream-out"), scratch(spark, "stream"), ["user_id", "session_start"]).where("n > 0")


@query("X4_stream_cleaning", "SELECT doc_id, replace(text, chr(9), ' ') AS text FROM documents")
def x4(spark, d):
    stream = E.read_files(spark, f"{d}/documents.parquet")
    out = scratch(spark, "stream-out")
    E.append_files(E.cleaned(stream).select("doc_id", "text"), out, scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(out)


@query(
    "X5_stream_sliding",
    "WITH s AS (SELECT unnest(generate_series(0, 3)) AS k), w AS (SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '15 minutes' AS window_start, event_type, value FROM events, s) SELECT window_start, event_type, count(*) AS n, sum(value) AS total FROM w GROUP BY 1, 2",
)
def x5(spark, d):
    stream = E.sliding(E.read_events(spark, f"{d}/events.parquet"))
    return E.run_changes(stream, scratch(spark, "stream-out"), scratch(spark, "stream"), ["window_start", "event_type"])


@query("X6_stream_overlap", "WITH ref AS (SELECT DISTINCT trim(text) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1', 'src2', 'src3') AND trim(text) NOT IN (SELECT n FROM ref)")
def x6(spark, d):
    held = F.col("source").isin("src0", "src1", "src2", "src3")
    stream = E.read_files(spark, f"{d}/documents.parquet").where(~held)
    out = scratch(spark, "stream-out")
    E.append_files(E.new_texts(stream, table(spark, d, "documents").where(held)).select("doc_id"), out, scratch(spark, "stream")).awaitTermination()
    return spark.read.schema("doc_id long").parquet(out)


@query("X7_stream_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def x7(spark, d):
    stream = E.read_events(spark, f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return E.run_changes(E.first_of_key(stream, "user_id", "event_id"), scratch(spark, "stream-out"), scratch(spark, "stream"), ["user_id"])
