"""Queries that run as streams over the available files, held against the same computation in one batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table
from millrace.streaming import incremental as I


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    folder = os.path.join(sf, f"{name}.parquet")
    if os.path.isdir(folder):
        return spark.readStream.schema(schema).parquet(folder)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _ran(stream: DataFrame, spark: SparkSession, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Rows the stream leaves behind."""
    out = I.work_folder(spark, "stream")
    I.run_available(stream, I.keep_batch(out), I.work_folder(spark, "progress"), mode)
    return I.kept(spark, out, stream.schema, mode, keys)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t13_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _ran(I.windowed_counts(e, "ts", "event_type", "1 hour"), spark, "complete")
    return done.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def t13_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _ran(I.sessions(e, "ts", "user_id", "6 hours"), spark, "complete")
    return done.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def t10_last_write(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return _ran(e, spark, "complete")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t03_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the same consumer, the second with its progress lost: what is in the output is not taken again."""
    schema = table(spark, sf, "events").schema
    folder = os.path.join(sf, "events.parquet")
    log, glob = (folder, None) if os.path.isdir(folder) else (sf, "events.parquet")
    out = I.work_folder(spark, "answers")
    for _ in range(2):
        I.consume(spark, log, schema, out, ["event_id"], lambda rows: rows.select("event_id", "event_type"), I.work_folder(spark, "progress"), glob=glob)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS start, event_type, value FROM events, (SELECT unnest([0, 1, 2]) AS k))
    SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"""
)
def t13_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three hours, one beginning every hour."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = _ran(I.windowed_counts(e, "ts", "event_type", "3 hours", "1 hour"), spark, "complete")
    return done.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH r AS (SELECT user_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), c AS (SELECT user_id, i, count(*) FILTER (ok) OVER w AS good, i - coalesce(max(i) FILTER (ok) OVER w, 0) AS bad FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)),
    s AS (SELECT user_id, coalesce(min(i) FILTER (good >= 20 OR bad >= 8), max(i)) AS i FROM c GROUP BY user_id)
    SELECT user_id, good AS filled, bad AS failures, CASE WHEN good >= 20 THEN 'filled' WHEN bad >= 8 THEN 'given up' ELSE 'open' END AS state FROM c JOIN s USING (user_id, i)"""
)
def t08_stateful_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: successes up to 20, given up after 8 failures in a row."""
    e = _stream(spark, sf, "events").select("user_id", F.coalesce(F.col("value") > 50, F.lit(False)).alias("ok"), F.col("event_id").alias("seq"))
    return _ran(I.fill_to_target(e, "user_id", "ok", 20, 8), spark, "update", ["user_id"])
