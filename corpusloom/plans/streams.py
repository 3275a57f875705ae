"""Queries that run as streams over the test tables and give what their batch twins give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from . import relational, standins


def _events(spark, sf_dir):
    return jobs.read(spark, f"{sf_dir}/events.parquet")


def stream_tumbling_counts(spark, sf_dir):
    return jobs.snapshot(jobs.tumbling(_events(spark, sf_dir), "ts", "1 hour", ["event_type"]), jobs.work_dir(spark))


def stream_session_activity(spark, sf_dir):
    return jobs.snapshot(jobs.sessions(_events(spark, sf_dir), "ts", "30 minutes", "user_id"), jobs.work_dir(spark))


def stream_dedup(spark, sf_dir):
    x = jobs.distinct(_events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])
    return jobs.appended(x, jobs.work_dir(spark))


def stream_retry_state(spark, sf_dir):
    return jobs.appended(jobs.retries(_events(spark, sf_dir).where("event_type = 'error'"), "user_id"), jobs.work_dir(spark))


def stream_highest_values(spark, sf_dir):
    x = _events(spark, sf_dir).select("event_type", "event_id", "value")
    return jobs.top_of_each(x, jobs.work_dir(spark), ["event_type"], [F.desc("value"), F.col("event_id")], 3)


def stream_ingest_counts(spark, sf_dir):
    at = jobs.work_dir(spark)
    return jobs.ingest(jobs.read(spark, f"{sf_dir}/documents.parquet"), at, f"{at}/hashes").agg(F.sum("inserted").alias("inserted"), F.sum("duplicate").alias("duplicate"))


QUERIES = {f.__name__: f for f in (stream_tumbling_counts, stream_session_activity, stream_dedup, stream_retry_state, stream_highest_values, stream_ingest_counts)}
ORACLES = {
    "stream_tumbling_counts": relational.ORACLES["tumbling_counts"],
    "stream_session_activity": relational.ORACLES["session_activity"],
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_retry_state": "SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 3 THEN 'failed' ELSE 'pending' END AS status FROM events WHERE event_type = 'error' GROUP BY user_id",
    "stream_highest_values": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) x WHERE rn <= 3",
    "stream_ingest_counts": "SELECT count(DISTINCT text) AS inserted, count(*) - count(DISTINCT text) AS duplicate FROM documents",
}
