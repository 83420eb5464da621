"""Streaming queries. Over a finite table their results have a batch equivalent, which is their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import processors, progress
from .registry import query


def _stream(t):
    return progress.source(t.spark, f"{t.sf_dir}/events.parquet")


def _ntz(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("st_tumbling_completions", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def st_tumbling_completions(t):
    return progress.drained(progress.tumbling(_stream(t)), "complete").select(_ntz("start"), "n")


@query("st_sliding_breaker", "WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start FROM events WHERE event_type = 'error') SELECT event_type, start, count(*) AS n, count(*) >= 3 AS tripped FROM w GROUP BY ALL")
def st_sliding_breaker(t):
    rows = _stream(t).where("event_type = 'error'")
    return progress.drained(progress.sliding(rows, "event_type", "1 hour", "30 minutes", 3), "complete").select("event_type", _ntz("start"), "n", "tripped")


@query(
    "st_session_activity",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 45 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 45 MINUTES AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def st_session_activity(t):
    return progress.drained(progress.sessions(_stream(t), "user_id", "45 minutes"), "complete").select("user_id", _ntz("start"), _ntz("end"), "n")


@query("st_dedup_jobs", "SELECT DISTINCT user_id, event_type FROM events")
def st_dedup_jobs(t):
    return progress.drained(progress.distinct_jobs(_stream(t), ["user_id", "event_type"], "400 days").select("user_id", "event_type"))


@query("st_status_trace", "SELECT event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY event_type")
def st_status_trace(t):
    rows = _stream(t).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return progress.drained(rows, "update").groupBy("event_type").agg(F.max("n").alias("n"), F.max("last").cast("timestamp_ntz").alias("last"))


@query("st_breaker_state")
def st_breaker_state(t):
    start = {"recent": "", "open": False, "trips": 0, "probes": 0, "probe": 0.0}
    return progress.drained(progress.stateful(_stream(t), "user_id", progress.breaker, start, "recent string, open boolean, trips int, probes int, probe double", progress.breaker_ends)).drop("recent")


@query("st_job_state")
def st_job_state(t):
    return progress.drained(processors.processed(_stream(t), processors.Jobs()))


@query("st_pause_backoff")
def st_pause_backoff(t):
    return progress.drained(processors.processed(_stream(t), processors.Pauses()))


@query("st_delayed_retry", "SELECT user_id, count(*) AS retries FROM events WHERE event_type = 'error' GROUP BY user_id")
def st_delayed_retry(t):
    rows = progress.stateful(_stream(t), "user_id", progress.backoff, {"delay": 0.0, "until": 0.0, "retries": 0}, "delay double, until double, retries int", progress.backoff_ends)
    return progress.drained(rows).groupBy("user_id").agg(F.max("retries").cast("long").alias("retries")).where("retries > 0")


@query("st_ttl_cache")
def st_ttl_cache(t):
    return progress.drained(processors.processed(_stream(t), processors.Cached()))
