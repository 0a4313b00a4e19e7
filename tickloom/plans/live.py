"""Registered queries of the streaming operators: a file source, run to completion; the SQL is of the same query on the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def _events(s: SparkSession, d: str) -> DataFrame:
    # a pattern: a stream's path would have to be a folder
    return s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events[.]parquet")


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


@register("stream_window_sliding", "SELECT epoch_us(w) AS \"start\", event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def _(s, d):
    out = windows.finished(windows.sliding_counts(_events(s, d), "2 days", "1 day", "1 hour"), "start timestamp, event_type string, n long, total double")
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", "total")


@register("stream_session", f"SELECT user_id, min(epoch_us(ts)) AS \"start\", max(epoch_us(ts)) + {24 * HOUR} AS \"end\", count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {24 * HOUR} THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, k")
def _(s, d):
    out = windows.finished(windows.session_counts(_events(s, d), "user_id", "24 hours", "1 hour"), "user_id long, start timestamp, end timestamp, n long")
    return out.select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@register("stream_watermark", "SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, ts FROM events) GROUP BY ALL")
def _(s, d):
    seen = _events(s, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "365 days").dropDuplicatesWithinWatermark(["event_type", "user_id", "ts"])
    out = windows.finished(seen.select("event_type", "user_id", "ts"), "event_type string, user_id long, ts timestamp", "append")
    return out.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@register(
    "stream_fps",
    f"""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS pts, value AS v FROM events), a AS (SELECT *, (pts + {HOUR // 2}) // {HOUR} AS slot FROM s),
    b AS (SELECT *, lead(slot) OVER (PARTITION BY user_id ORDER BY pts, event_id) AS nxt FROM a)
    SELECT user_id, unnest(range(slot, nxt)) AS slot, v FROM b WHERE nxt IS NOT NULL""",
)
def _(s, d):
    return windows.finished(windows.held_slots(_events(s, d), "user_id", HOUR), "user_id long, slot long, v double", "append")


@register(
    "stream_freeze",
    f"""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS pts, value AS v FROM events),
    a AS (SELECT *, coalesce(abs(v - lag(v) OVER w) <= 20, false) AS h, lag(pts) OVER w AS pp, lead(pts) OVER w AS np, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pts, event_id)),
    b AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, h ORDER BY pts, event_id) AS g FROM a)
    SELECT user_id, min(pp) AS freeze_start, arg_max(np, n) FILTER (WHERE n = mx) AS freeze_end FROM (SELECT *, max(n) OVER (PARTITION BY user_id, h, g) AS mx FROM b) WHERE h GROUP BY user_id, g HAVING max(pts) - min(pp) >= {2 * HOUR} AND arg_max(np, n) FILTER (WHERE n = mx) IS NOT NULL""",
)
def _(s, d):
    return windows.finished(windows.freezes(_events(s, d), "user_id", 20.0, 2 * HOUR), "user_id long, freeze_start long, freeze_end long", "append")
