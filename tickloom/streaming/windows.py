"""Streaming forms: watermarked windows and sessions, and operators that keep state for each stream.

A stream has no end that Spark could tell an operator about: what a window or a run still holds when a query stops is not
emitted in append mode (``finished`` runs aggregates in complete mode, which holds all of their groups). Records of one
micro-batch may come in any order; stateful operators sort them, and expect later batches not to be older.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def sliding_counts(events: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """(start, event_type, n, total) of sliding windows, batch or stream; later records than ``late`` are dropped."""
    ts = F.col("ts").cast("timestamp")
    marked = events.withColumn("ts", ts).withWatermark("ts", late)
    out = marked.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, by: str, gap: str, late: str) -> DataFrame:
    """(by, start, end, n) of sessions: records less than ``gap`` apart; a session ends a gap after its last record."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = marked.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _stateful(events: DataFrame, by: str, step, out: str, state: str) -> DataFrame:
    """``step(values, state)`` takes a stream's new records in order, and gives rows and the state that is kept."""
    ship(events.sparkSession)
    pts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = events.select(F.col(by).cast("long").alias(by), pts.alias("pts"), F.col("value").cast("double").alias("v"), "event_id")
    columns = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values(["pts", "event_id"])
        made, kept = step(zip(new["pts"].tolist(), new["v"].tolist(), strict=True), held.get if held.exists else None)
        held.update(kept)
        yield pd.DataFrame([(key[0], *row) for row in made], columns=columns)

    return rows.groupBy(by).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def held_slots(events: DataFrame, by: str, tick: int) -> DataFrame:
    """(by, slot, v): a record for each slot of ``tick`` until the next record's slot; the newest record waits for its successor."""

    def step(records, state):
        slot, v = state if state else (None, None)
        made = []
        for pts, value in records:
            now = (pts + tick // 2) // tick
            if slot is not None:
                made += [(k, v) for k in range(slot, now)]
            slot, v = now, value
        return made, (slot, v)

    return _stateful(events, by, step, f"{by} long, slot long, v double", "slot long, v double")


def freezes(events: DataFrame, by: str, noise: float, duration: int) -> DataFrame:
    """(by, freeze_start, freeze_end) of runs of small differences that have been broken; see ``operators.windows.freezedetect``."""

    def step(records, state):
        last_pts, last_v, start, end = state if state else (None, None, None, None)
        made = []
        for pts, v in records:
            if last_pts is not None and abs(v - last_v) <= noise:
                start, end = (last_pts if start is None else start), pts
            elif start is not None:
                if end - start >= duration:
                    made.append((start, pts))
                start = end = None
            last_pts, last_v = pts, v
        return made, (last_pts, last_v, start, end)

    return _stateful(events, by, step, f"{by} long, freeze_start long, freeze_end long", "last_pts long, last_v double, start long, end long")


def run_available(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Writes what a stream has so far to Parquet files, in append mode, and returns them."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import atexit
    import shutil
    import tempfile

    own = tempfile.mkdtemp(prefix="tickloom-stream-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def finished(stream: DataFrame, schema: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and gives its result table, written below ``spark.checkpoint.dir``."""
    spark = stream.sparkSession
    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run_available(spark, stream, f"{base}/out", f"{base}/state")
        return spark.read.schema(schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")
