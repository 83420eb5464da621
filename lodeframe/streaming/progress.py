"""Streams of events: windows, breakers, job states.

Late data: rows older than the watermark are dropped; that rule is this library's own. Streams run with availableNow
into a Parquet sink and a checkpoint in the shared folder, so a lost executor or a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import folder
from ..sources.stored import log, put_batch


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream, with its times as timestamps."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema)
    # a folder is streamed file by file; a single file through its folder and name
    base, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    single = bool(files) and files[0][0].rstrip("/").endswith(f"/{name}")
    rows = rows.option("pathGlobFilter", name).parquet(base) if single else rows.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(rows: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that the stream gives for what is there now."""
    spark = rows.sparkSession
    out, checkpoint = folder(spark, "stream"), checkpoint or folder(spark, "stream-state")
    if mode == "append":  # a sink with a log of its own
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    else:
        rows.writeStream.foreachBatch(lambda df, n: put_batch(df, out, n)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return log(spark, out, rows.schema)
    return spark.read.schema(rows.schema).parquet(out)


def tumbling(rows: DataFrame, length: str = "5 minutes", late: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", length)).count().select(F.col("window.start").alias("start"), F.col("count").alias("n"))


def sliding(rows: DataFrame, key: str, length: str, step: str, limit: int, late: str = "1 day") -> DataFrame:
    counts = rows.withWatermark("ts", late).groupBy(key, F.window("ts", length, step)).count()
    return counts.select(key, F.col("window.start").alias("start"), F.col("count").alias("n"), (F.col("count") >= limit).alias("tripped"))


def sessions(rows: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    counts = rows.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).count()
    return counts.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def distinct_jobs(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stateful(rows: DataFrame, key: str, step: Callable[[dict, str, float], None], start: dict, state_schema: str, ends: Callable[[dict], float], late: str = "1 day") -> DataFrame:
    """Folds each key's events, in the order of their time within a batch, into a state; gives the state after each batch.

    ``ends`` says until when a state is of use (seconds; 0: not beyond its last event). A timer is set to that time: when the
    watermark passes it, the state is given once more with ``expired`` true, and forgotten; a later event starts anew.
    """
    names = [x.split()[0] for x in state_schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            now, expired = dict(zip(names, state.get)), True
            state.remove()
        else:
            now, expired = dict(zip(names, state.get)) if state.exists else dict(start), False
            events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for kind, ts in zip(events["event_type"], events["ts"]):
                step(now, kind, ts.timestamp())
            state.update(tuple(now[n] for n in names))
            last = events["ts"].iloc[-1].timestamp()
            state.setTimeoutTimestamp(max(int(1000 * max(ends(now), last)), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([[k[0], *(now[n] for n in names), expired]], columns=[key, *names, "expired"])

    kinds = dict(rows.dtypes)
    return rows.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {state_schema}, expired boolean", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def breaker(now: dict, kind: str, at: float, window: float = 3600.0, limit: int = 3, cool: float = 7200.0) -> None:
    """Errors of the last ``window`` seconds trip it; one probe is let through after each ``cool`` seconds; a purchase resets it."""
    if kind == "error":
        recent = [float(x) for x in now["recent"].split(",") if x and at - float(x) <= window] + [at]
        now["recent"] = ",".join(str(x) for x in recent)
        if len(recent) >= limit and not now["open"]:
            now["open"], now["trips"], now["probe"] = True, now["trips"] + 1, at
    elif kind == "purchase":
        now["open"], now["recent"] = False, ""
    elif now["open"] and at - now["probe"] >= cool:
        now["probes"], now["probe"] = now["probes"] + 1, at


def breaker_ends(now: dict, window: float = 3600.0, cool: float = 7200.0) -> float:
    recent = [float(x) for x in now["recent"].split(",") if x]
    return max([now["probe"] + cool if now["open"] else 0.0, *(x + window for x in recent)])


def job(now: dict, kind: str, at: float, most: int = 3) -> None:
    """pending, claimed, completed or failed; a claim only of a pending job, at most ``most`` attempts."""
    if kind == "view" and now["status"] == "pending":
        now["status"], now["attempts"] = "claimed", now["attempts"] + 1
    elif kind == "purchase" and now["status"] == "claimed":
        now["status"] = "completed"
    elif kind == "error" and now["status"] == "claimed":
        now["status"] = "failed" if now["attempts"] >= most else "pending"


def backoff(now: dict, kind: str, at: float, first: float = 30.0, most: float = 3600.0) -> None:
    """Each error inside or after a pause doubles the next one; a purchase resets it."""
    if kind == "error":
        now["delay"] = min(most, now["delay"] * 2 if now["delay"] else first)
        now["until"] = at + now["delay"]
        now["retries"] += 1
    elif kind == "purchase":
        now["delay"], now["until"] = 0.0, 0.0


def backoff_ends(now: dict) -> float:
    """The pause's end: when the timer fires, work goes on."""
    return now["until"]


def cache(now: dict, kind: str, at: float, life: float = 86_400.0) -> None:
    """Reads of a value kept for ``life`` seconds."""
    if now["at"] and at - now["at"] <= life:
        now["hits"] += 1
    else:
        now["misses"], now["at"] = now["misses"] + 1, at


def cache_ends(now: dict, life: float = 86_400.0) -> float:
    """The value's time to live."""
    return now["at"] + life
