"""Job states, pauses and caches as stateful processors, whose state is several variables in RocksDB.

Each processor folds a key's events in the order of their time within a batch, as the plain functions in ``progress`` do, gives the state
after each batch, and registers an event-time timer for when its state is of no more use: then the state is given once more with ``expired``
true, and cleared. What a processor holds can be read from its checkpoint (``state_of``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import progress

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Folded(StatefulProcessor):
    """A fold whose state is one value; subclasses say how it is made of state variables."""

    #: columns of the state that come out, and their types
    output = ""

    def load(self) -> dict:
        raise NotImplementedError

    def save(self, now: dict, events: list[tuple[str, float]]) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def step(self, now: dict, kind: str, at: float) -> None:
        raise NotImplementedError

    def ends(self, now: dict) -> float:
        """Until when the state is of use, in seconds; 0: not beyond the last event."""
        return 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    @property
    def names(self) -> list[str]:
        return [x.split()[0] for x in self.output.split(", ")]

    def _row(self, key: tuple, now: dict, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *(now[n] for n in self.names), expired]], columns=["user_id", *self.names, "expired"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        moments = [(kind, ts.timestamp()) for kind, ts in zip(events["event_type"], events["ts"])]
        now = self.load()
        for kind, at in moments:
            self.step(now, kind, at)
        self.save(now, moments)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(1000 * max(self.ends(now), moments[-1][1])), timerValues.getCurrentWatermarkInMs()) + 1)
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.load()
        self.clear()
        yield self._row(key, now, True)

    def close(self) -> None:
        pass


class Jobs(Folded):
    """A job's status as a value, and its claims as a list of their times."""

    output = "status string, attempts int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "status string")
        self.claims = handle.getListState("claims", "at double")

    def load(self) -> dict:
        return {"status": self.status.get()[0] if self.status.exists() else "pending", "attempts": len(list(self.claims.get())) if self.claims.exists() else 0, "new": []}

    def step(self, now: dict, kind: str, at: float) -> None:
        before = now["attempts"]
        progress.job(now, kind, at)
        if now["attempts"] > before:
            now["new"].append(at)

    def save(self, now: dict, events: list[tuple[str, float]]) -> None:
        self.status.update((now["status"],))
        for at in now["new"]:
            self.claims.appendValue((at,))

    def clear(self) -> None:
        self.status.clear()
        self.claims.clear()


class Pauses(Folded):
    """The pause that errors have led to as a value, and the errors of each day as a map."""

    output = "delay double, until double, retries int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pause = handle.getValueState("pause", "delay double, until double")
        self.days = handle.getMapState("days", "day long", "errors int")

    def load(self) -> dict:
        delay, until = self.pause.get() if self.pause.exists() else (0.0, 0.0)
        return {"delay": delay, "until": until, "retries": sum(v[0] for _, v in self.days.iterator()) if self.days.exists() else 0}

    def step(self, now: dict, kind: str, at: float) -> None:
        progress.backoff(now, kind, at)

    def ends(self, now: dict) -> float:
        return progress.backoff_ends(now)

    def save(self, now: dict, events: list[tuple[str, float]]) -> None:
        self.pause.update((now["delay"], now["until"]))
        more: dict[int, int] = {}
        for kind, at in events:
            if kind == "error":
                more[int(at // 86_400)] = more.get(int(at // 86_400), 0) + 1
        for day, n in more.items():
            self.days.updateValue((day,), ((self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0) + n,))

    def clear(self) -> None:
        self.pause.clear()
        self.days.clear()


class Cached(Folded):
    """A cached value's time, and its hits and misses, as values of their own."""

    output = "at double, hits int, misses int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "at double")
        self.counts = handle.getValueState("counts", "hits int, misses int")

    def load(self) -> dict:
        hits, misses = self.counts.get() if self.counts.exists() else (0, 0)
        return {"at": self.entry.get()[0] if self.entry.exists() else 0.0, "hits": hits, "misses": misses}

    def step(self, now: dict, kind: str, at: float) -> None:
        progress.cache(now, kind, at)

    def ends(self, now: dict) -> float:
        return progress.cache_ends(now)

    def save(self, now: dict, events: list[tuple[str, float]]) -> None:
        self.entry.update((now["at"],))
        self.counts.update((now["hits"], now["misses"]))

    def clear(self) -> None:
        self.entry.clear()
        self.counts.clear()


class Expiring(StatefulProcessor):
    """Answers of a cache by processing time: each entry is forgotten ``life`` milliseconds after it was put in, by the store itself.

    Gives, for each batch and key, the numbers of reads that found the entry and that put it in. Such a stream has batches without end, so it is
    stopped, not drained.
    """

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "kind string", "put_by long", self.life)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits = misses = 0
        for kind, event in sorted((k, e) for part in rows for k, e in zip(part["event_type"], part["event_id"])):
            if self.entries.containsKey((kind,)):
                hits += 1
            else:
                self.entries.updateValue((kind,), (int(event),))
                misses += 1
        yield pd.DataFrame({"user_id": [key[0]], "hits": [hits], "misses": [misses]})

    def close(self) -> None:
        pass


def with_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def processed(rows: DataFrame, processor: Folded, late: str = "1 day") -> DataFrame:
    """The states of all users of a stream of events (user_id, event_type, event_id, ts)."""
    with_rocks(rows.sparkSession)
    kind = dict(rows.dtypes)["user_id"]
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(processor, f"user_id {kind}, {processor.output}, expired boolean", "Append", "EventTime")


def expiring(rows: DataFrame, life: int) -> DataFrame:
    with_rocks(rows.sparkSession)
    return rows.groupBy("user_id").transformWithStateInPandas(Expiring(life), f"user_id {dict(rows.dtypes)['user_id']}, hits long, misses long", "Update", "ProcessingTime")


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stream's processor holds in one of its state variables after its last batch."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
