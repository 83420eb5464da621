"""Stateful processors against plain folds, the state they keep, and entries that the store forgets."""

import random
import time

import pytest

from lodeframe.sources import stored
from lodeframe.sources.sinks import folder
from lodeframe.streaming import processors, progress

FOLDS = {
    "backoff": (processors.Pauses, progress.backoff, {"delay": 0.0, "until": 0.0, "retries": 0}, progress.backoff_ends),
    "cache": (processors.Cached, progress.cache, {"at": 0.0, "hits": 0, "misses": 0}, progress.cache_ends),
    "job": (processors.Jobs, progress.job, {"status": "pending", "attempts": 0}, lambda now: 0.0),
}


@pytest.fixture
def events(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1_700_000_000 + rng.randrange(0, 20 * 86_400), rng.randrange(12), rng.choice(["view", "error", "purchase", "click", "error"])) for i in range(400)]
    rows += [(1000 + i, 1_700_000_000 + 100 * i, 50, "error") for i in range(4)] + [(2000, 1_700_000_000, 51, "view")]  # long over
    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return rows, f"{tmp_path}/events.parquet"


@pytest.mark.parametrize("name", FOLDS)
def test_states_equal_a_plain_fold(spark, events, name):
    """Each user's state, and for those whose time is over when the watermark passes it, the state once more as it expires; then what is still held."""
    rows, path = events
    processor, step, start, ends = FOLDS[name]
    checkpoint = folder(spark, "processor")
    got = progress.drained(processors.processed(progress.source(spark, path), processor()), checkpoint=checkpoint).collect()
    watermark, want, held = max(s for _, s, *_ in rows) - 86_400, [], {}
    for user in {e[2] for e in rows}:
        now, mine = dict(start), sorted((s, i, k) for i, s, u, k in rows if u == user)
        for s, _, kind in mine:
            step(now, kind, float(s))
        want.append((user, *now.values(), False))
        if max(ends(now), mine[-1][0]) + 0.001 < watermark:
            want.append((user, *now.values(), True))
        else:
            held[user] = now
    assert sorted(map(tuple, got)) == sorted(want) and any(r.expired for r in got) and held
    read = lambda variable: processors.state_of(spark, checkpoint, variable)
    if name == "backoff":
        assert {r.key.user_id: (r.value.delay, r.value.until) for r in read("pause").collect()} == {u: (s["delay"], s["until"]) for u, s in held.items()}
        days = {}
        for r in read("days").collect():
            days[r.key.user_id] = days.get(r.key.user_id, 0) + r.user_map_value.errors
        assert days == {u: s["retries"] for u, s in held.items() if s["retries"]}
    elif name == "cache":
        assert {r.key.user_id: (r.value.hits, r.value.misses) for r in read("counts").collect()} == {u: (s["hits"], s["misses"]) for u, s in held.items()}
    else:
        assert {r.key.user_id: r.value.status for r in read("status").collect()} == {u: s["status"] for u, s in held.items()}
        claims = {}
        for r in read("claims").collect():
            claims[r.key.user_id] = claims.get(r.key.user_id, 0) + 1
        assert claims == {u: s["attempts"] for u, s in held.items() if s["attempts"]}


@pytest.mark.parametrize(("life", "late_hits"), [(3_600_000, 2), (1, 0)])
def test_the_store_forgets_entries_by_processing_time(spark, tmp_path, life, late_hits):
    for i in range(2):  # two files, which are two batches
        spark.createDataFrame([(10 * i, 1, "view"), (10 * i + 1, 1, "click"), (10 * i + 2, 2, "view")][: 3 - i], "event_id long, user_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("event_id long, user_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = folder(spark, "expiring")
    # a stream by processing time has batches without end, so it is stopped once all has been read
    running = processors.expiring(rows, life).writeStream.foreachBatch(lambda df, n: stored.put_batch(df, out, n)).option("checkpointLocation", folder(spark, "state")).outputMode("update").start()
    try:
        got, until = [], time.time() + 90
        while sum(r.hits + r.misses for r in got) < 5 and time.time() < until:
            running.awaitTermination(1)
            got = stored.log(spark, out, "user_id long, hits long, misses long").collect()
    finally:
        running.stop()
    assert sum(r.hits + r.misses for r in got) == 5 and sum(r.hits for r in got) == late_hits
