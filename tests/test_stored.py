"""Merges into stored tables and logs of batches, repeated and stopped in the middle."""

import random

from pyspark.sql import functions as F

from lodeframe.sources import sinks, stored
from lodeframe.streaming import progress

SCHEMA = "k int, j string, title string, seen int"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def plain_merge(table, new, update):
    """As a database would: row by row, the first of equal keys by ``seen``."""
    out, done = {(k, j): (k, j, t, s) for k, j, t, s in table}, set()
    for k, j, t, s in sorted(new, key=lambda r: -r[3]):
        if (k, j) in done:
            continue
        done.add((k, j))
        if (k, j) not in out or update is True:
            out[k, j] = (k, j, t, s)
        elif update:
            out[k, j] = (k, j, t if "title" in update else out[k, j][2], s if "seen" in update else out[k, j][3])
    return sorted(out.values(), key=str)


def test_merges_equal_row_by_row(spark):
    rng = random.Random(3)
    old = [(k, j, "old", k) for k in [*range(30), None] for j in ("a", None)]
    new = [(rng.choice([*range(20, 40), None]), rng.choice(["a", "b", None]), rng.choice(["x", None]), i) for i in range(60)]
    for update in (True, False, ["title"]):
        table = stored.create(spark.createDataFrame(old, SCHEMA), ["k", "j"], parts=8)
        want = plain_merge(old, new, update)
        for _ in range(3):  # a merge that is run again changes nothing
            table.merge(spark.createDataFrame(new, SCHEMA), [F.desc("seen")], update)
            assert rows_of(table.read()) == want


def test_only_touched_partitions_are_rewritten(spark):
    table = stored.create(spark.createDataFrame([(k, "a", "old", 0) for k in range(200)], SCHEMA), ["k", "j"], parts=16)
    files = lambda: {r.f: r.t for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(table.path).selectExpr("path AS f", "modificationTime AS t").collect()}
    before = files()
    parts = table.merge(spark.createDataFrame([(5, "a", "new", 1)], SCHEMA), [F.desc("seen")])
    after = files()
    assert len(parts) == 1 and all(f"_part={parts[0]}/" in f for f in before.keys() ^ after.keys())
    assert table.read().where("title = 'new'").count() == 1 and table.read().count() == 200


def test_a_stopped_merge_is_completed_by_the_next(spark):
    old, new = [(k, "a", "old", 0) for k in range(40)], [(k, "a", "new", 1) for k in range(30, 60)]
    table = stored.create(spark.createDataFrame(old, SCHEMA), ["k", "j"], parts=4)
    some = spark.createDataFrame(new, SCHEMA)
    half = table.touched(some)[0]
    table.merge(some.where(F.pmod(F.xxhash64("k", "j"), F.lit(4)) == half), [F.desc("seen")])  # one partition was put in place
    table.merge(some, [F.desc("seen")])
    assert rows_of(table.read()) == plain_merge(old, new, True)


def test_empty_tables_and_merges(spark):
    none = spark.createDataFrame([], SCHEMA)
    table = stored.create(none, ["k", "j"])
    assert table.read().count() == 0 and table.merge(none, [F.desc("seen")]) == []
    table.merge(spark.createDataFrame([(1, "a", "t", 1)], SCHEMA), [F.desc("seen")])
    assert rows_of(table.read()) == [(1, "a", "t", 1)]


def test_a_batch_that_comes_again_is_not_appended_twice(spark):
    path = sinks.folder(spark, "log")
    first, second = spark.createDataFrame([(1,), (2,)], "v int"), spark.createDataFrame([(3,)], "v int")
    for number, rows in ((0, first), (1, second), (1, second), (0, first)):
        stored.put_batch(rows, path, number)
    assert sorted(r.v for r in stored.log(spark, path, first.schema).collect()) == [1, 2, 3]
    assert stored.log(spark, sinks.folder(spark, "log"), first.schema).count() == 0


def test_a_replayed_stream_batch(spark, tmp_path):
    """The same batch number reaches the sink twice, as after a failure between the write and the commit."""
    spark.range(6).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "'view' AS event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = progress.source(spark, f"{tmp_path}/events.parquet").groupBy("event_type").count()
    out = sinks.folder(spark, "stream")

    def twice(df, n):
        stored.put_batch(df, out, n)
        stored.put_batch(df, out, n)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", sinks.folder(spark, "state")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in stored.log(spark, out, stream.schema).collect()] == [("view", 6)]
