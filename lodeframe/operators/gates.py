"""The gates that the snapshots of a test cycle have to pass before its report counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is said of a gate that isn't passed.
REASONS = {
    1: "expected four accepted snapshots, found ",
    2: "one or more snapshots are not terminal-success and accepted",
    3: "one or more snapshots are partial",
    4: "mixed deployment fingerprints were detected",
    5: "duplicate run keys were detected",
    6: "one or more snapshots lack complete result rows",
    7: "one or more report inputs lack a run key",
}
# States of a run that has ended well.
ENDED = ("accepted", "terminal_success")


def checks(snapshots: DataFrame, expected: int, companies: int, count: bool = False) -> DataFrame:
    """cycle, average of the snapshots' scores, g1 to g7, passed, and with ``count`` the number of snapshots (n).

    ``snapshots``: cycle, run_key, state, acceptance, complete (it covers the companies expected), same (its fingerprint is the deployment's), lines (its
    result rows; null: none), score. 1: as many as expected; 2: ended and accepted; 3: complete; 4: one fingerprint; 5: run keys are unique (a missing one is
    a blank one); 6: a result row for each company; 7: every run key is there.
    """
    key = F.coalesce("run_key", F.lit(""))
    fails = lambda c: ~F.coalesce(F.bool_or(F.coalesce(~c, F.lit(True))), F.lit(True))
    got = snapshots.groupBy("cycle").agg(
        F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("average"), F.count("*").alias("n"), (F.count("*") == expected).alias("g1"), fails(F.col("state").isin(*ENDED) & (F.col("acceptance") == "accepted")).alias("g2"),
        fails(F.col("complete")).alias("g3"), fails(F.col("same")).alias("g4"), (F.countDistinct(key) == F.count("*")).alias("g5"), fails(F.coalesce("lines", F.lit(0)) == companies).alias("g6"), fails(key != "").alias("g7"),
    )
    return (got if count else got.drop("n")).withColumn("passed", F.expr(" AND ".join(f"g{i}" for i in range(1, 8))))


def reasons(checked: DataFrame) -> DataFrame:
    """cycle, gate, reason of each gate that isn't passed; ``checked`` has n."""
    items = F.array(*[F.struct(F.lit(i).alias("gate"), (F.concat(F.lit(text), F.col("n")) if i == 1 else F.lit(text)).alias("reason"), F.col(f"g{i}").alias("ok")) for i, text in REASONS.items()])
    return checked.select("cycle", F.inline(items)).where("NOT ok").drop("ok")
