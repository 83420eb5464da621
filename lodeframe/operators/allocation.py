"""Budgets spent in rank order, for groups of any size.

Sums over all earlier rows of a group are made without one window over the group: rows are dealt by ranges of (group, order), each
range is summed, and the sums of a group's ranges are added up; a row's sum is that of the ranges before its own and of the rows
before it inside. A group as large as a third of all rows is so many ranges.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import kept, numbered


def running(rows: DataFrame, keys: list[str], order: list, sums: Mapping[str, Column]) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of its column over the rows of the same keys that come earlier in ``order``.

    ``order`` is total within a group. Null keys are a group of their own. The rows are written once.
    """
    order = [c if isinstance(c, Column) else F.col(c) for c in order]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(count, *keys, *order).withColumn("_block", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(*keys, "_block").agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_at"), *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_sum_{n}") for n in sums])
    same = [F.col("_block") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]]
    inside = dealt.withColumns({n: F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in sums})
    return inside.join(blocks, same).select(*rows.columns, *[(F.col(n) + F.col(f"_sum_{n}")).alias(n) for n in sums])


def places(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """``rows`` with their number in the group, from 0."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")})


def fitting(rows: DataFrame, keys: list[str], order: list, size: str, room: str) -> DataFrame:
    """The rows that a budget takes: in ``order`` each row goes in if it still fits, and is left out if not.

    ``room`` is the budget, the same for all rows of a group; sizes are over 0. All rows before a group's first misfit are taken.
    After it less is left than that row's size; of each size at most (what is left / the size) rows can be taken, the first ones in order, so
    a fold over those alone ends the group. The fold's rows are bounded by what is left, not by the group.
    """
    summed = kept(running(rows, keys, order, {"_before": F.col(size).cast("long")}), "sums")
    ends = summed.where(F.col("_before") + F.col(size) > F.col(room)).groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min("_before").alias("_cut"))
    joined = summed.join(ends, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], "left").select(*summed.columns, "_cut")
    first = joined.where(F.col("_cut").isNull() | (F.col("_before") < F.col("_cut"))).select(*rows.columns)
    late = joined.where((F.col("_before") > F.col("_cut")) & (F.col(size) <= F.col(room) - F.col("_cut"))).withColumn("_left", F.col(room) - F.col("_cut"))
    most = F.floor(F.col("_left") / F.col(size))
    late = late.withColumn("_part", F.floor(F.col("_before") / (16 * F.greatest(F.col("_left"), F.lit(1)))))  # so that equal sizes of a large group aren't one window
    late = numbered(late, [*keys, size, "_part"], ["_before"], "_own").where(F.col("_own") <= most)
    late = numbered(late, [*keys, size], ["_before"], "_own").where(F.col("_own") <= most).drop("_part", "_own")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_before")
        left, take = int(pdf["_left"].iloc[0]), []
        for s in pdf[size].tolist():
            take.append(s <= left)
            left -= s if take[-1] else 0
        return pdf[take]

    return first.unionByName(late.groupBy(*keys).applyInPandas(fold, late.schema).select(*rows.columns))
