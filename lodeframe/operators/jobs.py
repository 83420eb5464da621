"""Keyed merges, caps and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in a total order (DISTINCT ON)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def cap_per_group(rows: DataFrame, keys: list, order: list, most: int, exempt: Column | None = None) -> DataFrame:
    """At most ``most`` rows of each group; exempt rows neither count nor go."""
    free = F.lit(False) if exempt is None else exempt
    ranked = rows.withColumn("_free", free).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_free").orderBy(*order)))
    return ranked.where(F.col("_free") | (F.col("_rank") <= most)).drop("_free", "_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list, update: bool = True) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key (or only add keys, without ``update``); of several
    new rows for a key the first in ``order`` counts."""
    fresh = first_per_key(new, keys, order)
    if update:
        return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"))


def violations(rows: DataFrame, keys: list, where: Column | None = None) -> DataFrame:
    """Keys that a unique constraint would refuse."""
    kept = rows if where is None else rows.where(where)
    return kept.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
