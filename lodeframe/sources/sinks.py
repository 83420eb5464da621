"""Sinks, each with the read that proves it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder in spark.checkpoint.dir, which a cluster's executors share; in local mode, where that may be unset, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="lodeframe-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, tag: str) -> DataFrame:
    """The rows written to the shared folder and read back: they are made once, and a lost executor costs nothing."""
    path = folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def csv_round_trip(rows: DataFrame) -> DataFrame:
    """Written as CSV with RFC-4180 quotes and read back."""
    path = folder(rows.sparkSession, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return rows.sparkSession.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


def numbered(rows: DataFrame, keys: list, order: list, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
