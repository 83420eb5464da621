"""Tables that are changed where they are stored: keyed merges and logs, both safe to repeat.

A stored table is Parquet in a folder that the cluster shares, in ``parts`` partitions by a hash of its keys. A merge reads and rewrites only the
partitions that its rows fall into; the new contents are staged beside the table first, so nothing is overwritten while it is read, and
then put in place with a dynamic partition overwrite. A merge that was stopped in the middle leaves each partition old or new, and
running it again ends in the same table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import first_per_key
from .sinks import folder, kept

PART, BATCH = "_part", "_batch"


@dataclass(frozen=True)
class Stored:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: object
    parts: int

    def read(self) -> DataFrame:
        return self._all().drop(PART)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def _put(self, rows: DataFrame) -> None:
        rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def touched(self, rows: DataFrame) -> list[int]:
        """The partitions that the rows fall into; at most ``parts`` numbers."""
        return sorted(r[0] for r in self._dealt(rows).select(PART).distinct().collect())

    def merge(self, new: DataFrame, order: list, update: bool | Sequence[str] = True) -> list[int]:
        """Rows of ``new`` go in under their keys; of several with the same keys the first in ``order`` counts. Returns the partitions rewritten.

        Where a key is there, ``update`` says what is set: all columns (True), those named, or none (False: such rows do nothing). Null keys are
        equal to each other. Columns are those of the table.
        """
        columns = [f.name for f in self.schema if f.name != PART]
        fresh = kept(self._dealt(first_per_key(new.select(*columns), list(self.keys), order)), "merge")
        parts = sorted(r[0] for r in fresh.select(PART).distinct().collect())
        if not parts:
            return parts
        old = self._all().where(F.col(PART).isin(parts)).withColumn("_old", F.lit(True))
        given = fresh.select(F.col(PART).alias("n" + PART), F.lit(True).alias("_new"), *[F.col(c).alias(f"n_{c}") for c in columns])
        both = old.join(given, [F.col(PART) == F.col("n" + PART), *[F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in self.keys]], "full")
        sets = set(columns if update is True else update or ())
        pick = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in sets)), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
        staged = kept(both.select(*[pick(c) for c in columns], F.coalesce(PART, "n" + PART).alias(PART)), "staged")
        self._put(staged)
        return parts


def create(rows: DataFrame, keys: Sequence[str], parts: int = 64, path: str | None = None) -> Stored:
    """A new table with the rows, whose keys are unique."""
    spark, at = rows.sparkSession, path or folder(rows.sparkSession, "table")
    made = Stored(spark, at, tuple(keys), None, parts)
    dealt = made._dealt(rows)
    made = Stored(spark, at, tuple(keys), dealt.schema, parts)
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(at)  # an empty table can be read too
    made._put(dealt)
    return made


def put_batch(rows: DataFrame, path: str, number: int) -> None:
    """Appends a batch to a log; a batch that comes again takes its own place, so a retry appends nothing twice."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches; no batch, no rows."""
    put_batch(spark.createDataFrame([], schema), path, -1)
    return spark.read.schema(schema).option("basePath", path).parquet(path).drop(BATCH)
