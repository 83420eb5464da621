"""Scores far from those of their peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_PEERS, LEAST_SCALE, LIMIT = 8, 10.0, 2.5


def robust_anomalies(rows: DataFrame, key: str, score: str, sector: str, country: str) -> DataFrame:
    """Median and scaled MAD of the (sector, country) group, of the sector where the group is under LEAST_PEERS, else
    none: key, score, expected, residual, peers, z, flagged. Peers include the row itself."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("Unknown")))
    rows = rows.select(F.col(key), F.col(score).alias("score"), low(sector).alias("s"), low(country).alias("c"))

    def stats(keys: list[str], tag: str) -> DataFrame:
        med = rows.groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("m"), F.count("*").alias(f"n_{tag}"))
        return rows.join(med, keys).groupBy(*keys, "m", f"n_{tag}").agg(F.percentile(F.abs(F.col("score") - F.col("m")), F.lit(0.5)).alias(f"mad_{tag}")).withColumnRenamed("m", f"med_{tag}")

    both = rows.join(stats(["s", "c"], "g"), ["s", "c"]).join(stats(["s"], "s"), ["s"])
    own = F.col("n_g") >= LEAST_PEERS
    pick = lambda x: F.when(own, F.col(f"{x}_g")).when(F.col("n_s") >= LEAST_PEERS, F.col(f"{x}_s"))
    both = both.withColumns({"expected": pick("med"), "mad": pick("mad"), "peers": pick("n")})
    residual = F.col("score") - F.col("expected")
    z = F.abs(residual) / (1.4826 * F.greatest(F.col("mad"), F.lit(LEAST_SCALE)))
    return both.select(key, "score", F.round("expected", 6).alias("expected"), F.round(residual, 6).alias("residual"), "peers", F.round(z, 6).alias("z"), (z > LIMIT).alias("flagged"))
