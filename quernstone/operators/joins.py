"""Joins that data integration needs: containing intervals, near moments, parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_interval(parts: DataFrame, hosts: DataFrame, keys: list[str], at: Column, start: Column, end: Column) -> DataFrame:
    """parts with the hosts of the same keys whose interval holds them; a shuffle on the keys, no product."""
    return parts.join(hosts, keys).where(at.between(start, end))


def near_pairs(rows: DataFrame, keys: list[str], id_col: str, at: str, seconds: int) -> DataFrame:
    """left_id, right_id, apart: pairs of rows with the same keys that are at most so many seconds apart, each once.

    Time is cut into slots of that length. A row meets rows of its own slot and of the next one, so the work follows the number of
    pairs that are near and not the square of a key's rows.
    """
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000))
    base = rows.where(F.col(at).isNotNull()).select(*keys, F.col(id_col).alias("id"), F.col(at).alias("at"), slot.alias("slot"))
    left = base.withColumnsRenamed({"id": "left_id", "at": "left_at"}).withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1))).withColumnRenamed("slot", "_slot")
    own = F.floor(F.unix_micros(F.col("left_at").cast("timestamp")) / F.lit(seconds * 1_000_000))
    right = base.withColumnsRenamed({"id": "right_id", "at": "right_at", "slot": "_slot"})
    apart = F.abs(F.unix_micros(F.col("left_at").cast("timestamp")) - F.unix_micros(F.col("right_at").cast("timestamp")))
    once = F.when(own == F.col("_slot"), F.col("left_id") < F.col("right_id")).otherwise(F.lit(True))
    return left.join(right, [*keys, "_slot"]).where((apart <= seconds * 1_000_000) & once).select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), (apart / 1_000_000).alias("apart")
    )
