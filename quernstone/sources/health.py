"""Hosts that don't answer: which to skip for a while."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values. Failures in a row until a host is skipped, for how long, and when it is forgotten.
FAILURES, HOURS, FORGET_DAYS = 2, 6, 30


def host_health(attempts: DataFrame, host: str, at: str, failed: str, now: datetime) -> DataFrame:
    """host, failures (since the last answer), last_failure, skip; hosts not seen for FORGET_DAYS are gone.

    Attempts are read once and counted by host and moment; the last answer of a host is told over those counts.
    """
    stamp = F.lit(now).cast("timestamp")
    seen = attempts.where(F.col(at) <= stamp).select(F.col(host).alias("host"), F.col(at).alias("at"), F.coalesce(F.col(failed), F.lit(False)).alias("failed"))
    by_moment = seen.groupBy("host", "at").agg(F.count_if("failed").alias("failures"), F.bool_or(~F.col("failed")).alias("answered"))
    answered = F.max(F.when(F.col("answered"), F.col("at"))).over(Window.partitionBy("host"))
    broken = by_moment.withColumn("last_answer", answered).where("failures > 0 and (last_answer is null or at > last_answer)")
    state = broken.groupBy("host").agg(F.sum("failures").alias("failures"), F.max("at").alias("last_failure"))
    skip = (F.col("failures") >= FAILURES) & (F.col("last_failure") >= stamp - F.expr(f"interval {HOURS} hours"))
    return state.where(F.col("last_failure") >= stamp - F.expr(f"interval {FORGET_DAYS} days")).withColumn("skip", skip)


def merged_health(known: DataFrame, fresh: DataFrame, now: datetime) -> DataFrame:
    """The health table (host, failures, last_failure, last_success) after a run: hosts of fresh replace known ones; those not seen for FORGET_DAYS go."""
    rows = known.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
    latest = rows.groupBy("host").agg(F.max_by(F.struct("failures", "last_failure", "last_success"), "turn").alias("x")).select("host", "x.*")
    limit = F.lit(now).cast("timestamp") - F.expr(f"interval {FORGET_DAYS} days")
    return latest.where((F.trim("host") != "") & (F.coalesce("last_failure", "last_success") > limit))


def reachable(urls: DataFrame, url: str, health: DataFrame) -> DataFrame:
    """urls without those of hosts that are to be skipped. health: host, skip."""
    unwell = health.where("skip").select(F.lower("host").alias("_host")).distinct()
    full = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return urls.join(unwell, full == F.col("_host"), "left_anti")
