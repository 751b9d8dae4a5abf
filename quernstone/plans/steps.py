"""Steps of iterative plans."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that a side of a join has at most, as measured in its shuffle, to be broadcast.
MOST_BROADCAST = 4 << 20


@contextmanager
def by_measure(spark: SparkSession) -> Iterator[None]:
    """Joins planned within broadcast a side only if it was measured to be small; the session's own settings come back after.

    Sizes of settled tables are estimated from the files that they came from, however much has been made of those since. The driver builds what is broadcast, so it would hold tables
    that grow with the input.
    """
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in (guessed, measured)}
    spark.conf.set(guessed, "-1")
    spark.conf.set(measured, str(MOST_BROADCAST))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that plans stay short and lost executors cost little. Its joins are planned by_measure."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    with by_measure(df.sparkSession):
        return df.checkpoint(eager=True)


#: Most keys that are broadcast as hot ones: a key is hot if it has more than total / HOT_KEYS rows.
HOT_KEYS = 20_000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups (one slim row for each key) so that no hot key meets in one task.

    groups has the number of rows of its key in column `size`. Keys of more than a 20,000th of all these rows, of which there are 20,000 at most, are broadcast; the others meet in
    a shuffle. Both inputs are read twice, so pass settled ones. Keys must not be null. how is inner or left.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total // HOT_KEYS)
    cold = groups.where(F.col(size) <= total // HOT_KEYS)
    on_hot = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return on_hot.unionByName(others.join(cold, keys, how))
