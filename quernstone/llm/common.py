"""Helpers that several text operators share: checkpoints, skew-safe lookups, ASCII folding."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most keys that are ever broadcast as "hot": a key is hot if it holds more than rows / HOT_KEYS rows.
HOT_KEYS = 20_000

#: Slim rows that one task and one file of a round can well hold.
ROWS_A_PART = 50_000

#: Bits of the bitmap of rows that may have to go.
WIDTH = 1 << 26

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, which the driver and all executors share; an error if it names none."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def fresh(df: DataFrame, *names: str) -> str | list[str]:
    """Names for columns to be made for a while, like the given ones but unlike those of df in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        made = f"_{name}"
        while made.lower() in taken:
            made += "_"
        taken.add(made.lower())
        out.append(made)
    return out if len(out) > 1 else out[0]


def quoted(df: DataFrame) -> list[str]:
    """The columns of df, also those with dots in their names."""
    return [f"`{c}`" for c in df.columns]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of about that many slim rows, in no more partitions than they need: rounds over few rows else write as many small files as a shuffle has partitions, each time."""
    return df.coalesce(max(1, -(-rows // ROWS_A_PART)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with groups (one row per key) that no hot key can skew.

    groups has the number of rows of its key in column `size`. At most HOT_KEYS keys can hold more than
    total / HOT_KEYS rows each; those are broadcast. The rest meet in a shuffle whose largest key is that small.
    Both inputs are read twice, so pass checkpointed or cheap ones. Keys must not be null. Where there are no more rows than one task can well hold, all
    groups are broadcast: late rounds then take one job each.
    """
    if total <= ROWS_A_PART:
        return rows.join(F.broadcast(groups), keys, "left")
    at = total // HOT_KEYS
    hot = groups.where(F.col(size) > at)
    named = dict(zip(keys, fresh(rows.join(groups.limit(0), keys, "left"), *keys, "key"), strict=False))
    cold = groups.where(F.col(size) <= at).withColumnsRenamed(named)
    few = F.broadcast(hot)
    on_hot = rows.join(few, keys, "inner")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    match = [F.col(k) == F.col(named[k]) for k in keys]
    on_cold = others.join(cold, match, "left").drop(*named.values())
    return on_hot.unionByName(on_cold)


def _bitmap(keys: DataFrame) -> DataFrame:
    """bucket, bits: a bitmap of WIDTH bits (8 MB at most) in which the hashes of rows are set."""
    at = keys.select((F.pmod(F.xxhash64(*quoted(keys)), F.lit(WIDTH)) + 1).alias("at"))
    return cut(at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))


def _looked_up(rows: DataFrame, keys: list[str], bitmap: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`: whether the bit of their keys is set in the bitmap, which is broadcast."""
    bucket, bits, at = fresh(rows, "bucket", "bits", "at")
    placed = rows.withColumn(at, F.pmod(F.xxhash64(*keys), F.lit(WIDTH)) + 1).withColumn(bucket, F.bitmap_bucket_number(at))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    found = placed.join(F.broadcast(bitmap.withColumnsRenamed({"bucket": bucket, "bits": bits})), bucket, "left")
    return found.withColumn(name, is_set).drop(bucket, bits, at)


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys (one column of that name); only rows that can be are shuffled, by a bitmap of hashed keys."""
    maybe = fresh(rows, "maybe")
    able = _looked_up(rows, [key], _bitmap(keys), maybe).where(maybe).drop(maybe)
    return able.join(keys, key, "left_semi")


def without(docs: DataFrame, gone: DataFrame, again: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs without the rows whose keys gone has, and with one row for each of the keys that again has; all columns stay.

    keys are expressions over docs, named like the columns of gone and again; nulls are equal. Only rows that can be meant are shuffled: those whose
    hashed keys are set in a bitmap. Of rows with the same keys the one of least hash stays.
    """
    gone, again = gone.select(*keys), again.select(*keys)
    names = fresh(docs, *keys, *[f"other_{k}" for k in keys], "maybe", "row")
    made, other, (maybe, row) = dict(zip(keys, names, strict=False)), dict(zip(keys, names[len(keys) :], strict=False)), names[-2:]
    keyed = docs.withColumns({made[k]: c for k, c in keys.items()})
    looked = _looked_up(keyed, list(made.values()), _bitmap(gone.unionByName(again)), maybe)
    stay = looked.where(~F.col(maybe)).select(*quoted(docs))
    match = [F.col(made[k]).eqNullSafe(F.col(other[k])) for k in keys]
    left = looked.where(maybe).join(gone.withColumnsRenamed(other), match, "left_anti")
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = left.groupBy(*made.values()).agg(F.min_by(F.struct(*quoted(docs)), F.xxhash64(*plain)).alias(row))
    return stay.unionByName(one.select(f"{row}.*"))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions that run within get so many rows at once, so that long texts take less memory; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns memory that is free within a Python worker to the machine, so that workers that wait for their next task hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def about(rows: DataFrame, key: Column, bound: int, count: int) -> DataFrame:
    """A deterministic sample of about `bound` of `count` rows, by a hash of key; all rows if there are fewer."""
    if count <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * bound / count))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column `name` (1, 2, ... in the given order): sorted in ranges, with the rows of the ranges before counted.

    Give an order without ties, so that no range holds a third of all rows. The counts of the ranges (one row for each shuffle partition) are broadcast.
    """
    part, inside, before = fresh(df, "part", "inside", "before")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(part).agg(F.count("*").alias(inside)).select(part, F.coalesce(F.sum(inside).over(earlier), F.lit(0)).alias(before))
    row = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return parts.join(F.broadcast(counts), part).withColumn(name, (row + F.col(before)).cast("long")).drop(part, before)
