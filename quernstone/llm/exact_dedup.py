"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import ascii_lower, attach, cut, without

#: A refinement step sees keys by hashes of so many values, so what it broadcasts is bounded; a row goes on if another has its hash.
GATE_HASHES = 1 << 20
PREFIX_CHARS = 64


def _gate(rows: DataFrame, keys: list[str], live: str) -> DataFrame:
    """rows with _live, whether another live row shares the hash of keys."""
    hashed = F.pmod(F.xxhash64(*keys), F.lit(GATE_HASHES)).cast("int")
    shared = cut(rows.where(live).groupBy(hashed.alias("_hash")).agg(F.count("*").alias("n")).where("n > 1").select("_hash", F.lit(True).alias("_shared")))
    found = rows.withColumn("_hash", hashed).join(F.broadcast(shared), "_hash", "left")
    return found.withColumn("_live", F.col(live) & F.coalesce("_shared", F.lit(False))).drop("_hash", "_shared")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept and sha256 of the normalised text.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    id stays. Lengths (bytes) are compared first, then a hash of the first characters; only rows that share both
    with another row have their whole text hashed (all rows if digest is set, as the caller then wants the hash).
    sha256 is null where it was not needed. Repeated rows with one id are one document each time: all of them
    are kept if the id is the largest. A null id is kept only in a group without other ids. An empty table gives
    an empty result. Further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.octet_length(text).alias("_len"))
    rows = _gate(base.withColumn("_live", F.lit(True)), ["_len"], "_live")
    rows = rows.withColumn("_pre", F.when(F.col("_live"), F.xxhash64(ascii_lower(F.substring("_t", 1, PREFIX_CHARS)))))
    rows = _gate(rows, ["_len", "_pre"], "_live")
    full = F.unhex(F.sha2(ascii_lower(F.col("_t")), 256))
    rows = cut(rows.select("_id", "_len", "_live", (full if digest else F.when(F.col("_live"), full)).alias("_sha")))

    alive = rows.where("_live").drop("_live")
    groups = cut(alive.groupBy("_len", "_sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    found = attach(alive, groups, ["_len", "_sha"], "group_size", rows.count())
    alone = rows.where("not _live").select("_id", "_sha", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    every = found.select("_id", "_sha", "keep_id", "group_size").unionByName(alone.withColumn("keep_id", F.col("_id")))
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("keep_id"))
    return every.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts (see exact_dedup), the one of the largest id; all columns stay, whatever their names.

    A row is known by its id and its text, so a null or repeated id never takes other texts along; a null id stays only in a group without
    other ids. Of rows with one id and equal texts one stays. Null and empty texts are equal. An empty table gives an empty result.
    """
    found = exact_dedup(docs, id_col, text_col).where("group_size > 1").select(F.col(id_col).alias("key_id"), F.unhex("sha256").alias("key_text"), "kept")
    gone = found.where("not kept").select("key_id", "key_text").distinct()
    again = found.where("kept").groupBy("key_id", "key_text").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    return without(docs, gone, again, {"key_id": F.col(id_col), "key_text": sha})
