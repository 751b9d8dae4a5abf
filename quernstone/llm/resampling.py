"""Importance resampling towards a target: hashed word runs, gains of their buckets, and the best scores under random perturbation."""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quernstone.llm.common import cut, fresh, quoted, ranked

#: Words of the longest run.
RUN = 1
BUCKETS = 10_000
#: Of documents with at least so many words, so many in a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
#: Accuracy of the quantile that keeps surely undrawn rows out of the sort.
FINE = 10_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SCANNED = StructType([StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("buckets", BinaryType())])


def scan(text: str, run: int = RUN, buckets: int = BUCKETS) -> tuple[int, array]:
    """Number of words of a text, and the bucket of each run of 1 to `run` words, repeats included.

    One pass: the ring holds the running CRC of the runs that began at the last words; each word extends them by a space and itself and begins one of its own.
    """
    out, words = array("I"), 0
    found = _WORD.finditer(text.encode().lower())  # bytes: only A-Z change, and what is no ASCII is part of a word
    if run == 1:
        out.extend([crc32(m[0]) % buckets for m in found] if len(text) < 1 << 20 else (crc32(m[0]) % buckets for m in found))
        return len(out), out
    ring: deque[int] = deque(maxlen=run)
    for match in found:
        word = match[0]
        further = b" " + word
        words += 1
        states = [crc32(further, state) for state in ring]
        if len(states) == run:
            del states[0]  # it has `run` words already
        ring = deque([*states, crc32(word)], maxlen=run)
        out.extend([state % buckets for state in ring])
    return words, out


def features(docs: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words, n_features and buckets (of each feature, as little-endian unsigned 32-bit integers).

    Null and empty texts have none. Very long texts are scanned word by word. Columns of these names are replaced, all others stay.
    """

    @pandas_udf(_SCANNED)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [scan(t or "", run, buckets) for t in texts]
            yield pd.DataFrame({"n_words": [w for w, _ in found], "n_features": [len(b) for _, b in found], "buckets": [np.asarray(b, dtype="<u4").tobytes() for _, b in found]})

    made = fresh(docs, "scanned")
    return docs.withColumn(made, scanned(F.col(text_col))).withColumns({c: F.col(f"{made}.{c}") for c in _SCANNED.names}).drop(made)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket: each task counts its own, so a task sends one row for a bucket at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for found in batch["buckets"]:
                total += np.bincount(np.frombuffer(found, dtype="<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    sums = rows.select("buckets").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the thousandfold logarithm of how much likelier it is in the target (counts plus one), rounded down."""
    b, all_raw, all_target = len(raw), int(raw.sum()), int(target.sum())
    return np.array([floor(1000 * log(float((t + 1) * (all_raw + b)) / float((s + 1) * (all_target + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _noise(id_col: Column, seed: str) -> Column:
    """A Gumbel draw by a hash of the id, times 1000, rounded down. A null id is hashed as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    run: int = RUN,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    keep_text: bool = True,
) -> DataFrame:
    """docs with n_features, weight (sum of its features' gains), score (weight and a random draw) and rank (1, 2, ... of the drawn ones, else null).

    Each text is scanned once; what follows works on its buckets. Drawn are `percent` in a hundred of the rows of at least `least_words` words, those of highest score, ties to the smaller id.
    Null and empty texts have no features and a weight of 0. A null id is one id, after all others on ties. Repeated rows are each a row and get ranks
    of their own. An empty docs gives an empty result, an empty target counts as no features. Very long texts are scanned whole. Columns named like the new ones are replaced, all others
    stay; without keep_text the text is left out, so that no text is written or sorted. To the driver goes one count for each bucket (`buckets`) and for each task of the sort.
    """
    words, bag, order = fresh(docs, "words", "bag", "order")
    kept = [c for c in docs.columns if c not in ("n_features", "weight", "score", "rank") and (keep_text or c != text_col)]
    seen = features(docs, text_col, run, buckets)
    rows = cut(seen.select(*[f"`{c}`" for c in kept], F.col("n_words").alias(words), F.col("n_features").alias("n_features"), F.col("buckets").alias(bag)))
    gain = gains(bucket_counts(rows.select(F.col(bag).alias("buckets")), buckets), bucket_counts(features(target.select(F.col(target_col).alias("text")), "text", run, buckets), buckets))

    @pandas_udf(LongType())
    def weigh(bags: pd.Series) -> pd.Series:
        return pd.Series([int(gain[np.frombuffer(b, dtype="<u4")].sum()) for b in bags], dtype="int64")

    weighed = rows.withColumn("weight", weigh(bag)).drop(bag)
    scored = cut(weighed.withColumn("score", F.col("weight") + _noise(F.col(id_col), seed)).withColumn(order, F.monotonically_increasing_id()))
    able = F.col(words) >= least_words
    share = max(0.0, 1 - percent / 100 - 2 / FINE)
    found = scored.where(able).agg(F.count("*").alias("n"), F.percentile_approx("score", share, FINE).alias("at")).first()
    draw, at = percent * found["n"] // 100, found["at"] or 0
    if scored.where(able & (F.col("score") >= at)).count() < draw:
        at = -(1 << 63)
    high = able & (F.col("score") >= at)
    best = ranked(scored.where(high), [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(order)], "rank")
    best = best.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(rest).select(*[f"`{c}`" for c in kept], "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that the resampling draws; all columns of docs stay but those named like the new ones. Options and odd rows are as in resample."""
    out = resample(docs, target, **options)
    names = [c for c in quoted(docs) if c.strip("`") not in ("n_features", "weight", "score", "rank") and c.strip("`") in out.columns]
    return out.where(F.col("rank").isNotNull()).select(*names)
