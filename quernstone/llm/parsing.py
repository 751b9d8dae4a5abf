"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quernstone.llm.common import cut

#: Bins of the sketch, 16 bits each.
BINS = 64
#: Levels whose phrase names make the sketch: phrases of about 9 and 27 characters.
LEVELS = (2, 3)
#: The first bins are those of level 1, phrases of about 3 characters, which short texts have enough of; the others are of LEVELS.
SHORT = 8
#: Range buckets of rows for each shuffle partition.
BUCKETS = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ONE = np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _phrases(names: np.ndarray) -> np.ndarray:
    """Names of the phrases of a sequence of names.

    Runs of one name become one symbol. Deterministic coin tossing then replaces each symbol by the place and value of the lowest
    bit in which it differs from its left neighbour, three times over, which leaves labels below 8 that differ from their neighbours'. A
    phrase starts at each local maximum, so where phrases start depends on a few symbols around and never on the offset.
    """
    symbols, unlike = names, names[1:] != names[:-1]
    if not unlike.all():
        new = np.flatnonzero(np.concatenate(([True], unlike)))
        run = _sizes(new, len(names))
        symbols = names[new]
        long = np.flatnonzero(run > 1)
        symbols[long] = _mixed(symbols[long] + run[long].astype(np.uint64) * _A)
    n = len(symbols)
    labels = symbols
    for _ in range(3 if n > 2 else 0):  # labels are below 128 after the first time and take one byte
        one = labels.dtype.type(1)
        differ = labels[1:] ^ labels[:-1]
        low = np.bitwise_count((differ & (~differ + one)) - one)
        tossed = np.empty(n, np.uint8)
        tossed[0] = labels[0] & one
        tossed[1:] = 2 * low + ((labels[1:] >> low.astype(labels.dtype)) & one).astype(np.uint8)
        labels = tossed
    peak = np.zeros(n, bool)
    peak[0] = True
    if n > 2:
        peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    starts = np.flatnonzero(peak)
    sizes = _sizes(starts, n)
    place = np.arange(n) - np.repeat(starts, sizes)
    moved = _PLACES[place] if sizes.max() <= len(_PLACES) else (place.astype(np.uint64) + _ONE) * _A
    return _mixed(np.add.reduceat(_mixed(symbols + moved), starts) + sizes.astype(np.uint64))


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    out[:-1] = starts[1:] - starts[:-1]
    out[-1] = n - starts[-1]
    return out


#: What the first places of a phrase add to a name, and the names of the commonest code points.
_PLACES = (np.arange(64, dtype=np.uint64) + _ONE) * _A
_NAMES = _mixed(np.arange(1 << 14, dtype=np.uint64) + _A)


def _named(codes: np.ndarray) -> np.ndarray:
    return _NAMES[codes] if codes.max(initial=0) < len(_NAMES) else _mixed(codes.astype(np.uint64) + _A)


def sketch(text: str) -> np.ndarray:
    """For each bin the low bits of its least phrase signature; 0 where the bin is empty."""
    out = np.zeros(BINS, np.uint16)
    if not text:
        return out
    levels = [_named(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))]
    while len(levels) <= max(LEVELS):
        levels.append(_phrases(levels[-1]))
    for use, start, count in (((1,), 0, SHORT), (LEVELS, SHORT, BINS - SHORT)):
        found = np.sort(np.concatenate([_mixed(levels[k] + np.uint64(k)) for k in use]))
        bins = start + (((found >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        out[bins[first]] = (found[first] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of phrases that two sketches have in common (Dice), 1 if they are equal."""
    if np.array_equal(a, b):
        return 1.0
    used = int(((a | b) > 0).sum())
    same = int(((a == b) & (a > 0)).sum())
    return 2.0 * same / (used + same)


def _text(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of bucket, falling id and mark; a row is finished when the next one of its bucket is seen. Rows marked extra only follow."""
    last = None
    for x in frames:
        out = []
        for bucket, extra, doc_id, none, text in zip(x["bucket"], x["extra"], x["id"], x["no_id"], x["text"], strict=True):
            mine = sketch(text)
            if last is not None and last[0] == bucket and not last[1]:
                _, _, its_id, its_none, its_text, its = last
                third = len(its_text) // 3
                edited = its_text[: len(its_text) - third] + text[:third]
                e = sketch(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((None if its_none else its_id, len(its_text), sha, _text(its), _text(e), likeness(its, e), likeness(its, mine)))
            last = (bucket, extra, doc_id, none, text, mine)
        frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield frame.astype({"doc_id": "Int64"})


def _bounds(keys: DataFrame, parts: int) -> np.ndarray:
    """The first (id, mark) of each range bucket, in order: falling id, rising mark. keys are 16 bytes a row and are sorted in ranges by Spark."""
    ranged = cut(keys.repartitionByRange(parts, F.desc("id"), F.col("mark")).withColumn("part", F.spark_partition_id()))
    first = ranged.groupBy("part").agg(F.min(F.struct((-F.col("id") - 1).alias("down"), "mark")).alias("x")).select("part", "x.*").orderBy("part")  # one row a bucket
    return np.array([(r["down"], r["mark"]) for r in first.collect()], dtype=[("down", np.int64), ("mark", np.int64)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, its fingerprint, that of its edited text, and their likeness to each other and to the next document's.

    The next document is the one with the next smaller id, for the last one the first; null ids come last, ties are in order
    of a hash of the text. The edited text has its last third replaced by as many characters of the next. Null counts as empty and has a
    fingerprint of zeros. Repeated rows are each a row, and follow each other; rows of one id with different texts are dealt over tasks like others. An empty table gives
    an empty result; further columns are ignored. Each text is shuffled once: rows are cut into ranges, and each range also gets the first row of the
    range that follows (one row for each of a fixed number of ranges).
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(key.alias("id"), F.col(id_col).isNull().alias("no_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("id", "mark"), n * BUCKETS)

    @pandas_udf("bucket int, follows int")
    def place(ids: pd.Series, marks: pd.Series) -> pd.DataFrame:
        """A row's bucket, and the bucket that it follows if it is the first of its own (the first of all follows the last of all); otherwise -1."""
        at = np.empty(len(ids), bounds.dtype)
        at["down"], at["mark"] = -ids.to_numpy() - 1, marks.to_numpy()
        bucket = np.searchsorted(bounds, at, side="right") - 1
        return pd.DataFrame({"bucket": bucket, "follows": np.where(bounds[bucket] == at, (bucket - 1) % len(bounds), -1)})

    placed = rows.withColumn("place", place("id", "mark")).select("id", "no_id", "mark", "text", "place.*")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    head = F.struct(F.col("follows").alias("bucket"), F.lit(True).alias("extra"))
    spots = F.when(F.col("follows") >= 0, F.array(own, head)).otherwise(F.array(own))
    both = placed.withColumn("spot", F.explode(spots)).select("id", "no_id", "mark", "text", "spot.*")
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc("id"), "mark")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(_walk, schema).withColumnRenamed("doc_id", id_col)
