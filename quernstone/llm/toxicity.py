"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quernstone.llm.common import crc_mod, cut, fresh, give_back
from quernstone.llm.simhash import RADIUS, _forest, fingerprint_udf

#: About so many labelled rows are learned from, and of those about so many bytes of text; chosen by a hash of their ids.
MAX_EXAMPLES, MAX_BYTES = 6_000, 32 << 20
NEIGHBOURS = 11
#: Weight of the base rate beside the votes of the neighbours.
PRIOR_WEIGHT = 0.25
THRESHOLD = 0.3
#: Examples of a block, and the share of examples from which a term's list is long: long lists are bounded by block before they are read.
BLOCK, LONG = 64, 1 / 16
_TOKEN = re.compile(r"[^\W_]+")
#: Blocks that are read before the bound is known.
FIRST = 4
_SLACK = 1e-4


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text, as hashes in rising order, and how often each occurs."""
    counts = Counter(_TOKEN.findall(text.lower())) if text else {}
    names = np.fromiter((xxhash.xxh64_intdigest(t) for t in counts), np.uint64, len(counts))
    order = np.argsort(names)
    return names[order], np.fromiter(counts.values(), np.float64, len(counts))[order]


def term_weights(df: np.ndarray, toxic: np.ndarray, n: int, rate: float) -> np.ndarray:
    """Inverse document frequency times how surely a term tells the labels apart.

    The factor is 1 plus the chi-squared (with continuity correction) of the term's toxic examples against the base rate, so a word that only toxic
    examples have outweighs a text's many words that happen to be rare, and no term is without weight.
    """
    spread = df * max(rate * (1 - rate), 1e-12)
    off = np.maximum(np.abs(toxic - df * rate) - 0.5, 0)
    return np.log1p(n / df) * (1 + off * off / spread)


class BlockMaxIndex:
    """An inverted index of examples: for each term the examples that have it with their weights, and for long lists the largest weight in each block.

    An example's vector has sqrt(count) * weight of term for each of its terms, divided by its length; weights are kept as 32-bit numbers, which are the vectors that
    count. Examples with the same strongest term stand together, so that blocks are alike.
    """

    def __init__(self, ids: list[int], labels: list[int], terms: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK, long: float = LONG):
        n, self.block = len(ids), block
        label = np.array(labels, np.float64)
        self.base_rate = float(label.mean()) if n else 0.0
        sizes = np.array([len(t[0]) for t in terms], np.int64)
        names = np.concatenate([t[0] for t in terms]) if n else np.zeros(0, np.uint64)
        self.names, at = np.unique(names, return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        df = np.bincount(at, minlength=len(self.names)).astype(np.float64)
        toxic = np.bincount(at, weights=label[row] if n else None, minlength=len(self.names))
        self.weight = term_weights(df, toxic, n, self.base_rate)
        self.unknown = float(np.log1p(n)) if n else 1.0
        raw = np.sqrt(np.concatenate([t[1] for t in terms])) * self.weight[at] if n else np.zeros(0)
        value = (raw / np.sqrt(np.bincount(row, weights=raw * raw, minlength=n))[row]).astype(np.float32) if n else raw.astype(np.float32)
        strongest = np.zeros(n, np.int64)
        order = np.lexsort((value, row))
        last = np.flatnonzero(np.r_[row[order][1:] != row[order][:-1], True]) if n and len(row) else np.zeros(0, np.int64)
        strongest[row[order][last]] = at[order][last]
        rank = np.lexsort((np.arange(n), strongest))
        self.ids, self.labels = np.array(ids, np.int64)[rank], label[rank]
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        row = place[row]

        order = np.lexsort((row, at))
        self.rows, self.values = row[order].astype(np.int32), value[order]
        self.starts = np.r_[0, np.cumsum(df).astype(np.int64)]
        self.long_of = np.full(len(self.names), -1, np.int32)  # the place of a long list among the long ones
        lengthy = np.flatnonzero(df > max(block, n * long))
        self.long_of[lengthy] = np.arange(len(lengthy))
        self.blocks = -(-n // block)
        self.long = np.zeros((len(lengthy), self.blocks, block), np.float32)
        for i, t in enumerate(lengthy):
            a, b = self.starts[t], self.starts[t + 1]
            self.long[i].reshape(-1)[self.rows[a:b]] = self.values[a:b]
        self.most = self.long.max(axis=2) if n else self.long[:, :, 0]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's terms that examples have, and their weights in its vector, whose length counts all of its terms."""
        if not len(self.names) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        known = self.names[at] == terms
        raw = np.sqrt(counts) * np.where(known, self.weight[at], self.unknown)
        return at[known], raw[known] / np.sqrt(raw @ raw)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest cosine above zero, exactly, as (cosine, place); of equal ones the first.

        Short lists are added up whole. What long lists can add is bounded by their largest weights in each block, and they are read only in blocks whose
        bound reaches the k-th best cosine found so far.
        """
        at, weight = self.vector(terms, counts)
        if not len(at):
            return []
        is_long = self.long_of[at] >= 0
        lists, asked = self.long_of[at[is_long]], weight[is_long].astype(np.float32)
        short, theirs = at[~is_long], weight[~is_long]
        sizes = self.starts[short + 1] - self.starts[short]
        spots = np.repeat(self.starts[short] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        score = np.bincount(self.rows[spots], weights=np.repeat(theirs, sizes) * self.values[spots], minlength=self.blocks * self.block).reshape(-1, self.block)
        bound = score.max(axis=1) + asked @ self.most[lists]

        def quick(blocks: np.ndarray) -> np.ndarray:
            held = self.long[lists[:, None], blocks].reshape(len(lists), len(blocks) * self.block)
            return score[blocks].reshape(-1) + asked @ held

        by_bound = np.argsort(-bound)
        first = by_bound[:FIRST]
        found = quick(first)
        least = self._kth(found, k)
        more = by_bound[FIRST:][bound[by_bound[FIRST:]] >= least - _SLACK]
        able = np.r_[first, more]
        found = np.r_[found, quick(more)] if len(more) else found
        place = (able[:, None] * self.block + np.arange(self.block)).reshape(-1)
        place = place[found >= max(self._kth(found, k) - _SLACK, 1e-12)]  # a close look at the few that the quick sums leave
        exact = score.reshape(-1)[place] + weight[is_long] @ self.long.reshape(len(self.long), self.blocks * self.block)[lists[:, None], place].astype(np.float64)
        best = sorted((-round(x, 10), i) for x, i in zip(exact.tolist(), place.tolist(), strict=True) if x > 1e-12)[:k]
        return [(-x, i) for x, i in best]

    @staticmethod
    def _kth(found: np.ndarray, k: int) -> float:
        return float(np.partition(found, len(found) - k)[len(found) - k]) if len(found) >= k else 0.0

    def score(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, list[int]]:
        """Votes of the k nearest examples weighted by cosine and drawn towards the base rate, and the ids that voted, nearest first."""
        votes, weight, voted = PRIOR_WEIGHT * self.base_rate, PRIOR_WEIGHT, []
        for cosine, row in self.nearest(terms, counts, k):
            votes, weight = votes + cosine * self.labels[row], weight + cosine
            voted.append(int(self.ids[row]))
        return min(1.0, float(votes / weight)), voted


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> BlockMaxIndex:
    """An index of about max_examples labelled rows with about max_bytes of text, those of held-out ids and null labels left out.

    The sample goes to the driver, which builds the index of all its terms. Near copies with the same label count once. Ids that are labelled
    twice take the larger label; of several texts of one id the least is learned from. Null texts teach nothing. Without examples every document gets score 0.
    """
    learn = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), 4) != 2))
    learn = learn.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    share = lambda of: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, of))
    part = max_examples / max(1, learn.count())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = rows.join(F.broadcast(learn.where(share(part))), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = cut(found.withColumn("fp", fingerprint_udf("text")))
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    rows = [(r["fp"] & (1 << 64) - 1, r["id"], r["label"], r["text"]) for r in found.where(share(min(1.0, part) * max_bytes / size)).collect()]
    rows.sort(key=lambda r: (r[2], r[0].bit_count(), r[0], r[1]))
    fps, group = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[2] for r in rows], dtype=np.int64)
    copies = set(_forest(group, np.bitwise_count(fps).astype(np.int64), fps, RADIUS)[1].tolist())
    kept = sorted((r[1:] for i, r in enumerate(rows) if i not in copies), key=lambda r: r[0])
    return BlockMaxIndex([r[0] for r in kept], [r[1] for r in kept], [terms_of(r[2]) for r in kept])


_OUT = StructType([StructField("score", DoubleType()), StructField("evidence", ArrayType(LongType()))])


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with toxicity (0 to 1), toxic (1 from threshold on) and evidence (ids of the examples that voted, nearest first).

    Null texts, texts without words and texts whose words no example has get the base rate and no evidence. Whole texts are scored, however long; repeated rows
    each time; an empty table gives an empty result. Columns of the three names are replaced, all others stay. The index (its sample is bounded) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @pandas_udf(_OUT)
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            yield pd.DataFrame([known.score(*terms_of(t)) for t in texts], columns=["score", "evidence"])
        give_back()  # idle workers keep nothing of the texts

    made = fresh(docs, "tox")
    out = docs.withColumn(made, vote(F.col(text_col)))
    return out.withColumns({"toxicity": F.col(f"{made}.score"), "toxic": (F.col(f"{made}.score") >= threshold).cast("int"), "evidence": F.col(f"{made}.evidence")}).drop(made)
