"""Byte-level BPE by tree reduction: halves are encoded apart and joined by encoding a window at the cut anew."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StructField, StructType

from quernstone.llm.common import fresh, give_back

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a text, bytes of a match and ids below which a piece is a leaf of the tree.
LEAF = 256
#: Matches whose ids a Python worker remembers.
REMEMBERED = 300_000
#: Rows of a batch whose ids are held at once.
ROWS = 500
#: A text is cut at a space within so many characters from its middle, if there is one.
NEAR = 24
_NONE = 1 << 62


class _Remembered(dict):
    """Ids of matches of the pattern, worked out on first use."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, match: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[match] = found = self.of(match)
        return found


class TreeBpe:
    """Encoder and decoder for one vocabulary file's content (lines of base64 token and rank).

    A text is a tree of halves. A leaf is split by the pattern and each match is encoded by merging the pair of least rank, the leftmost first. Two
    neighbours are joined at their cut: the matches there are found anew in a window that grows until it starts and stops where
    a match ends whatever stands around. A match that is longer than a leaf is a tree of its own, over bytes: tokens at a cut are
    merged anew in a window until the tokens on either side of its edges stay as they are when they are merged as a pair. Ids of a byte
    string are the right ones exactly if each neighbouring pair stays so, as a merge across the edge of two tokens would be seen in the pair.
    """

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.token = {rank: token for token, rank in self.rank.items()}
        # What is white space goes by Unicode, as in the library whose ids these are.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.leaf = max(2, leaf)
        self.ids_of = _Remembered(lambda match: tuple(map(self.rank.__getitem__, self._bytes(match.encode()))))
        self.stays = lru_cache(1 << 16)(lambda a, b: self.merge(a + b) == [a, b])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._text(text, 0, len(text))[1])) if text else []

    def _text(self, text: str, lo: int, hi: int) -> tuple[list[str], list[tuple[int, ...]]]:
        """Matches of text[lo:hi] and their ids."""
        if hi - lo <= self.leaf:
            matches = self.split(text[lo:hi])
            return matches, list(map(self.ids_of.__getitem__, matches))
        mid = (lo + hi) // 2
        mid = max(mid, text.find(" ", mid, min(hi, mid + NEAR)))
        matches, ids = self._text(text, lo, mid)
        more, more_ids = self._text(text, mid, hi)
        if _edge(matches[-1], more[0]):
            return matches + more, ids + more_ids
        i = j = 1
        while i < len(matches) and not _edge(matches[-i - 1], matches[-i]):
            i = min(2 * i, len(matches))
        while j < len(more) and not _edge(more[j - 1], more[j]):
            j = min(2 * j, len(more))
        window = self.split("".join(matches[-i:] + more[:j]))
        matches[-i:], ids[-i:] = window, map(self.ids_of.__getitem__, window)
        matches += more[j:]
        ids += more_ids[j:]
        return matches, ids

    def _bytes(self, match: bytes) -> list[bytes]:
        """Tokens of one match."""
        if len(match) <= self.leaf:
            return self.merge(match)
        mid = len(match) // 2
        left, right = self._bytes(match[:mid]), self._bytes(match[mid:])
        i, at = 1, 0
        while True:
            window = self.merge(b"".join([*left[-i:], right[at]]))
            if i < len(left) and not self.stays(left[-i - 1], window[0]):
                i = min(2 * i, len(left))
                continue
            left[-i:], at, i = window, at + 1, 1
            if at == len(right) or self.stays(left[-1], right[at]):
                return left + right[at:]

    def merge(self, piece: bytes) -> list[bytes]:
        """Tokens of a short piece by merging the pair of least rank over and over."""
        rank = self.rank.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], _NONE)
        return parts

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, halves joined up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _edge(before: str, after: str) -> bool:
    """Whether a match ends between these two whatever stands around: no alternative of the pattern crosses from another character into white space."""
    return after[0] in " \n" and not before[-1].isspace()


@lru_cache(1)
def _tree(ranks: bytes, leaf: int) -> TreeBpe:
    """The encoder of a worker, kept with what it remembers from task to task."""
    return TreeBpe(ranks, leaf=leaf)


_OUT = StructType([StructField("ids", BinaryType()), StructField("decoded", BinaryType())])


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """docs with ids (token ids as little-endian unsigned 32-bit integers) and decoded (the bytes those ids stand for).

    Null counts as empty and gives no ids. Special tokens are never made. Any text round-trips, very long ones and long runs of one character
    too. Repeated rows are encoded each time; an empty table gives an empty result. Columns named ids and decoded are replaced, all others stay.
    The vocabulary (path; bounded by its file) is read by the driver and sent with the function.
    """
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = file.read()

    @pandas_udf(_OUT)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _tree(ranks, leaf)
        for texts in batches:
            for start in range(0, len(texts), ROWS):
                ids = [np.array(bpe.encode(t or ""), dtype="<u4") for t in texts.iloc[start : start + ROWS]]
                yield pd.DataFrame({"ids": [x.tobytes() for x in ids], "decoded": [bpe.decode(x) for x in ids]})
        give_back()

    made = fresh(docs, "bpe")
    return docs.withColumn(made, both(F.col(text_col))).withColumns({"ids": F.col(f"{made}.ids"), "decoded": F.col(f"{made}.decoded")}).drop(made)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, and the hashes of its ids and of the bytes they decode to."""
    out = encode_documents(docs.select(id_col, text_col), text_col)
    return out.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
