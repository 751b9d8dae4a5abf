"""Byte-level BPE as a tokenizer file describes it: a queue of merges by rank over a linked list of symbols."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quernstone.llm.common import fresh

VOCABULARY = "byte_bpe_50k.json"
#: Matches whose ids a Python worker remembers.
REMEMBERED = 200_000
#: Rows of a batch whose ids are held at once.
ROWS = 500
#: Characters of a text whose matches are held at once; a piece ends at the next place where a match surely ends.
PIECE = 1 << 20
#: Bits of a place in a queue entry; the rank stands above them.
_PLACE = 40

# Letters and numbers that came with Unicode 17, which the tokenizer's own tables (Unicode 16) take for neither.
LATER_LETTERS = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    r"\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: printable ones for themselves, the others, in order, for those from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class _Remembered(dict):
    """Ids of matches of the pattern, worked out on first use."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, match: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[match] = found = self.of(match.encode())
        return found


class _Tokens(dict):
    """Bytes of ids; none for ids that stand for nothing."""

    def __missing__(self, token: int) -> bytes:
        return b""


class QueueBpe:
    """Encoder and decoder for the content of one tokenizer file (a byte-level BPE with a list of merges and added tokens)."""

    def __init__(self, content: bytes, pattern: str = public_tokenizers.PATTERN):
        file = json.loads(content)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.of_byte = [vocabulary[c] for c in letters]
        self.entry: dict[tuple[int, int], int] = {}  # of a pair, its rank before the place
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.entry.setdefault((vocabulary[left], vocabulary[right]), rank << _PLACE)
            self.made.append(vocabulary[left + right])
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        written = {i: t for t, i in (vocabulary | added).items()}
        self.token = _Tokens((i, bytes(map(byte_of.__getitem__, t)) if set(t) <= set(byte_of) else t.encode()) for i, t in written.items())
        self.added = added
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        plain = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")  # what is white space goes by Unicode, as in the library
        self.split = regex.compile(plain).findall
        older = plain.replace(r"\p{L}", rf"[\p{{L}}--[{LATER_LETTERS}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER_NUMBERS}]]")
        self.split_later = regex.compile(older, regex.V1).findall
        self.later = re.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]").search
        self.ids_of = _Remembered(self.merged)

    def merged(self, match: bytes) -> tuple[int, ...]:
        """Ids of one match: the pair of least rank merges first, of equal ones the leftmost.

        The symbols are a doubly linked list over the places of the match. The queue holds (rank, place of the left symbol) as one number; an entry whose place is gone or whose
        pair has another rank by now is stale and is skipped. So a match of n bytes takes O(n log n).
        """
        symbol = [*map(self.of_byte.__getitem__, match)]
        n = len(symbol)
        queue = [r | i for i, r in enumerate(map(self.entry.get, zip(symbol, symbol[1:]))) if r is not None]
        if not queue:
            return tuple(symbol)
        heapify(queue)
        entry, made, at = self.entry.get, self.made, (1 << _PLACE) - 1
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        symbol.append(None)  # the end, which no pair has
        while queue:
            least = heappop(queue)
            i = least & at
            left, j = symbol[i], after[i]
            if left is None or entry((left, symbol[j])) != least - i:
                continue
            symbol[i], symbol[j] = new, _ = made[least >> _PLACE], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := entry((new, symbol[k]))) is not None:
                    heappush(queue, r | i)
            if (k := before[i]) >= 0 and (r := entry((symbol[k], new))) is not None:
                heappush(queue, r | k)
        return tuple([s for s in symbol if s is not None])

    def encode(self, text: str) -> array:
        out = array("I")
        for k, part in enumerate(self.at_added(text)):
            if k % 2:
                out.append(self.added[part])
                continue
            split = self.split if _latin(part) or not self.later(part) else self.split_later
            for piece in pieces(part):
                out.extend(chain.from_iterable(map(self.ids_of.__getitem__, split(piece))))
        return out

    def decode(self, ids: np.ndarray, skip: frozenset[int] = frozenset()) -> str:
        """The tokens' strings one after another; ids that stand for nothing are left out, bytes that are no UTF-8 become U+FFFD."""
        kept = (i for i in ids.tolist() if i not in skip) if skip else ids.tolist()
        return b"".join(map(self.token.__getitem__, kept)).decode("utf-8", "replace")


def _latin(text: str) -> bool:
    """Whether text has Latin-1 characters only, as a quick test."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of about `size` characters, cut only where a match ends whatever stands around: between another character and a space or line feed."""
    start, n = 0, len(text)
    edge = regex.compile(r"(?<=\P{White_Space})(?=[ \n])")
    while n - start > size:
        found = edge.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < n:
        yield text[start:] if start else text


@lru_cache(1)
def _queue(content: bytes) -> QueueBpe:
    """The encoder of a worker, kept with what it remembers from task to task."""
    return QueueBpe(content)


_OUT = StructType([StructField("ids", BinaryType()), StructField("decoded", StringType())])


def _content(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """docs with ids: token ids as little-endian unsigned 32-bit integers, without special tokens around them; with decoded_col also the text they decode to.

    Null and empty texts have no ids. An added token's own string in a text is that token, as in the library whose ids these are. Very long texts are read whole, piece by
    piece; a run of one character without an end takes O(n log n). Repeated rows are encoded each time; an empty table gives an empty result.
    Columns named like the new ones are replaced, all others stay. The tokenizer file (path; bounded by its size) is read by the driver and sent with the function.
    """
    content = _content(path)

    @pandas_udf(_OUT)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _queue(content)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                ids = [np.asarray(bpe.encode(t or ""), dtype="<u4") for t in batch.iloc[start : start + ROWS]]
                yield pd.DataFrame({"ids": [x.tobytes() for x in ids], "decoded": [bpe.decode(x) for x in ids] if decoded_col else None}, columns=["ids", "decoded"], dtype=object)

    made = fresh(docs, "bpe")
    columns = {ids_col: F.col(f"{made}.ids")} | ({decoded_col: F.col(f"{made}.decoded")} if decoded_col else {})
    return docs.withColumn(made, both(F.col(text_col))).withColumns(columns).drop(made)


def decode_documents(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None, skip_special_tokens: bool = False) -> DataFrame:
    """rows with the text that ids (as encode_documents writes them) stand for.

    Null counts as no ids and gives an empty text. Ids outside the vocabulary give nothing, bytes that are no UTF-8 give U+FFFD. A column named like text_col is
    replaced, all others stay; repeated rows and empty tables are nothing special.
    """
    content = _content(path)

    @pandas_udf(StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _queue(content)
        skip = frozenset(bpe.added.values()) if skip_special_tokens else frozenset()
        for ids in batches:
            yield pd.Series([bpe.decode(np.frombuffer(x or b"", dtype="<u4"), skip) for x in ids], dtype=object)

    return rows.withColumn(text_col, decoded(F.col(ids_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, and the hashes of its ids and of the text they decode to. Odd rows are as in encode_documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = encode_documents(rows, decoded_col="decoded")
    return out.select(
        F.col("doc_id").alias(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
