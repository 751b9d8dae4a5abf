"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quernstone.llm.common import crc_mod, fresh

#: About so many documents of each language are learned from, chosen by a hash of their ids.
PER_LANGUAGE = 2000
#: Hashed n-grams (2 and 3 letters).
FEATURES = 1 << 14
#: Up to so many languages every split of the languages is a bit of the code; with more, this many random splits are used.
EXHAUSTIVE, RANDOM_BITS = 6, 63
AMBIGUOUS = 0.6
_CHUNK = 1 << 18
#: Which code points are letters; none from _END on is.
_END = 0x34000
_LETTERS = np.array([chr(c).isalpha() for c in range(_END)] + [False])


def ngram_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts of a text's hashed letter n-grams, words set apart by one space; and whether it has a letter."""
    out, any_letter = np.zeros(FEATURES, np.int64), False
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[max(0, at - 2) : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _LETTERS[np.minimum(codes, _END)]
        any_letter |= bool(letter.any())
        codes = np.where(letter, codes, 32)
        codes = codes[np.r_[True, letter[1:] | letter[:-1]]]
        a, b = codes[:-1], codes[1:]
        pair = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(18)
        three = (a[:-1] * np.uint32(0x9E3779B1) ^ b[:-1] * np.uint32(0xC2B2AE3D) ^ b[1:] * np.uint32(0x27D4EB2F)) >> np.uint32(18)
        out += np.bincount(pair, minlength=FEATURES) + np.bincount(three, minlength=FEATURES)
    return out, any_letter


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages: all splits of few languages, random ones (fixed seed) of many."""
    if n <= EXHAUSTIVE:
        splits = range(1, 1 << (n - 1))  # the first language is always on one side
        return np.array([[1 if i and s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)]).reshape(n, -1)
    rng = np.random.default_rng(20)
    code = rng.choice([-1, 1], size=(n, RANDOM_BITS))
    code[0, np.abs(code.sum(axis=0)) == n] *= -1
    return code


class CodedClassifier:
    """Binary n-gram classifiers for the bits of the languages' codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        weights, centre, spread = [], [], []
        for bit in self.code.T:
            one, zero = p[bit > 0].mean(axis=0), p[bit < 0].mean(axis=0)
            w = np.log(one) - np.log(zero)
            weights.append(w)
            centre.append((one @ w + zero @ w) / 2)
            spread.append((one @ w - zero @ w) / 2)
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((counts.shape[1], 0), np.float32)
        self.centre, self.spread = np.array(centre), np.maximum(np.array(spread), 1e-9)
        self.say = self.spread / self.spread.sum() * len(self.spread)  # bits that split their sides well say more

    def decode(self, counts: np.ndarray) -> tuple[str, float]:
        """The language of least weighted loss, and its share among all languages."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        margin = (counts.astype(np.float32) @ self.weights / max(1, counts.sum()) - self.centre) / self.spread
        loss = (np.log1p(np.exp(-4 * np.clip(self.code * margin, -8, 8))) * self.say).sum(axis=1)
        share = np.exp(loss.min() - loss)
        best = int(loss.argmin())
        return self.languages[best], float(share[best] / share.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> CodedClassifier | None:
    """A classifier from the documents that aren't held out and have a language; None if there are none.

    Every language is learned. Counts of n-grams are summed per language in Spark; what comes to the driver is FEATURES numbers for each language. Null and
    empty texts teach nothing; a row with a null id is learned from; repeated rows count each time.
    """
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(F.coalesce(F.col(id_col), F.lit(0)), 3) != 1))
    sizes = learn.groupBy(lang_col).count().collect()
    languages = sorted(r[0] for r in sizes)
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], int((1 << 30) * min(1.0, per_language / r["count"])))])
    kept = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share[F.col(lang_col)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for x in frames:
            for text, lang in zip(x["text"], x["lang"], strict=True):
                c = ngram_counts(text)[0]
                sums[lang] = sums[lang] + c if lang in sums else c
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": c[at]})

    sample = learn.where(kept).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    table = sample.mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), FEATURES))
    counts[table["lang"].map(number).to_numpy(int), table["feature"].to_numpy(int)] = table["n"]
    return CodedClassifier(languages, counts)


_OUT = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])


def identify(docs: DataFrame, model: CodedClassifier | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; und with score 0 for null texts, texts without a letter (Unicode category L), or no model.

    Whole texts count, however long. Repeated rows are judged each time; an empty table gives an empty result. Columns of the three names are replaced, all others stay.
    """

    @pandas_udf(_OUT)
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                counts, letters = ngram_counts(text) if text and model else (None, False)
                lang, score = model.decode(counts) if letters else ("und", 0.0)
                rows.append((lang, score, letters and score < AMBIGUOUS))
            yield pd.DataFrame(rows, columns=["lang", "score", "ambiguous"])

    made = fresh(docs, "told")
    out = docs.withColumn(made, tell(F.col(text_col)))
    return out.withColumns({"lang_pred": F.col(f"{made}.lang"), "score": F.col(f"{made}.score"), "ambiguous": F.col(f"{made}.ambiguous")}).drop(made)
