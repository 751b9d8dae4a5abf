"""How far the sources of a language differ in their terms, worked out once for all terms of the same counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import attach, cut

#: Documents of a language that a kept term is in at least; terms reported for a group.
LEAST_DOCUMENTS, TOP = 10, 10
#: Shares are counted in units of one part in 1000 ** DIGITS; counts have PRIOR added.
DIGITS, PRIOR = 3, 2
#: Terms that a task holds before it passes their counts on.
HELD = 200_000
#: Distinct vectors of a language that one group works on, and numbers of a block of them.
VECTORS, BLOCK = 4096, 1 << 21
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = "lang string, source string, term string, n long, docs long"
_EVALUATED = "lang string, source string, item string, value long, sig string"


def _read(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that have the term), nulls read as ''.

    Each task adds up its own rows and holds HELD terms at most, so a very common word costs a row for each task that meets it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, having, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                key, raw = (lang, source), text.encode().lower()  # bytes: only A-Z change
                before = len(seen[key])
                if len(raw) < 1 << 20:
                    terms = _TERM.findall(raw)
                    seen[key].update(terms)
                    having[key].update(set(terms))
                else:
                    own = Counter(m[0] for m in _TERM.finditer(raw))
                    seen[key].update(own)
                    having[key].update(own.keys())
                held += len(seen[key]) - before
                if held > HELD:
                    yield from _told(seen, having)
                    held = 0
        yield from _told(seen, having)

    return docs.select(_read(lang_col).alias("lang"), _read(source_col).alias("source"), _read(text_col).alias("text")).mapInPandas(count, _COUNTS)


def _told(seen: dict, having: dict) -> Iterator[pd.DataFrame]:
    """The counts gathered so far, which are forgotten then."""
    rows = [(lang, source, term.decode(), n, having[lang, source][term]) for (lang, source), counts in seen.items() for term, n in counts.items()]
    seen.clear()
    having.clear()
    yield pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])


def share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(1000 ** DIGITS * counts / of), exact while 1000 * of is below 2 ** 63: long division by three digits at a time."""
    whole, rest = np.divmod(counts, of)
    for _ in range(DIGITS):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _evaluate(vectors: pa.Table, group: pa.Table) -> pa.Table:
    """Of some distinct vectors of a language: the sum of f over their terms for each pair of sources, and for each source the TOP vectors whose terms it has beyond the language's share.

    vectors: sig, vec (source, n), m (terms that have it), first (the least of these). group: one row with sources (source, n), terms and all_n of the language.
    """
    info = group.slice(0, 1).to_pylist()[0]
    lang, names = info["lang"], [s["source"] for s in info["sources"]]
    sums = np.array([s["n"] for s in info["sources"]], dtype=np.int64)
    place, smooth, size = {s: i for i, s in enumerate(names)}, PRIOR * (info["terms"] or 0), len(names)
    total = np.zeros((size, size), dtype=np.int64)
    found = [[] for _ in names]  # of each source: (-f, first term, sig) of its TOP vectors
    step = max(1, BLOCK // max(1, size))
    for start in range(0, vectors.num_rows, step):
        part = vectors.slice(start, step).combine_chunks()
        vec = part["vec"].combine_chunks() if isinstance(part["vec"], pa.ChunkedArray) else part["vec"]
        entries, row = vec.flatten(), np.repeat(np.arange(part.num_rows), np.diff(vec.offsets.to_numpy()))
        coded = entries.field("source").dictionary_encode()
        column = np.array([place[s] for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        counts = np.zeros((part.num_rows, size), dtype=np.int64)
        counts[row, column] = entries.field("n").to_numpy()
        times = part["m"].to_numpy()
        p = share(counts + PRIOR, sums + smooth)
        for i in range(size - 1):
            total[i, i + 1 :] += times @ apart(p[:, i : i + 1], p[:, i + 1 :])
        q = share(counts.sum(axis=1, keepdims=True) + PRIOR, np.array([[info["all_n"] + smooth]]))
        value, more = apart(p, q), (counts > 0) & (p > q)
        firsts, sigs = part["first"].to_pylist(), part["sig"].to_pylist()
        rank = np.empty(part.num_rows, dtype=np.int64)
        rank[sorted(range(part.num_rows), key=lambda k: firsts[k].encode())] = np.arange(part.num_rows)
        for i in range(size):
            at = np.flatnonzero(more[:, i])
            for k in at[np.lexsort((rank[at], -value[at, i]))[:TOP]].tolist():
                found[i].append((-int(value[k, i]), firsts[k].encode(), sigs[k]))
            found[i] = sorted(found[i])[:TOP]
    total += total.T
    pairs = [(names[i], names[j], int(total[i, j]), None) for i in range(size) for j in range(size) if i != j]
    best = [(names[i], first.decode(), -f, sig) for i in range(size) for f, first, sig in found[i]]
    source, item, value, sig = zip(*pairs, *best, strict=True) if pairs or best else ((), (), (), ())
    columns = [pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64()), pa.array(sig, pa.string())]
    return pa.table(columns, names=["lang", "source", "item", "value", "sig"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others (pair), and the terms that set it apart from the language (term).

    Terms are runs of letters A-Z (lower-cased) and of what is no ASCII; a language keeps those in at least least_documents of its rows. Terms with the same counts in
    the same sources are one vector: each pair of sources is evaluated once for it and counts as often as there are such terms. The vectors of a language are
    dealt to groups of about VECTORS. For the terms, the TOP vectors of a source hold its TOP terms, as each vector stands for the least of its terms.

    Null text, language and source are read as ''. Groups without terms are compared like the others. Repeated rows are documents of their own. Very long texts are counted as they
    are read. An empty table gives an empty result. Further columns are ignored, whatever their names. Shares are exact up to 9e15 words in a language.
    """
    counts = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    kept = cut(by_term.where(F.col("docs") >= least_documents).select("lang", "term", F.sha2(F.to_json("vec"), 256).alias("sig"), "vec"))
    vectors = cut(kept.groupBy("lang", "sig").agg(F.count("*").alias("m"), F.min("term").alias("first"), F.first("vec").alias("vec")))

    groups = docs.select(_read(lang_col).alias("lang"), _read(source_col).alias("source")).distinct()
    entries = vectors.select("lang", "m", F.inline("vec"))
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("n"))
    sizes = cut(vectors.groupBy("lang").agg(F.sum("m").alias("terms"), F.count("*").alias("size")))
    named = groups.join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("of"), F.coalesce("n", F.lit(0)).alias("n"))
    langs = named.groupBy("lang").agg(F.array_sort(F.collect_list("of")).alias("sources"), F.sum("n").alias("all_n")).join(sizes, "lang", "left")
    last = F.ceil(F.greatest(F.coalesce("size", F.lit(0)), F.lit(1)) / VECTORS) - 1
    dealt = langs.select("lang", "sources", "all_n", "terms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    salted = attach(vectors, sizes.select("lang", "size"), ["lang"], "size", total).withColumn("salt", F.pmod(F.xxhash64("sig"), F.ceil(F.col("size") / VECTORS)))
    made = salted.select("lang", "salt", "sig", "vec", "m", "first").groupBy("lang", "salt").cogroup(dealt.groupBy("lang", "salt")).applyInArrow(_evaluate, _EVALUATED)
    out = cut(made)

    here = ["lang", "source"]
    by_value = [F.col("value").desc(), F.col("item")]
    pairs = out.where("sig IS NULL").groupBy(*here, "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*here).orderBy(*by_value)))
    best = out.where("sig IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy(*here).orderBy(*by_value))).where(F.col("rank") <= TOP)
    least = kept.select("lang", "sig", F.col("term").alias("item"), F.row_number().over(Window.partitionBy("lang", "sig").orderBy("term")).alias("rank")).where(F.col("rank") <= TOP)
    terms = best.select(*here, "value", "sig").join(least.drop("rank"), ["lang", "sig"])
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy(*here).orderBy(*by_value))).where(F.col("rank") <= TOP)
    columns = [*here, "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
