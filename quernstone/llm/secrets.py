"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import cut
from quernstone.llm.spans import find_spans, labelled, let, written

KINDS = ("assign", "access", "hex", "random")
#: The first alternatives are what the patterns of this task say; the counts make one scan drop matches that are too short.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
LEAST_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Tokens that are tested for randomness, whatever sign (=, : or a quote) stands before them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
#: Most standard deviations that any of the three tests may be off from randomness, which about 3 of 1000 random tokens exceed.
MOST_Z = 3.29
#: What ordinary tokens (names, paths, numbers) are like: how often neighbours are of different classes (lower case, upper case, digits, signs), how much likelier than in a
#: random token two characters are equal (counted against 26 characters at most), and how much the places of neighbours in the alphabet correlate.
ORDINARY_CHANGE, ORDINARY_EQUAL, ORDINARY_SERIAL = 0.1, 1.73, 0.3
#: Share of false discoveries that is allowed among the tokens of each length class.
FALSE_SHARE = 0.01
#: Evidence is counted in tenths of powers of ten, up to so many: at 10^-40 a token passes in any table.
MOST_EVIDENCE = 400
#: Splits a string into its characters.
EACH = "(?<=.)(?=.)"
_LOWER, _UPPER, _DIGITS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_"
#: Encodings in the order in which they are tried: pattern and alphabet.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Z]+$", _UPPER),
    (r"^[A-Za-z]+$", _UPPER + _LOWER),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    (r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _change_rate(alphabet: str) -> float:
    shares = [sum(c in group for c in alphabet) / len(alphabet) for group in (_LOWER, _UPPER, _DIGITS, _SIGNS)]
    return 1 - sum(s * s for s in shares)


def _beyond(z: Column) -> Column:
    """Tenths of powers of ten of an upper bound of the normal chance to lie z or more standard deviations off; none for z below 0."""
    return F.when(z > 0, (z * z / 2 + math.log(2)) * (10 / math.log(10))).otherwise(0.0)


def _evidence(token: Column, alphabet: Column, rate: Column) -> Column:
    """Evidence against a token being ordinary, as tenths of powers of ten of a p-value; 0 if a test speaks against it being random.

    Three statistics are tested: chi-squared of the characters' counts against a uniform alphabet, the number of runs of a character class, and the
    correlation of neighbours. Each has a standard deviate under randomness, and must not be far off; and each has a p-value under ordinary writing: that ordinary
    characters would be spread so evenly (normal bound on the number of equal pairs), change class so often (Chernoff's bound) or depend so little on their neighbours
    (normal bound). The least of the three, times three, is the token's p-value. It falls with length, so short tokens can't pass.
    """
    k, n = F.length(alphabet).cast("double"), F.length(token).cast("double")
    counts = F.transform(F.split(alphabet, EACH), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)
    spread = F.lit(2 / 9) / (k - 1)
    z_chi = let(squares, lambda q: (F.pow(F.greatest(q * k / n - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    equal = F.lit(ORDINARY_EQUAL) / F.least(k, F.lit(26.0))
    pairs = n * (n - 1) / 2
    off = F.sqrt(pairs * equal * (1 - equal) + n * (n - 1) * (n - 2) * equal * equal * 0.2)
    even = _beyond((pairs * equal - (squares - n) / 2) / off)

    classes = F.translate(token, _LOWER + _UPPER + _DIGITS + _SIGNS, "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
    changes = (F.regexp_count(classes, F.lit("a++|A++|0++|-++")) - 1).cast("double")
    varied = rate > 0
    z_runs = F.when(varied, (changes - (n - 1) * rate) / F.sqrt((n - 1) * F.when(varied, rate * (1 - rate)))).otherwise(0.0)
    seen = F.greatest(F.least(changes / (n - 1), F.lit(1 - 1e-9)), F.lit(ORDINARY_CHANGE))
    lively = F.when(varied, (n - 1) * (seen * F.log10(seen / ORDINARY_CHANGE) + (1 - seen) * F.log10((1 - seen) / (1 - ORDINARY_CHANGE))) * 10).otherwise(0.0)

    places = F.transform(F.split(token, EACH), lambda c: F.instr(alphabet, c) - 1 - (k - 1) / 2)
    product = let(places, lambda p: F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    z_serial = product / ((k * k - 1) / 12 * F.sqrt(n - 1))
    free = _beyond(ORDINARY_SERIAL * F.sqrt(n - 1) - z_serial)

    tenths = F.least(F.greatest(F.floor(F.greatest(even, lively, free) - 10 * math.log10(3)), F.lit(0)), F.lit(MOST_EVIDENCE)).cast("int")
    return F.when((F.abs(z_chi) <= MOST_Z) & (F.abs(z_runs) <= MOST_Z) & (F.abs(z_serial) <= MOST_Z), tenths).otherwise(0)


def evidence(token: Column) -> Column:
    """_evidence under the first encoding that fits a token."""
    encoding = F.lit(None).cast("struct<alphabet:string,rate:double>")
    for pattern, alphabet in reversed(ENCODINGS):
        encoding = F.when(token.rlike(pattern), F.struct(F.lit(alphabet).alias("alphabet"), F.lit(_change_rate(alphabet)).alias("rate"))).otherwise(encoding)
    return F.coalesce(let(encoding, lambda e: _evidence(token, e["alphabet"], e["rate"])), F.lit(0))


def find_base(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns by kind."""
    long_enough = lambda x: F.char_length(F.regexp_extract(x["value"], ASSIGN_VALUE, 1)) >= LEAST_VALUE
    return {"assign": F.filter(find_spans(text, ASSIGN), long_enough), "access": find_spans(text, ACCESS), "hex": find_spans(text, HEX)}


def thresholds(tested: DataFrame) -> dict[int, int]:
    """For each length class the least evidence that the step-up rule of Benjamini and Hochberg accepts; tested: size, evidence, n tokens.

    The table has a row for each length class and evidence, at most 32 times MOST_EVIDENCE, and comes to the driver.
    """
    out: dict[int, int] = {}
    by_class: dict[int, dict[int, int]] = {}
    for r in tested.collect():
        by_class.setdefault(r["size"], {})[r["evidence"]] = r["n"]
    for size, counts in by_class.items():
        total, found = sum(counts.values()), 0
        for level in sorted(counts, reverse=True):
            found += counts[level]
            if level > 0 and total * 10 ** (-level / 10) <= FALSE_SHARE * found:
                out[size] = level
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base (spans of the fixed patterns), spans (all), both by start and then kind.

    Spans are (order, kind, start, end) in code points, end exclusive. kind random are tokens found by the battery that touch no span of the fixed
    patterns; copies of a token count once in the false-discovery control. Null counts as empty; empty texts have no
    spans; repeated rows are reported each time; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = find_base(text)
    drop = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    tokens = F.transform(find_spans(text, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("token"), evidence(x["value"]).alias("evidence")))
    rows = cut(docs.select(F.col(id_col), *[drop(c).alias(k) for k, c in base.items()], tokens.alias("tokens")))
    size = lambda x: F.floor(F.log2((x["end"] - x["start"]).cast("double"))).cast("int")

    each = rows.select(F.explode("tokens").alias("t")).select(size(F.col("t")).alias("size"), F.col("t.token").alias("token"), F.col("t.evidence").alias("evidence"))
    least = thresholds(each.groupBy("size", "token", "evidence").agg(F.lit(1).alias("_")).groupBy("size", "evidence").agg(F.count("*").alias("n")))
    level = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.create_map().cast("map<int,int>")

    known = F.array_sort(F.concat(*[labelled(F.col(k), k, i) for i, k in enumerate(KINDS[:3])]), _by_start)
    fresh = lambda t: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    passes = lambda t: F.coalesce(t["evidence"] >= F.try_element_at(level, size(t)), F.lit(False)) & fresh(t)
    found = labelled(F.filter("tokens", passes), KINDS[3], 3)
    return rows.select(
        F.col(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        known.alias("base"),
        F.array_sort(F.concat(known, found), _by_start).alias("spans"),
    )


def _by_start(a: Column, b: Column) -> Column:
    differs = lambda k: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1)
    return F.coalesce(differs("start"), differs("order"), differs("end"), F.lit(0))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_secrets with the spans written out: counts, base_sha256 and spans."""
    found = find_secrets(docs, id_col, text_col)
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
