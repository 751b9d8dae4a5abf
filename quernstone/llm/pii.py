"""Personal data in texts: fixed patterns as seeds, and contexts learned from them that lead to further identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import attach, cut, packed
from quernstone.llm.spans import find_spans, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns of this task, written so that long runs take linear time: a match starts where a run does, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_FITS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words that may be identifiers: at least 6 characters and 4 digits, or an @.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+"
LEAST_DIGITS = 4
#: Digits in groups may be identifiers as well, with no more digits than a card has.
GROUPED = r"(?<![A-Za-z0-9@._%+()-])\+?\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++(?![A-Za-z@_%]))++"
MOST_DIGITS = 19
#: The score from which an identifier counts as found, and the gain of any score in a round below which rounds end.
SURE = 0.75
STILL = 0.001
#: Other identifiers that each pattern is held to have besides those seen, so rare patterns are never sure.
DOUBT = 4.0


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(places, F.lit(0), lambda s, d: s + d) % 10 == 0


def find_base(text: Column) -> dict[str, Column]:
    """Spans of the fixed patterns by kind; matches that fail a kind's check are dropped."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    return {
        "email": find_spans(text, EMAIL),
        "ip": F.filter(find_spans(text, IP), lambda x: x["value"].rlike(IP_FITS)),
        "card": F.filter(find_spans(text, CARD), lambda x: F.when(F.char_length(digits(x)) <= 19, _luhn(digits(x))).otherwise(False)),
        "phone": F.filter(find_spans(text, PHONE), lambda x: F.char_length(digits(x)).between(9, 15)),
    }


def _patterns(x: Column) -> Column:
    """The contexts of a span: the word and signs before it, and those after it; none where there is no word."""
    before = F.lower(F.regexp_extract(x["before"], r"(\p{L}+[^\p{L}\p{N}]{1,4})$", 1))
    after = F.lower(F.regexp_extract(x["after"], r"^([^\p{L}\p{N}]{1,4}\p{L}+)", 1))
    return F.array_compact(F.array(F.when(before != "", F.concat(F.lit("<"), before)), F.when(after != "", F.concat(F.lit(">"), after))))


def _scores(edges: DataFrame) -> DataFrame:
    """Values that contexts lead to (value, kind), from edges (pattern, value, seed: index of a kind or null), each once.

    A pattern's score for a kind is the mean of its identifiers' scores, with DOUBT others of score 0; an identifier's is the chance that any
    of its patterns is right; seeds keep score 1 for their own kind. Scores only rise from round to round, so what is found can lead on to further
    contexts; rounds end when no score gains STILL any more and none passes SURE. Both tables stay in Spark, and keys that hold many rows are joined by a bounded broadcast.
    """
    edges = cut(edges)
    total = edges.count()
    edges = packed(edges, total)
    kinds = range(len(KINDS))
    of_value = cut(packed(edges.groupBy("value").agg(F.count("*").alias("n"), F.first("seed", ignorenulls=True).alias("seed")), total))
    seeded = lambda seed, k: F.when(seed == k, 1.0).otherwise(0.0)
    best = F.greatest(*[F.col(f"v{k}") for k in kinds])
    values = cut(of_value.select("value", "n", "seed", *[seeded(F.coalesce("seed", F.lit(-1)), k).alias(f"v{k}") for k in kinds]))
    while True:
        held = attach(edges, values.drop("seed"), ["value"], "n", total)
        patterns = held.groupBy("pattern").agg(F.count("*").alias("n"), *[(F.sum(f"v{k}") / (F.count("*") + DOUBT)).alias(f"p{k}") for k in kinds])
        held = attach(edges.select("pattern", "value"), cut(packed(patterns, total)), ["pattern"], "n", total)
        chance = held.groupBy("value").agg(*[(1 - F.exp(F.sum(F.log(1 - F.col(f"p{k}"))))).alias(f"c{k}") for k in kinds])
        score = [F.when(F.col("seed").isNull(), F.col(f"c{k}")).otherwise(F.col(f"v{k}")).alias(f"v{k}") for k in kinds]
        after = cut(packed(values.withColumn("was", best).join(chance, "value").select("value", "n", "seed", "was", *score), total))
        moved = after.where((best - F.col("was") >= STILL) | ((best >= SURE) & (F.col("was") < SURE))).limit(1).count()
        values = after.drop("was")
        if not moved:
            break
    kind = F.coalesce(*[F.when(F.col(f"v{k}") == best, F.lit(k)) for k in kinds])
    return values.where(F.col("seed").isNull() & (best >= SURE)).select("value", kind.alias("kind"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base (spans of the fixed patterns), spans (all), both by kind and then start.

    Spans are (order, kind, start, end) in code points, end exclusive. Seeds induce contexts, contexts that lead almost only to identifiers of one
    kind find further words of that kind that touch no seed. Copies of a value in one context count once. Null counts as
    empty; empty texts have no spans; repeated rows are reported each time; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = lambda x, seed: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("value"), _patterns(x).alias("patterns"), seed.alias("seed"))
    as_seeds = lambda spans, i: F.transform(spans, lambda x: slim(x, F.lit(i)))
    seeds = {k: as_seeds(c, i) for i, (k, c) in enumerate(find_base(text).items())}
    likely = lambda x: (F.char_length(F.regexp_replace(x["value"], "[^0-9]", "")) >= LEAST_DIGITS) | x["value"].contains("@")
    number = lambda x: F.char_length(F.regexp_replace(x["value"], "[^0-9]", "")).between(LEAST_DIGITS, MOST_DIGITS) & (F.char_length(x["value"]) >= 6)
    single, grouped = find_spans(text, CANDIDATE), F.filter(find_spans(text, GROUPED), lambda x: number(x) & x["value"].rlike(r"[\x20()]"))  # those of other signs are words already
    words = F.transform(F.concat(F.filter(single, likely), grouped), lambda x: slim(x, F.lit(None).cast("int")))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.concat(*seeds.values()).alias("_seeds"), words.alias("_words")))
    apart = lambda x: ~F.exists("_seeds", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    free = F.when(F.size("_words") > 0, F.filter("_words", apart)).otherwise(F.col("_words"))
    rows = rows.withColumn("_words", free)

    each = rows.select(F.explode(F.concat("_seeds", "_words")).alias("x")).select(F.explode("x.patterns").alias("pattern"), F.col("x.value").alias("value"), F.col("x.seed").alias("seed"))
    found = cut(_scores(each.groupBy(F.xxhash64("pattern").alias("pattern"), "value").agg(F.max("seed").alias("seed"))))

    spots = rows.select("_row", F.explode("_words").alias("x")).select("_row", "x.start", "x.end", "x.value")
    per_value = spots.groupBy("value").agg(F.count("*").alias("n"))
    sized = cut(found.join(per_value, "value"))
    spots = cut(attach(spots, sized, ["value"], "n", spots.count()).where("kind is not null"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    extra = spots.groupBy("_row").agg(F.collect_list(F.struct(F.col("kind").alias("order"), name.alias("kind"), "start", "end")).alias("_extra"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    extra = extra.withColumn("_extra", F.filter("_extra", lambda x: ~F.exists("_extra", lambda y: inside(x, y))))  # a word of a longer one that is found
    whole = rows.drop("_words").join(extra, "_row", "left")

    named = F.transform("_seeds", lambda x: F.struct(x["seed"].alias("order"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["seed"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = whole.select("_id", "_seeds", F.array_sort(named).alias("base"), "_extra")
    more = F.when(F.col("_extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_extra")))
    count = lambda i: F.size(F.filter("_seeds", lambda x: x["seed"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(F.col("_id").alias(id_col), *counts, "base", more.alias("spans"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_personal with the spans written out: counts, base_sha256 and spans."""
    found = find_personal(docs, id_col, text_col)
    return found.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
