"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import about, cut, fresh

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: About so many labelled URLs are learned from, chosen by a hash of the URL.
MAX_LABELLED = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SUFFIX_PRIOR = 10.0
#: Parts of the sample; a labelled URL's rates come from the other parts.
FOLDS = 5
FEATURES = ("_n_url", "_n_host", "_n_path", "_labels", "_depth", "_digits", "_entropy", "_parameters", "_hyphens", "_suffix_rate", "_domain_rate", "_ending_rate")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased, up to / ? # or the end) and path (up to ? # or the end); both empty without ://."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_for(rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does.

    A rule is a host, which stands for its subdomains too, and the beginning of a path. The rules become one expression, so
    they should number hundreds at most.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, path = name[: name.index("/")], name[name.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _lexical(pages: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda of, c: (F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))).cast("double")
    share = lambda c: count_of(c) / n
    count_of = lambda c: F.length(url) - F.length(F.replace(url, c, F.lit("")))
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    name = F.regexp_replace("host", r":[0-9]*$", "")
    return pages.withColumns(
        {
            "_n_url": F.length(url).cast("double"),
            "_n_host": F.length("host").cast("double"),
            "_n_path": F.length("path").cast("double"),
            "_labels": count(F.col("host"), "."),
            "_depth": count(F.col("path"), "/"),
            "_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "_entropy": entropy,
            "_parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "_hyphens": count(F.col("host"), "-"),
            "_suffix": F.substring_index(name, ".", -1),
            "_domain": F.substring_index(name, ".", -2),
            "_ending": F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)$", 1),
        }
    )


def _rates(known: DataFrame, rows: DataFrame, rate: float, folds: bool) -> DataFrame:
    """rows with the smoothed block rate of their suffix, domain and ending among known; with folds, among the known rows of other folds than their own."""
    for key in ("_suffix", "_domain", "_ending"):
        tally = [F.sum("_label").alias("_s"), F.count("*").alias("_c")]
        blocked, count = F.coalesce("_s", F.lit(0.0)), F.coalesce("_c", F.lit(0))
        rows = rows.join(F.broadcast(known.groupBy(key).agg(*tally)), key, "left").withColumns({"_blocked": blocked, "_count": count}).drop("_s", "_c")
        if folds:
            rows = rows.join(F.broadcast(known.groupBy(key, "_fold").agg(*tally)), [key, "_fold"], "left")
            rows = rows.withColumns({"_blocked": F.col("_blocked") - blocked, "_count": F.col("_count") - count}).drop("_s", "_c")
        rows = rows.withColumn(f"{key}_rate", (F.col("_blocked") + rate * _SUFFIX_PRIOR) / (F.col("_count") + _SUFFIX_PRIOR)).drop("_blocked", "_count")
    return rows


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and block_score (null where a rule decides).

    URLs that a rule fits are the labelled ones. About max_labelled of them teach gradient-boosted trees, which judge
    the others; the suffix statistics are smoothed block rates among these labelled URLs, so their tables are bounded by the sample. While the trees learn, a URL's rates
    come from the other FOLDS of the sample, never from its own label. If the labels are all alike, or there are none, the others get that label, or allow.
    Null, empty and odd URLs have empty host and path and are judged by the trees; very long ones count in full; repeated rows are judged each time; an empty table
    gives an empty result. Input columns named like the five new ones are replaced, all others stay, whatever their names.
    """
    rule, verdict = rule_for(rules)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "block_score")]
    held = fresh(pages, "page")
    parts = pages.select(F.col(url_col).alias("_url"), F.struct(*[f"`{c}`" for c in kept]).alias(held))  # the caller's columns can't meet those made here
    parts = with_parts(parts, "_url").withColumns({"rule": rule, "verdict": verdict})
    known = parts.where("rule is not null").select("_url", "host", "path", (F.col("verdict") == "block").cast("double").alias("_label"))
    tally = known.agg(F.count("*").alias("n"), F.sum("_label").alias("blocked")).first()
    out = [f"{held}.*", "host", "path", "rule"]
    if not tally["n"] or tally["blocked"] in (0, tally["n"]):
        other = "block" if tally["n"] and tally["blocked"] else "allow"
        return parts.select(*out, F.coalesce("verdict", F.lit(other)).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(float(other == "block"))).alias("block_score"))
    learn = _lexical(about(known, F.col("_url"), max_labelled, tally["n"]), "_url").withColumn("_fold", F.pmod(F.xxhash64("_url"), F.lit(FOLDS)))
    learn = cut(learn.drop("host", "path", "_url"))
    rate = tally["blocked"] / tally["n"]

    trees = GBTClassifier(labelCol="_label", featuresCol="_features", predictionCol="_says", maxIter=20, maxDepth=4, stepSize=0.2, seed=17)
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    taught = cut(_rates(learn, learn, rate, True).select(*FEATURES, "_label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="_features"), trees]).fit(taught)
    judged = model.transform(_rates(learn, _lexical(parts, "_url"), rate, False))
    says = F.coalesce("verdict", F.when(F.col("_says") >= 0.5, "block").otherwise("allow"))
    return judged.select(*out, says.alias("verdict"), F.when(F.col("rule").isNull(), vector_to_array("_probability")[1]).alias("block_score"))
