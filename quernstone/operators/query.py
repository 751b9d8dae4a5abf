"""Questions about a table of activities: ranges, filters, free text, orders, facets, profiles."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.fixed import CONFIDENCE
from quernstone.functions.text import slug_text
from quernstone.plans.steps import settle

# Fixed values. Days that a query covers by default and at most.
DEFAULT_DAYS, MOST_DAYS = 14, 400


def parse_range(first: date | None, last: date | None, today: date) -> tuple[date, date]:
    """The days asked for: two weeks from today by default, one day if only the first is given, in either order."""
    if first is None:
        start = today
        end = last or today + timedelta(days=DEFAULT_DAYS - 1)
    else:
        start, end = first, last or first
    start, end = min(start, end), max(start, end)
    if (end - start).days > MOST_DAYS:
        raise ValueError(f"a range of more than {MOST_DAYS} days")
    return start, end


def overlaps(start: Column, end: Column, first: date, last: date) -> Column:
    """Whether an activity touches the days from first to last; an end before the start counts as the start."""
    return F.coalesce((start <= F.lit(last)) & (F.greatest(F.coalesce(end, start), start) >= F.lit(first)), F.lit(False))


def _wanted(given: str | None) -> list[str]:
    return [w.strip().lower() for w in (given or "").split(",") if w.strip()]


def one_of(value: Column, given: str | None) -> Column:
    """Whether a value is in a comma-separated list, whatever its case; any is if the list is blank or *."""
    wanted = _wanted(given)
    return F.lit(True) if not wanted or "*" in wanted else F.coalesce(F.lower(value).isin(wanted), F.lit(False))


def any_of(values: Column, given: str | None) -> Column:
    """Whether any element of an array is in a comma-separated list, whatever its case."""
    wanted = _wanted(given)
    return F.lit(True) if not wanted else F.coalesce(F.exists(values, lambda v: F.lower(v).isin(wanted)), F.lit(False))


def all_words(slugged: Column, question: str | None) -> Column:
    """Whether each word of a question is in a slugged text, be it as part of a word."""
    words = slug_text(question).split()
    found = F.lit(True)
    for word in words:
        found = found & F.contains(slugged, F.lit(word))
    return found


def in_order(rows: DataFrame, by: str, date: str, start: str, name: str, village: str, confidence: str, tie: str) -> DataFrame:
    """rows by naam, dorp, betrouwbaarheid or (else) date and time; times that aren't known come last."""
    return rows.orderBy(*order_of(by, date, start, name, village, confidence), tie)


def order_of(by: str, date: str, start: str, name: str, village: str, confidence: str) -> list[Column]:
    """The columns by which in_order sorts."""
    rank = F.coalesce(*[F.when(F.col(confidence) == c, i) for i, c in enumerate(CONFIDENCE)], F.lit(-1))
    return {
        "naam": [F.lower(name)],
        "dorp": [F.lower(village), F.col(date), F.col(start).asc_nulls_last()],
        "betrouwbaarheid": [rank.desc(), F.col(date), F.col(start).asc_nulls_last()],
    }.get(by, [F.col(date), F.col(start).asc_nulls_last(), F.lower(name)])


def facets(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """facet, value: the distinct values of each column that are known; one pass, duplicates gone before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value")) for k, c in columns.items()])
    return rows.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").where("value is not null").distinct()


def missing_profile(rows: DataFrame, missing: dict[str, Column]) -> DataFrame:
    """field, missing, ordinal: how many rows lack each field, without fields that none lacks, most first."""
    counts = rows.agg(*[F.count_if(c).alias(k) for k, c in missing.items()])
    listed = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("missing"), F.lit(i).alias("ordinal")) for i, k in enumerate(missing)])
    return counts.select(F.explode(listed).alias("x")).select("x.*").where("missing > 0").orderBy(F.desc("missing"), "ordinal")


def completeness(filled: list[Column]) -> Column:
    return reduce(lambda s, c: s + c, [F.coalesce(c, F.lit(False)).cast("int") for c in filled])


def confidence(has_core: Column, has_detail: Column, conflict: Column, best_tier: Column, origins: Column) -> Column:
    """Onbekend without name or date; Bevestigd if a primary source or two origins of middling tier say so in detail; else Onzeker."""
    backed = (best_tier <= 3) | ((origins >= 2) & (best_tier <= 5))
    return F.when(~has_core, CONFIDENCE[0]).when(conflict, CONFIDENCE[1]).when(backed & has_detail, CONFIDENCE[2]).otherwise(CONFIDENCE[1])


def first_per(rows: DataFrame, keys: list[Column], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each key in the given order."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_row", row).where(F.col("_row") <= most).drop("_row")


def numbered(rows: DataFrame, keys: list[Column], order: list[Column], name: str) -> DataFrame:
    """rows with their number in each key's order, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their number in the order of the whole table, from 1.

    Rows are sorted in ranges and counted by range, so no task sees them all; what comes to the driver is one count for each range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    offset = F.get(F.array(*map(F.lit, before)), F.col("_part")) if before else F.lit(0)
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, (row + offset).cast("long")).drop("_part")


def contains_any(value: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(value, F.lit(p)) for p in parts])
