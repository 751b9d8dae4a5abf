"""Questions asked of resolved activities, and what a report says about a run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.categories import ORDER
from quernstone.functions.text import is_unknown, slug
from quernstone.operators import query
from quernstone.operators.resolve import NO_TIER, tier_of, websites

# Fixed values. Kinds of prices that can be asked for, organizers that are offered, and how statuses of sources count.
PRICE_KINDS = ("gratis", "betaald", "onbekend")
MOST_ORGANIZERS, FINE, FAILED = 200, ("ok", "leeg"), ("fout", "geblokkeerd")
# Fixed values. What the report looks for in each activity, in order, and the column that tells.
CHECKED = {
    "Starttijd": "start", "Eindtijd": "end", "Beschrijving": "description", "Dorp/plaats": "village", "Locatie": "location_name", "Adres": "address", "Organisator": "organizer",
    "Contactpersoon": "contact_person", "Telefoonnummer": "phone", "E-mailadres": "email", "Website": "website", "Prijs": "price_kind", "Reserveren": "reservation", "Ticketlink": "ticket_url",
}
TIMES = ("start", "end")
SEARCHED = ("name", "description", "location_name", "address", "organizer", "village")


@dataclass(frozen=True)
class Question:
    """What is asked of the activities: days, comma-separated lists, words, and an order. Blank and * stand for anything."""

    first: date | None = None
    last: date | None = None
    village: str | None = None
    category: str | None = None
    price: str | None = None
    text: str | None = None
    confidence: str | None = None
    reservation: str | None = None
    order: str | None = None


def price_is(kind: Column, wanted: str | None) -> Column:
    """Whether a kind of price is the wanted one; what is no kind asks for nothing."""
    asked = (wanted or "").lower()
    return F.coalesce(F.lower(kind) == asked, F.lit(False)) if asked in PRICE_KINDS else F.lit(True)


def equals(value: Column, wanted: str | None) -> Column:
    """Whether a value is the wanted one, whatever its case; any is if none is wanted."""
    return F.coalesce(F.lower(value) == wanted.lower(), F.lit(False)) if wanted and wanted.strip() and wanted != "*" else F.lit(True)


def answer(events: DataFrame, question: Question, today: date) -> DataFrame:
    """The activities that a question asks for, in its order."""
    first, last = query.parse_range(question.first, question.last, today)
    said = F.concat_ws(" ", *SEARCHED, F.array_join("categories", " "))
    fits = (
        query.overlaps(F.col("date"), F.col("end_date"), first, last) & query.one_of(F.col("village"), question.village) & query.any_of(F.col("categories"), None if question.category == "*" else question.category)
        & price_is(F.col("price_kind"), question.price) & query.one_of(F.col("confidence"), question.confidence) & equals(F.col("reservation"), question.reservation)
    )
    if question.text and question.text.strip():
        fits = fits & query.all_words(slug(said), question.text)
    return query.in_order(events.where(fits), question.order or "", "date", "start", "name", "village", "confidence", "id")


def graded(events: DataFrame) -> DataFrame:
    """events with confidence: by their best source, their independent websites, what is known, and contradictions that are open."""
    known = lambda c: ~is_unknown(F.col(c))
    none = F.array().cast(events.schema["conflicts"].dataType)
    doubt = F.exists(F.coalesce("conflicts", none), lambda c: ~F.coalesce(c["resolved"], F.lit(False)) & F.coalesce(c["affects"], F.lit(True)))
    count = F.size(websites(F.col("sources")))
    origins = F.when((count == 0) & (F.size("sources") > 0), 1).otherwise(count)
    best = F.when(F.size("sources") > 0, tier_of(F.col("sources"))).otherwise(NO_TIER)
    detail = F.col("start").isNotNull() | known("location_name") | known("village")
    return events.withColumn("confidence", query.confidence(F.col("date").isNotNull() & known("name"), detail, doubt, best, origins))


def unverified(events: DataFrame) -> DataFrame:
    """field, missing, total: how often each of the CHECKED fields isn't known, most often first; fields that never lack and empty tables give no row."""
    missing = {k: F.col(c).isNull() if c in TIMES else is_unknown(F.col(c)) for k, c in CHECKED.items()}
    total = F.count("*").alias("total")
    counts = events.agg(total, *[F.count_if(c).alias(k) for k, c in missing.items()])
    listed = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"`{k}`").alias("missing"), F.lit(i).alias("ordinal")) for i, k in enumerate(missing)])
    return counts.select("total", F.explode(listed).alias("x")).select("x.*", "total").where("missing > 0").orderBy(F.desc("missing"), "ordinal")


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """key and n, the number of its rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """One row with a map of each value of key to the number of its rows; nulls don't count."""
    entries = F.collect_list(F.struct(key, "n"))
    return counts_by(rows.where(F.col(key).isNotNull()), key).agg(F.map_from_entries(F.array_sort(entries)).alias("histogram"))


def tally(rows: DataFrame, column: str, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row that counts the rows whose column is in each group, and all rows."""
    return rows.agg(*[F.count_if(F.col(column).isin(*values)).cast("long").alias(k) for k, values in groups.items()], F.count("*").alias("total"))


def listed(rows: DataFrame, value: Column) -> DataFrame:
    """value: its distinct texts that say something, in order."""
    return rows.select(value.alias("value")).where(F.trim("value") != "").distinct().orderBy("value")


def report(events: DataFrame, sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row that tells of a run: how many activities of each confidence and how many were merged, what they lack, how sources fared, and the ways that pages were had.

    events are graded; sources: name, category, status, error; attempts: strategy. Each part is an aggregate of its own and has one row; they are put side by side.
    """
    graded_ = {"confirmed": ("Bevestigd",), "uncertain": ("Onzeker",), "unknown": ("Onbekend",)}
    merged = events.agg(F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)).alias("merged"))
    lacking = unverified(events).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("missing")).alias("n"), "ordinal", "field"))), lambda x: F.struct(x["field"].alias("field"), (-x["n"]).alias("missing"))).alias("unverified"))
    failed = sources.where(F.col("status").isin(*FAILED)).select(F.concat(F.col("name"), F.lit(" — "), F.coalesce("error", "status")).alias("value"))
    in_order = lambda rows, name: rows.where(F.trim("value") != "").distinct().agg(F.array_sort(F.collect_list("value")).alias(name))
    parts = [
        tally(events, "confidence", graded_).withColumnRenamed("total", "unique_events"), merged, lacking, tally(sources, "status", {"sources_ok": FINE, "sources_failed": FAILED}).withColumnRenamed("total", "sources_total"),
        in_order(failed, "unreachable"), in_order(sources.select(F.col("category").alias("value")), "source_types"), histogram(attempts, "strategy").withColumnRenamed("histogram", "fetch_strategies"),
    ]
    one = [p.withColumn("_run", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_run"), one).drop("_run")


def facets(events: DataFrame) -> DataFrame:
    """facet, place, value: villages and organizers in order of their names (MOST_ORGANIZERS at most, as the feature has it), categories in theirs."""
    known = lambda c: F.when(~is_unknown(F.col(c)), F.col(c))
    many = F.array(F.struct(F.lit("village").alias("facet"), known("village").alias("value")), F.struct(F.lit("organizer").alias("facet"), known("organizer").alias("value")))
    categories = F.transform("categories", lambda c: F.struct(F.lit("category").alias("facet"), c.alias("value")))
    found = events.select(F.explode(F.concat(many, categories)).alias("x")).select("x.*").where("value is not null").distinct()
    rank = F.when(F.col("facet") == "category", F.array_position(F.array(*map(F.lit, ORDER)), F.col("value"))).otherwise(0)
    placed = query.numbered(found, [F.col("facet")], [rank, F.col("value")], "place")
    return placed.where((F.col("facet") != "organizer") | (F.col("place") <= MOST_ORGANIZERS)).select("facet", "place", "value")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources with place: by tier and then name, with ties by id."""
    return query.ranked(sources, [F.col("tier"), F.col("name"), F.col("id")], "place")


def source_named(sources: DataFrame, wanted: str) -> DataFrame:
    """The first source whose id is wanted or whose name has it, whatever their case; no row if there is none."""
    fits = (F.lower("id") == wanted.lower()) | F.contains(F.lower("name"), F.lit(wanted.lower()))
    return sources.where(fits).orderBy("ord").limit(1)


def rounded(value: Column, digits: int = 0) -> Column:
    """Rounded, halves to the even neighbour."""
    return F.bround(value, digits)


def clamped(value: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(value, F.lit(least)), F.lit(most))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def as_json(rows: DataFrame) -> DataFrame:
    """json: each row as an object with names in camel case; what is null is left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`").alias(camel(c)) for c in rows.columns])).alias("json"))


