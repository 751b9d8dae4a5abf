"""From what pages say to activities: one projection with gates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import dates, names, places, price
from quernstone.functions.categories import classify, with_defaults
from quernstone.functions.fixed import TIERS, UNKNOWN
from quernstone.functions.text import collapse, find_email, find_phone, is_unknown, slug
from quernstone.operators.query import completeness, overlaps
from quernstone.operators.resolve import TEXTS, identify
from quernstone.plans.steps import settle

# Fixed values. Letters that a name has at least, and signs that a source is about the island.
FEWEST_LETTERS, OWN_SOURCES = 4, "terschelling|oerol|skylge|schylge"
JOINT = " \n "


def island_source(homepage: Column, urls: Column, name: Column, default_village: Column) -> Column:
    """Whether a source is about the island by its addresses, name or village."""
    said = F.lower(F.concat_ws(" ", homepage, F.array_join(F.coalesce(urls, F.array().cast("array<string>")), " "), name))
    return said.rlike(OWN_SOURCES) | F.coalesce(F.trim(default_village) != "", F.lit(False))


def _known(*values: Column) -> Column:
    """The first text that isn't unknown, or null."""
    return F.coalesce(*[F.when(~is_unknown(v), v) for v in values])


def _joined(*texts: Column) -> Column:
    """Texts that say something, joined."""
    return F.array_join(F.filter(F.array(*texts), lambda t: F.coalesce(F.trim(t) != "", F.lit(False))), JOINT)


def normalise(raws: DataFrame, sources: DataFrame, gazetteer: places.Gazetteer, keywords: dict[str, tuple[str, ...]], year: int, now: datetime, first: date | None = None, last: date | None = None) -> DataFrame:
    """Activities from raw rows; rows without a proper name or a date, off the island or outside the days from first to last are dropped.

    raws: ord, source_id, page_url, name, date_text, start_iso, end_iso, time_text, description, location_name, address, organizer, phone, email,
    website, price_text, ticket_url, detail_url, raw_text, categories. sources: id, name, homepage, agenda_urls, tier (1 to 6),
    discovered, default_village, default_location_name, default_address, default_categories. All may hold nulls. Narrow but for the join with the
    sources, a small table that is broadcast; rows are dealt to all tasks before. The gates come as early as what they need. Rows are settled three times, so that what is found once isn't worked out again in all that is made of it.
    """
    src = sources.select(*[F.col(c).alias(f"src_{c}") for c in ("id", "name", "homepage", "agenda_urls", "tier", "discovered", "default_village", "default_location_name", "default_address", "default_categories")])
    n = int(raws.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work on each row: a shuffle by the few sources would leave a task for each of those
    rows = raws.repartition(n).join(F.broadcast(src), F.col("source_id") == F.col("src_id"))
    given = collapse(names.without_entities("name"))
    rows = rows.withColumn("name", F.when(F.char_length(given) >= FEWEST_LETTERS, names.without_noise(given)))
    rows = rows.where((F.char_length("name") >= FEWEST_LETTERS) & names.is_name(F.col("name")) & ~places.only_elsewhere(F.col("name")))

    start_day, start_at = names.read_iso(F.col("start_iso"))
    end_day, end_at = names.read_iso(F.col("end_iso"))
    span = dates.date_range(F.coalesce("date_text", "raw_text"), F.lit(year))
    clock = dates.times(F.coalesce("time_text", "raw_text"))
    read = {"_day": start_day, "_until": end_day, "_at": start_at, "_to": end_at, "_span": F.when(start_day.isNull(), span), "_clock": F.when(start_at.isNull(), clock)}
    rows = settle(rows.withColumns(read))  # what finds dates and times is long: planned once here, it isn't repeated in all that is made of it
    rows = rows.withColumns({"date": F.coalesce("_day", "_span.start"), "end_date": F.coalesce("_until", "_span.end")}).where("date is not null")
    rows = rows.withColumns({"start": F.coalesce("_at", "_clock.start"), "end": F.when(F.col("_at").isNull(), F.coalesce("_to", "_clock.end")).otherwise(F.col("_to"))}).drop(*read)
    rows = rows.withColumns(dates.sane(F.col("date"), F.col("end_date"), F.col("start"), F.col("end")))
    if first is not None:
        rows = rows.where(overlaps(F.col("date"), F.col("end_date"), first, last or first))

    rows = rows.withColumn("terms", gazetteer.find(_joined("name", "location_name", "address", "description", "raw_text")))
    rows = rows.withColumn("_in_name", gazetteer.find(F.col("name"))).where(~gazetteer.only_place(slug("name"), F.col("_in_name")))
    found = gazetteer.village(F.col("terms"))
    cleaned = {c: names.clean(F.col(c)) for c in ("description", "location_name", "address", "organizer", "phone", "email", "website", "ticket_url")}
    rows = settle(rows.withColumns({f"_{c}": v for c, v in cleaned.items()} | {"_found_address": names.clean(names.find_address(F.col("raw_text")))}))
    organizer = F.col("_organizer")
    registered = (F.col("src_tier") == 1) & ~F.coalesce("src_discovered", F.lit(False)) & names.is_organizer(F.col("src_name"))
    detail = F.coalesce("detail_url", "page_url")
    rows = rows.withColumns({
        "village": _known(found, F.col("src_default_village")),
        "_location": _known(names.once_each(F.col("_location_name")), F.col("src_default_location_name")),
        "_address": _known(names.once_each(F.col("_address")), names.once_each(F.col("_found_address")), F.col("src_default_address")),
        "_organizer": _known(F.when(names.is_organizer(organizer), organizer), F.when(registered, F.col("src_name"))),
        "_price": price.price(F.coalesce("price_text", "raw_text"), slug(F.coalesce("price_text", "raw_text"))),
        "_reservation": price.reservation(slug(F.coalesce("raw_text", "description"))),
        "primary_url": detail,
    })
    rows = rows.withColumns({"_contact": names.find_contact(F.col("raw_text")), "_phone": _known(F.col("_phone"), names.clean(find_phone(F.col("raw_text")))), "_email": _known(F.col("_email"), names.clean(find_email(F.col("raw_text"))))})
    none = F.array().cast("array<string>")
    defaults = F.coalesce("src_default_categories", none)
    rows = rows.withColumn("_said", names.slug_of(F.col("name"), F.col("_description"), F.col("_location"), F.array_join(F.coalesce("categories", none), " "), F.array_join(defaults, " ")))
    own = classify(F.col("_said"), keywords)
    out = {
        "description": F.col("_description"), "location_name": F.col("_location"), "address": F.col("_address"), "organizer": F.col("_organizer"), "contact_person": F.col("_contact"),
        "phone": F.col("_phone"), "email": F.col("_email"), "website": F.col("_website"), "price": F.col("_price.price"), "ticket_url": F.col("_ticket_url"), "village": F.col("village"),
    }
    plain = {c: F.coalesce(F.when(~is_unknown(v), v), F.lit(UNKNOWN)) for c, v in out.items()}
    method = F.col("method") if "method" in raws.columns else F.lit(None).cast("string")
    rows = rows.select(
        "ord", "name", "date", "end_date", "start", "end", *[v.alias(c) for c, v in plain.items()], F.col("_price.kind").alias("price_kind"),
        F.when((F.col("_reservation") == UNKNOWN) & (F.trim("ticket_url") != ""), "Ja").otherwise(F.col("_reservation")).alias("reservation"),
        F.when(F.size(defaults) > 0, with_defaults(own, defaults)).otherwise(own).alias("categories"), "terms", "primary_url", F.lit(1).cast("long").alias("duplicate_count"),
        F.array(F.struct("source_id", F.col("src_name").alias("source_name"), F.col("src_tier").cast("int").alias("tier"), F.col("primary_url").alias("url"))).alias("sources"),
        method.alias("method"), F.lit(now).alias("checked_at"), "page_url", "raw_text", island_source(F.col("src_homepage"), F.col("src_agenda_urls"), F.col("src_name"), F.col("src_default_village")).alias("_island"),
    )
    rows = settle(rows)  # else the gate's expressions, that is all of them, are worked out twice
    hay = F.concat_ws(JOINT, "name", "description", "location_name", "address", "village", "raw_text", "page_url")
    rows = rows.where(gazetteer.on_island(hay, F.col("page_url"), F.col("_island"))).drop("_island", "page_url", "raw_text")
    filled = [~is_unknown(F.col(c)) for c in ("name", *TEXTS)] + [F.col(c).isNotNull() for c in ("date", "start", "end")] + [F.col("price_kind") != UNKNOWN, F.col("reservation") != UNKNOWN, F.size("categories") > 0]
    return identify(rows.withColumn("completeness", completeness(filled)))


def tier_number(tier: Column) -> Column:
    """1 for the most trusted tier to 6, by name; 5 for names that aren't known."""
    return F.coalesce(*[F.when(tier == t, i) for i, t in enumerate(TIERS, 1)], F.lit(5))
