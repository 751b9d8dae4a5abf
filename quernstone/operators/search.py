"""From recorded payloads and registries to answered activities: the whole way in one plan."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import places
from quernstone.operators import answer, resolve
from quernstone.operators.normalise import normalise
from quernstone.plans.steps import settle
from quernstone.sources import intake
from quernstone.sources.health import reachable

# Fixed values. What is said of activities that only an archived page tells of.
ARCHIVED, CURRENCY, ARCHIVE = "webarchief", "Actualiteit", "WebArchive"


def _details(own: DataFrame, recorded: DataFrame, raws: DataFrame, sources: DataFrame, year: int) -> DataFrame:
    """What the pages of single activities say that the pages of sources lead to: raw rows with listing, link, source_id, page_url and archived_at. A page that two sources lead to is read once and told by both."""
    most = F.coalesce("max_detail_pages", F.lit(intake.MOST_DETAILS)) if "max_detail_pages" in sources.columns else F.lit(intake.MOST_DETAILS)
    form = intake.format_of(F.col("content_type"), F.col("body"), F.col("strategy"), F.col("feed_type"), F.col("is_feed"))
    pages = own.where(form == "html").join(F.broadcast(sources.select(F.col("id").alias("source_id"), most.cast("int").alias("most"))), "source_id")
    links = settle(intake.links_to_follow(pages, raws, "most"))
    found = settle(intake.with_details(pages, links, recorded.drop("selector_hint")))
    read = settle(intake.raw_rows(found.withColumns({"content_type": F.lit("text/html"), "feed_type": F.lit(None).cast("string"), "is_feed": F.lit(False)}), year))
    leads = links.select(F.col("id").alias("listing"), F.col("place").alias("link"), F.lower("link").alias("_url")).join(own.select(F.col("id").alias("listing"), "source_id"), "listing")
    leads = leads.groupBy("_url", "source_id").agg(F.min(F.struct("listing", "link")).alias("x")).select("_url", "source_id", "x.*")
    of = found.select(F.col("id").alias("payload"), F.col("url").alias("page_url"), F.lower("url").alias("_url"), F.lit(None).cast("timestamp").alias("archived_at"))
    return read.join(of.join(leads, "_url").drop("_url"), "payload")


def collected(payloads: DataFrame, sources: DataFrame, gazetteer: places.Gazetteer, keywords: dict[str, tuple[str, ...]], now: datetime, first: date, last: date, health: DataFrame | None = None) -> DataFrame:
    """Activities of payloads before any are merged: read, normalised, on the island and within the days asked for.

    payloads: id (long, unique, the order of arrival), source_id, url, content_type, body, strategy, feed_type, is_feed, archived_at. A page that was had from an archive marks its activities.
    Payloads without a source are recorded pages, which are read if a source's page leads to them. Sources that are switched off (enabled) and hosts that are to be skipped
    (health: host, skip) are left out. Rows are numbered in order of arrival, those of a page that is led to after those of the page that leads there.
    """
    sources = intake.enabled(sources)
    asked = payloads if health is None else reachable(payloads, "url", health)
    hint = F.col("selector_hint") if "selector_hint" in sources.columns else F.lit(None).cast("string")
    own, recorded = asked.drop("selector_hint").join(F.broadcast(sources.select(F.col("id").alias("source_id"), hint.alias("selector_hint"))), "source_id"), asked.where("source_id is null")
    raws = settle(intake.raw_rows(own, first.year))  # so that the normaliser is planned once and not for each reader
    of = own.select(F.col("id").alias("payload"), "source_id", F.col("url").alias("page_url"), F.when(F.col("strategy") == ARCHIVE, F.coalesce("archived_at", F.lit(now).cast("timestamp"))).alias("archived_at"))
    rows = raws.join(of, "payload").withColumns({"listing": F.col("payload"), "link": F.lit(0)})
    if not recorded.isEmpty():
        rows = rows.unionByName(_details(own, recorded, raws, sources, first.year))
    rows = answer.query.ranked(rows, [F.col("listing"), F.col("link"), F.col("payload"), F.col("source_id"), F.col("place")], "ord")
    seen = rows.select("ord", "archived_at")
    events = settle(normalise(rows.drop("payload", "place", "archived_at", "listing", "link"), sources, gazetteer, keywords, first.year, now, first, last))
    return events.join(seen, "ord")


def with_archive_doubts(resolved: DataFrame, collected_: DataFrame) -> DataFrame:
    """resolved with a conflict about Actualiteit for activities that were not merged and come from an archived page, as the page may be out of date."""
    stamped = resolved.join(collected_.where("archived_at is not null").select("ord", "archived_at"), "ord", "left")
    note = F.struct(F.lit(CURRENCY).alias("field"), F.concat(F.lit("Momentopname van "), F.date_format("archived_at", "yyyy-MM-dd")).alias("chosen"), F.array().cast("array<string>").alias("rejected"), F.lit(False).alias("resolved"), F.lit(True).alias("affects"))
    kind = resolved.schema["conflicts"].dataType
    doubted = F.col("archived_at").isNotNull() & (F.col("duplicate_count") == 1)
    more = F.concat(F.coalesce("conflicts", F.array().cast(kind)), F.array(note).cast(kind))
    return stamped.withColumn("conflicts", F.when(doubted, more).otherwise(F.col("conflicts"))).drop("archived_at")


def search(
    payloads: DataFrame, sources: DataFrame, gazetteer: places.Gazetteer, keywords: dict[str, tuple[str, ...]], now: datetime, question: answer.Question, health: DataFrame | None = None
) -> DataFrame:
    """What payloads say, resolved and graded, as far as the question asks for it and in its order. Tables are settled between the steps."""
    first, last = answer.query.parse_range(question.first, question.last, now.date())
    found = settle(collected(payloads, sources, gazetteer, keywords, now, first, last, health))
    events = resolve.resolve(found.drop("archived_at"))
    return answer.answer(answer.graded(with_archive_doubts(events, found)), question, now.date())


def ask(events: DataFrame, question: answer.Question, today: date) -> DataFrame:
    """The same question of the activities that a run before has stored."""
    return answer.answer(events, question, today)
