"""From recorded payloads of any format to raw rows of activities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.query import first_per
from quernstone.sources import calendar, markup, site_json, structured

#: Columns of raw rows beside payload, place and method.
TEXTS = (
    "name", "date_text", "start_iso", "end_iso", "time_text", "description", "location_name", "address", "organizer", "phone", "email", "website", "price_text", "ticket_url", "detail_url", "raw_text",
)
#: Ways to read a page, in order; a raw row's place in its payload goes by way and ordinal.
METHODS = ("ics", "rss", "json", "jsonld", "microdata", "html")
#: Places that each way has for its rows.
PER_METHOD = 1 << 40
# Fixed values. Activities of a page with pages of their own from which its other links aren't followed, and pages that are followed where a source doesn't tell.
ENOUGH_LINKS, MOST_DETAILS = 3, 25


def format_of(content_type: Column, body: Column, strategy: Column, feed_type: Column, is_feed: Column) -> Column:
    """ics, rss, json or html: feeds by what they are registered as or begin with, pages by their type and beginning."""
    kind, text = F.coalesce(content_type, F.lit("")), F.coalesce(body, F.lit(""))
    says = lambda part: F.contains(kind, F.lit(part))
    calendar_in = text.rlike("(?i)BEGIN:VCALENDAR")
    feed = F.when(F.lower(feed_type) == "ics", "ics").when(F.lower(feed_type).isin("rss", "atom"), "rss").otherwise(F.when(calendar_in, "ics").otherwise("rss"))
    page = (
        F.when(says("calendar") | text.rlike(r"(?i)\ABEGIN:VCALENDAR"), "ics")
        .when((says("xml") | says("rss")) & ~says("html"), "rss")
        .when(says("json") | ((strategy == "AlternatePath") & text.rlike(r"\A\s*\[")), "json")
        .otherwise("html")
    )
    return F.when(F.coalesce(is_feed, F.lit(False)), feed).otherwise(page)


def _shaped(rows: DataFrame, method: str, id_col: str) -> DataFrame:
    has = set(rows.columns)
    texts = [(F.col(c) if c in has else F.lit(None).cast("string")).alias(c) for c in TEXTS]
    categories = F.col("categories") if "categories" in has else F.array().cast("array<string>")
    place = F.col("ordinal" if "ordinal" in has else "place").cast("long") + F.lit(METHODS.index(method) * PER_METHOD)
    return rows.select(F.col(id_col).cast("long").alias("payload"), place.alias("place"), F.lit(method).alias("method"), *texts, categories.alias("categories"))


def raw_rows(payloads: DataFrame, year: int) -> DataFrame:
    """Raw rows (payload, place, method, TEXTS, categories) of payloads (id, url, content_type, body, strategy, feed_type, is_feed, and selector_hint if sources give any).

    Each payload goes to the reader of its format, pages to all three readers of markup. Nulls and what can't be read give no row.
    """
    hint = F.col("selector_hint") if "selector_hint" in payloads.columns else F.lit(None).cast("string")
    rows = payloads.select("id", "url", "body", hint.alias("hint"), format_of(F.col("content_type"), F.col("body"), F.col("strategy"), F.col("feed_type"), F.col("is_feed")).alias("format"))
    of = lambda f: rows.where(F.col("format") == f).drop("format")
    pages = of("html")
    found = [
        _shaped(calendar.read_calendar(of("ics"), "body").withColumn("raw_text", F.concat_ws(markup.JOINT, "name", "description", "location_name", "organizer")), "ics", "id"),
        _shaped(structured.feed_items(of("rss"), "id", "body").withColumn("raw_text", F.concat_ws(markup.JOINT, "name", "description")), "rss", "id"),
        _shaped(site_json.site_events(of("json"), "id", "url", "body"), "json", "id"),
        _shaped(structured.linked_data(pages, "id", "body", "url"), "jsonld", "id"),
        _shaped(markup.microdata(pages, "id", "url", "body"), "microdata", "id"),
        _shaped(markup.dated_blocks(pages, "id", "url", "body", year, "hint"), "html", "id"),
    ]
    return reduce(DataFrame.unionByName, found)


def links_to_follow(pages: DataFrame, raws: DataFrame, most: str) -> DataFrame:
    """id, place, link: the pages of single activities to read for each page (id, url, body and a column most).

    The activities found on a page name their own pages; if they name less than ENOUGH_LINKS, the page's other links that look like such pages follow. Each once
    whatever its case, and never the page itself.
    """
    named = raws.join(pages.select(F.col("id").alias("payload"), F.col("url").alias("_page")), "payload")
    named = named.where((F.trim("detail_url") != "") & (F.lower("detail_url") != F.lower("_page")))
    own = named.groupBy("payload", F.lower("detail_url").alias("_key")).agg(F.min(F.struct("place", "detail_url")).alias("x")).select(F.col("payload").alias("id"), "x.place", F.col("x.detail_url").alias("link"))
    enough = own.groupBy("id").count().where(F.col("count") >= ENOUGH_LINKS)
    other = markup.detail_links(pages.join(enough, "id", "left_anti"), "id", "url", "body", F.lit(markup.MOST_BLOCKS))
    both = own.withColumn("turn", F.lit(0)).unionByName(other.select("id", F.col("place").cast("long").alias("place"), "link").withColumn("turn", F.lit(1)))
    once = first_per(both.join(pages.select("id", F.col("url").alias("_page"), most), "id").where(F.lower("link") != F.lower("_page")), [F.col("id"), F.lower("link")], [F.col("turn"), F.col("place")])
    order = F.row_number().over(markup.Window.partitionBy("id").orderBy("turn", "place"))
    return once.withColumn("place", order).where(F.col("place") <= F.col(most)).select("id", "place", "link")


def enabled(sources: DataFrame) -> DataFrame:
    """The sources that aren't switched off; all if none can be."""
    return sources.where(F.coalesce("enabled", F.lit(True))) if "enabled" in sources.columns else sources


def with_details(pages: DataFrame, links: DataFrame, payloads: DataFrame) -> DataFrame:
    """The payloads of the linked pages: links (id, link) joined to payloads (url, ...), each payload once however many pages lead to it."""
    wanted = links.select(F.lower("link").alias("_link")).distinct()
    read = payloads.join(pages.select("id"), "id", "left_anti")
    return read.join(wanted, F.lower("url") == F.col("_link"), "left_semi")
