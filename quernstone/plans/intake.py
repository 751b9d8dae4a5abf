"""Registered queries on sources and on what their pages hold."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from quernstone.functions import dates
from quernstone.plans.registry import case_of, golden, query_of, table
from quernstone.sources import markup, registry, site_json, structured

FIRST, LAST = date(2026, 6, 12), date(2026, 7, 3)


def _pages(spark, bodies):
    return spark.createDataFrame([(i, "https://a.nl/agenda", b) for i, b in enumerate(bodies)], "id long, url string, body string")


ITEM = """<div itemscope itemtype="https://schema.org/MusicEvent"><h2 itemprop="name">Concert &amp; meer</h2><time itemprop="startDate" datetime="2026-06-12T20:00">vrijdag</time>
<span itemprop="location">Kerk <b>Midsland</b></span><meta itemprop="price" content="5"><a href="/concert">verder</a></div><div itemscope itemtype="Event"><p itemprop="description">naamloos</p></div>"""


@case_of(golden("id, ordinal, name, start_iso, location_name, price_text, detail_url", ["(0, 0, 'Concert & meer', '2026-06-12T20:00', 'Kerk Midsland', '5', 'https://a.nl/concert')"]))
def q_microdata(spark, sf_dir):
    return markup.microdata(_pages(spark, [ITEM, "<p>niets", None]), "id", "url", "body").select("id", "ordinal", "name", "start_iso", "location_name", "price_text", "detail_url")


CARDS = """<ul class="agenda-lijst"><li class="event"><h3>Veemarkt op het plein</h3> <p>12 juni 2026, 10.00 - 12.00 uur</p> <span class="locatie">Plein</span> <a href="/agenda/veemarkt">meer</a>
<li class="event"><h3>Concert van het koor</h3> <p>13 juni om 20.00 uur in de kerk, een avond vol muziek</p> <li class="event"><h3>Datum: 14 juni</h3> <p>14 juni</p>
<li class="event"><h3>Grote tocht langs zee</h3> 14 juni 2026</ul> <article><h2>Ander bericht van ons</h2> 15 juni</article>"""


@case_of(golden("id, place, name, start_iso, end_iso, location_name, detail_url", [
    "(0, 1, 'Veemarkt op het plein', '2026-06-12T10:00:00', NULL, 'Plein', 'https://a.nl/agenda/veemarkt')", "(0, 2, 'Concert van het koor', '2026-06-13T20:00:00', NULL, NULL, 'https://a.nl/agenda')", "(0, 3, 'Grote tocht langs zee', '2026-06-14', NULL, NULL, 'https://a.nl/agenda')",
]))
def q_dated_blocks(spark, sf_dir):
    """The article isn't read, as the first kind of blocks gives enough."""
    found = markup.dated_blocks(_pages(spark, [CARDS, "<p>zonder datum</p>", None]), "id", "url", "body", 2026)
    return found.select("id", "place", "name", "start_iso", "end_iso", "location_name", "detail_url")


@case_of(golden("id, place, link", ["(0, 1, 'https://a.nl/agenda/veemarkt')", "(0, 2, 'https://a.nl/event/tocht')"]))
def q_detail_links(spark, sf_dir):
    body = '<a href="/agenda/veemarkt">12 juni</a><a href="/AGENDA/veemarkt">12 juni</a><a href="https://b.nl/agenda/x">een lange titel</a><a href="/agenda/p.pdf">een lange titel</a><a href="event/tocht">Een lange tocht langs zee</a><a href="/contact/event">een lange titel</a><a href="/event/derde">een lange titel</a>'
    pages = _pages(spark, [body, None]).withColumn("url", F.lit("https://a.nl/"))
    return markup.detail_links(pages, "id", "url", "body", F.lit(2))


@case_of(golden("id, name, start_iso, end_iso, location_name, address, organizer, price_text, detail_url, n_categories", [
    "(0, 'Markt & meer', '2026-06-12 10:00:00', NULL, 'Plein', 'Dorpsstraat 1, Midsland', 'Dorp', '5', 'https://a.nl/markt', 1)", "(1, 'Bericht', '2026-06-13', NULL, NULL, NULL, NULL, NULL, 'https://a.nl/b', 0)",
    "(1, 'Kort', NULL, NULL, NULL, NULL, NULL, NULL, 'https://a.nl/agenda', 0)",
]))
def q_site_json(spark, sf_dir):
    tribe = '{"events": [{"title": "Markt &amp; <b>meer</b>", "start_date": "2026-06-12 10:00:00", "cost": "5", "url": "https://a.nl/markt", "venue": {"venue": "Plein", "address": "Dorpsstraat 1", "city": "Midsland"}, "organizer": [{"organizer": "Dorp"}], "categories": [{"name": "Markt"}, {"name": ""}]}, {"title": "Zonder begin", "venue": []}]}'
    posts = '[{"title": {"rendered": "Bericht"}, "content": {"rendered": "<p>tekst</p>"}, "link": "https://a.nl/b", "meta": {"event_start": "2026-06-13"}}, {"title": "Kort", "meta": []}, {"content": "naamloos"}]'
    found = site_json.site_events(_pages(spark, [tribe, posts, "{broken", '{"other": 1}', None]), "id", "url", "body")
    return found.select("id", "name", "start_iso", "end_iso", "location_name", "address", "organizer", "price_text", "detail_url", F.size("categories").alias("n_categories"))


RAW_SOURCE = "ord int, name string, homepage string, agenda_url string, agenda_urls array<string>, category string, tier string, feed_url string, feed_type string, rendering string, blocked boolean"


@case_of(golden("id, agenda_urls, category, tier, feed_type, enabled, max_detail_pages", [
    "('de-kerk', 'https://k.nl/agenda', 'kerk en gemeenschap', 2, 'ics', true, 25)", "('vvv-agenda', 'https://v.nl', 'toeristische website', 5, NULL, false, 12)", "('bron', 'https://b.nl/1|https://b.nl/2', 'overige openbare bron', 6, 'rss', true, 12)",
]))
def q_source_registry(spark, sf_dir):
    raw = [
        (0, "De Kerk!", "https://k.nl", " https://k.nl/agenda ", None, "church", "official_venue", "https://k.nl/a.ICS", None, None, None),
        (1, "Kerk", None, "https://k.nl/AGENDA", None, None, None, None, None, None, None),
        (2, "VVV agenda", "https://v.nl", "", [], "x", "unknown", None, None, "spa", True),
        (3, None, "https://n.nl", None, None, None, None, None, None, None, None),
        (4, "Bron", None, "https://b.nl/1", ["https://b.nl/2", "https://b.nl/1"], None, "social", "https://b.nl/feed", None, None, False),
        (5, "Leeg", None, None, None, None, None, None, None, None, None),
    ]
    out = registry.build_sources(spark.createDataFrame(raw, RAW_SOURCE))
    return out.select("id", F.array_join("agenda_urls", "|").alias("agenda_urls"), "category", "tier", "feed_type", "enabled", "max_detail_pages")


@case_of(golden("id, url", ["(0, 'https://a.nl/?van=2026-06-12&tot=03-07-2026&m=06')", "(0, 'https://a.nl/agenda')", "(1, 'https://b.nl')"]))
def q_addresses(spark, sf_dir):
    rows = spark.createDataFrame([(0, "https://a.nl/?van={from}&tot={toNl}&m={month}", ["https://a.nl/agenda", "https://A.nl/agenda"], "https://a.nl"), (1, None, [], "https://b.nl"), (2, "", None, None)], "id int, t string, urls array<string>, home string")
    return rows.select("id", F.explode(registry.addresses(F.col("t"), F.col("urls"), F.col("home"), FIRST, LAST)).alias("url"))


@case_of(golden("id_part, name, homepage, tier", [
    "('discovery:wwwvvvnl', 'Uit', 'https://www.vvv.nl', 4)", "('discovery:vvvterschellingnl', 'vvvterschelling.nl', 'https://vvvterschelling.nl', 3)", "('discovery:oerolfestivalorg', 'Oerol', 'https://oerolfestival.org', 1)",
]))
def q_found_sources(spark, sf_dir):
    hits = spark.createDataFrame([("https://www.vvv.nl/x", "Uit"), ("https://vvvterschelling.nl/y", " "), ("https://oerolfestival.org", "Oerol")], "url string, title string")
    return registry.found_sources(hits).select(F.substring_index("id", ":", 2).alias("id_part"), "name", "homepage", "tier")


@case_of(golden("rank, place, n, question", [
    "(0, '', 0, 'agenda eiland')", "(0, '', 1, 'agenda eiland juni 2026')", "(0, '', 2, 'agenda eiland juli 2026')", "(1, 'Hoorn', 0, 'Hoorn Terschelling agenda')", "(1, 'Hoorn', 1, 'Hoorn Terschelling markt')", "(1, 'Hoorn', 2, 'Hoorn Terschelling concert')",
    "(1, 'Hoorn', 3, 'Hoorn Terschelling film')", "(1, 'Hoorn', 4, 'Hoorn Terschelling agenda juni 2026')", "(4, 'Grote Kerk', 0, 'Grote Kerk agenda')", "(4, 'Grote Kerk', 1, 'Grote Kerk markt')",
]))
def q_questions(spark, sf_dir):
    places = spark.createDataFrame([("Grote Kerk", "venue", False, True), ("Hoorn", "dorp", True, True), ("Duinmeer", "natuurgebied", False, True), ("Kaard", "gehucht", False, False)], "name string, type string, ambiguous boolean, use_as_search_term boolean")
    return registry.questions(places, ["agenda eiland"], ["agenda", "markt", "concert", "film", "kermis"], FIRST, LAST, 4)


@case_of(golden("url, strategy, n", ["('a', 'Direct', 500)", "('b', 'AlternatePath', 401)", "('c', 'WebArchive', 450)"]))
def q_fetch_ladder(spark, sf_dir):
    now, old, young = datetime(2026, 6, 12), datetime(2026, 4, 1), datetime(2026, 5, 1)
    tried = [("a", "Direct", 200, "x" * 500, None), ("a", "Browser", 200, "x" * 900, None), ("b", "Direct", 403, "x" * 900, None), ("b", "HostVariant", 200, "x" * 400, None), ("b", "AlternatePath", 200, "x" * 401, None)]
    tried += [("c", "Direct", None, None, None), ("c", "WebArchive", 200, "x" * 450, young), ("d", "WebArchive", 200, "x" * 450, old), ("e", "Direct", 404, None, None)]
    attempts = spark.createDataFrame(tried, "url string, strategy string, status int, body string, archived_at timestamp")
    return registry.first_usable(attempts, "url", now).select("url", "strategy", F.char_length("body").alias("n"))


@case_of(golden("source, status, events", ["('a', 'ok', 2)", "('b', 'geblokkeerd', 1)", "('c', 'fout', 0)", "('d', 'leeg', 0)", "('e', 'leeg', 0)"]))
def q_outcomes(spark, sf_dir):
    attempts = spark.createDataFrame([("a", 200, None, 3), ("a", 500, "x", 0), ("b", 403, "x", 0), ("b", 200, None, 1), ("c", 500, "x", 0), ("d", 500, "x", 2), ("e", 200, None, 0)], "source string, status int, error string, raws int")
    events = spark.createDataFrame([("a",), ("a",), ("b",)], "source string")
    return registry.outcomes(attempts, events, "source")


@query_of("SELECT event_type AS strategy, count(*) AS n FROM events GROUP BY 1")
def q_strategies(spark, sf_dir):
    """How often each way of fetching was used."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"))


@case_of(golden("id, price_text, ticket_url", [
    "(0, '€ 12,5', 'https://t.nl/1')", "(1, 'Gratis', NULL)", "(2, '€ 10 – € 9', 'https://t.nl/2')", "(3, 'vanaf tien', NULL)", "(4, NULL, NULL)",
]))
def q_offers(spark, sf_dir):
    """The range of prices goes by their texts, so 10 comes before 9."""
    offers = ['{"price": 12.50, "url": "https://t.nl/1"}', '[{"price": "0"}, {"price": "0"}]', '[{"price": "9"}, {"lowPrice": "10", "url": "https://t.nl/2"}]', '{"price": "vanaf tien"}', "[]"]
    bodies = [f'<script type="application/ld+json">{{"@type": "Event", "name": "Feest", "offers": {o}}}</script>' for o in offers]
    return structured.linked_data(_pages(spark, bodies), "id", "body").select("id", "price_text", "ticket_url")


@case_of(golden('day, said, "start", "end"', [
    "(DATE '2026-06-10', 'woensdag 10 juni 2026', DATE '2026-06-12', DATE '2026-06-14')", "(DATE '2026-06-12', 'vrijdag 12 juni 2026', DATE '2026-06-12', DATE '2026-06-14')",
    "(DATE '2026-06-13', 'zaterdag 13 juni 2026', DATE '2026-06-13', DATE '2026-06-14')", "(DATE '2026-06-14', 'zondag 14 juni 2026', DATE '2026-06-14', DATE '2026-06-14')",
]))
def q_weekend(spark, sf_dir):
    days = spark.createDataFrame([(date(2026, 6, d),) for d in (10, 12, 13, 14)], "day date")
    found = dates.coming_weekend(F.col("day"))
    return days.select("day", dates.in_dutch(F.col("day")).alias("said"), found["start"].alias("start"), found["end"].alias("end"))
