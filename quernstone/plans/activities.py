"""Registered queries on activities: places, names, the normaliser and entity resolution, on small fixtures and on the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quernstone.functions import names, places
from quernstone.operators import normalise, resolve
from quernstone.plans.registry import case_of, fixture, golden, query_of, table

GAZETTEER = places.Gazetteer([
    places.Place("West-Terschelling", "dorp", None, ("West-Skylge",)), places.Place("Midsland", "dorp"), places.Place("Hoorn", "dorp", None, (), True), places.Place("Kaard", "buurtschap"),
    places.Place("Grote Kerk", "venue", "midsland"), places.Place("Duinmeer", "natuurgebied"),
])
KEYWORDS = {"Muziek": ("concert", "koor"), "Markt": ("markt",), "Festival": ("festival",), "Kinderen": ("kinder",)}
SAID = ["Concert in Midsland", "Tocht vanaf west-skylge naar Kaard", "Feest in de Grote Kerk", "Duinmeer", "Markt op Texel", "Markt te Hoorn", "Oerol, niet op Texel", "Midslander weg", ""]


@case_of(golden("id, terms, village", [
    "(0, 'Midsland', 'Midsland')", "(1, 'West-Terschelling,Kaard', 'West-Terschelling')", "(2, 'Grote Kerk', 'Midsland')", "(3, 'Duinmeer', 'Onbekend')", "(4, '', 'Onbekend')", "(5, 'Hoorn', 'Hoorn')",
    "(6, '', 'Onbekend')", "(7, '', 'Onbekend')", "(8, '', 'Onbekend')",
]))
def q_gazetteer(spark, sf_dir):
    hits = fixture(spark, SAID).select("id", GAZETTEER.find(F.col("text")).alias("hits"))
    return hits.select("id", F.array_join("hits", ",").alias("terms"), GAZETTEER.village(F.col("hits")).alias("village"))


@case_of(golden("id, here, by_source, elsewhere", [
    "(0, true, true, false)", "(1, true, true, false)", "(2, true, true, false)", "(3, false, true, false)", "(4, false, false, true)", "(5, false, true, false)", "(6, true, true, false)", "(7, false, true, false)", "(8, false, true, false)",
]))
def q_geo_gate(spark, sf_dir):
    """Hoorn is no sign by itself, as other places have that name."""
    given, url = F.col("text"), F.lit("https://a.nl/x")
    return fixture(spark, SAID).select("id", GAZETTEER.on_island(given, url, F.lit(False)).alias("here"), GAZETTEER.on_island(given, url, F.lit(True)).alias("by_source"), places.only_elsewhere(given).alias("elsewhere"))


@query_of("SELECT c_custkey, CASE WHEN n_name IS NULL THEN '' ELSE n_name END AS terms FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def q_gazetteer_nations(spark, sf_dir):
    """Nations as a gazetteer, found in a text that names one."""
    nations = table(spark, sf_dir, "nation")
    found = places.Gazetteer.of(nations.select(F.col("n_name").alias("name"), F.lit("dorp").alias("type"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("variants"), F.lit(False).alias("ambiguous")))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    said = F.concat(F.lit("Feest ("), F.lower(F.coalesce("n_name", F.lit(""))), F.lit("), welkom"))
    return rows.select("c_custkey", F.array_join(found.find(said), ",").alias("terms"))


@case_of(golden("id, name, fits", [
    "(0, 'Veemarkt', true)", "(1, 'Lees meer over ons', false)", "(2, 'zaterdag 12 juni 2026', false)", "(3, 'Concert', true)", "(4, '2026Tijd: 14.30', false)", "(5, 'Wandeling 3', true)",
]))
def q_name_gate(spark, sf_dir):
    said = ["Agenda: Veemarkt | VVV", "Lees meer over ons", "zaterdag 12 juni 2026", "  «Concert» ", "2026Tijd: 14.30", "Wandeling 3"]
    rows = fixture(spark, said).select("id", names.without_noise(F.col("text")).alias("name"))
    return rows.select("id", "name", names.is_name(F.col("name")).alias("fits"))


@case_of(golden("id, address, contact, listed, organizer", [
    "(0, 'Kerkstraat 12, 8881 AB', CAST(NULL AS VARCHAR), 'kom naar de Kerkstraat 12 te 8881 AB Midsland', true)", "(1, NULL, 'Jan Vries', 'contact: Jan Vries', true)", "(2, NULL, NULL, 'Midsland, Kerk', true)", "(3, NULL, NULL, 'Agenda 2026', false)", "(4, NULL, NULL, '', false)",
]))
def q_text_finders(spark, sf_dir):
    said = ["kom naar de Kerkstraat 12 te 8881 AB Midsland", "contact: Jan Vries", "Midsland, Kerk, midsland", "Agenda 2026", ""]
    t = F.col("text")
    return fixture(spark, said).select("id", names.find_address(t).alias("address"), names.find_contact(t).alias("contact"), names.once_each(t).alias("listed"), names.is_organizer(t).alias("organizer"))


@case_of(golden("id, day, minutes", ["(0, DATE '2026-09-11', CAST(NULL AS INT))", "(1, DATE '2026-09-11', 1200)", "(2, DATE '2026-09-11', 0)", "(3, NULL, NULL)", "(4, NULL, NULL)", "(5, DATE '2026-09-11', 1200)"]))
def q_iso(spark, sf_dir):
    day, minutes = names.read_iso(F.col("text"))
    return fixture(spark, ["2026-09-11", "2026-09-11T20:00:00+02:00", "2026-09-11T00:00:00", "11 september", "2026-02-31", "2026-09-11 20:00"]).select("id", day.alias("day"), minutes.alias("minutes"))


RAW = "ord long, source_id string, page_url string, name string, date_text string, start_iso string, end_iso string, time_text string, description string, location_name string, address string, organizer string, phone string, email string, website string, price_text string, ticket_url string, detail_url string, raw_text string, categories array<string>"
SOURCE = "id string, name string, homepage string, agenda_urls array<string>, tier int, discovered boolean, default_village string, default_location_name string, default_address string, default_categories array<string>"
SOURCES = [
    ("koor", "Het Koor", "https://koor-terschelling.nl", ["https://koor-terschelling.nl/agenda"], 1, False, None, None, None, ["Muziek"]),
    ("kalender", "Kalender", "https://kalender.nl", [], 5, False, None, None, None, None),
    ("hoorn", "Dorpshuis", "https://dorpshuis.nl", [], 2, False, "Hoorn", "Dorpshuis Hoorn", "Dorpsstraat 1", []),
]


def _raw(ord_, source_id, name, **more):
    empty = dict.fromkeys(c.split(" ")[0] for c in RAW.split(", "))
    return empty | {"ord": ord_, "source_id": source_id, "page_url": f"https://{source_id}.nl/agenda/{ord_}", "name": name} | more


RAWS = [
    _raw(0, "koor", "Concert bij kaarslicht", start_iso="2026-06-12T20:00:00+02:00", location_name="Grote Kerk, grote kerk", price_text="€ 12,50", description="Koor zingt &amp; speelt", raw_text="contact: Jan Vries, tel 0562 123456"),
    _raw(1, "kalender", "Concert bij kaarslicht", date_text="12 juni", raw_text="Concert bij kaarslicht in Midsland om 20.15 uur, gratis", organizer="Evenementen 2026"),
    _raw(2, "kalender", "Markt op Texel", date_text="13 juni", raw_text="Terschelling doet mee"),
    _raw(3, "kalender", "Rommelmarkt", date_text="13 juni", raw_text="ergens in het land"),
    _raw(4, "hoorn", "Kindermiddag", start_iso="2026-06-13", end_iso="2026-06-15", raw_text="vrije inloop"),
    _raw(5, "hoorn", "Kindermiddag", start_iso="2026-06-14T14:00", raw_text="aanmelden bij Piet", ticket_url="https://dorpshuis.nl/t"),
    _raw(6, "hoorn", "Dorpshuis Hoorn", start_iso="2026-06-14"),
    _raw(7, "hoorn", "Lees meer", start_iso="2026-06-14"),
    _raw(8, "hoorn", "Zonder datum"),
    _raw(9, "weg", "Onbekende bron", start_iso="2026-06-14"),
]


def activities(spark):
    raws = spark.createDataFrame(RAWS, RAW)
    return normalise.normalise(raws, spark.createDataFrame(SOURCES, SOURCE), GAZETTEER, KEYWORDS, 2026, datetime(2026, 6, 1))


@case_of(golden('ord, name, date, end_date, "start", village, location_name, address, organizer, contact_person, phone, price, price_kind, reservation, categories, description', [
    "(0, 'Concert bij kaarslicht', DATE '2026-06-12', CAST(NULL AS DATE), 1200, 'Midsland', 'Grote Kerk', 'Onbekend', 'Het Koor', 'Jan Vries', '0562 123456', '€ 12,50', 'Betaald', 'Onbekend', 'Muziek', 'Koor zingt & speelt')",
    "(1, 'Concert bij kaarslicht', DATE '2026-06-12', NULL, 1215, 'Midsland', 'Onbekend', 'Onbekend', 'Onbekend', 'Onbekend', 'Onbekend', 'Gratis', 'Gratis', 'Onbekend', 'Muziek', 'Onbekend')",
    "(4, 'Kindermiddag', DATE '2026-06-13', DATE '2026-06-15', NULL, 'Hoorn', 'Dorpshuis Hoorn', 'Dorpsstraat 1', 'Onbekend', 'Onbekend', 'Onbekend', 'Onbekend', 'Onbekend', 'Nee', 'Kinderen,Familie', 'Onbekend')",
    "(5, 'Kindermiddag', DATE '2026-06-14', NULL, 840, 'Hoorn', 'Dorpshuis Hoorn', 'Dorpsstraat 1', 'Onbekend', 'Piet', 'Onbekend', 'Onbekend', 'Onbekend', 'Ja', 'Kinderen,Familie', 'Onbekend')",
]))
def q_normalise(spark, sf_dir):
    kept = ("ord", "name", "date", "end_date", "start", "village", "location_name", "address", "organizer", "contact_person", "phone", "price", "price_kind", "reservation", "description")
    return activities(spark).select(*kept, F.array_join("categories", ",").alias("categories"))


@case_of(golden('ord, name, date, "start", reservation, duplicate_count, n_sources, n_conflicts', [
    "(0, 'Concert bij kaarslicht', DATE '2026-06-12', 1200, 'Onbekend', 2, 2, 2)", "(4, 'Kindermiddag', DATE '2026-06-13', 840, 'Nee', 2, 2, 0)",
]))
def q_resolve(spark, sf_dir):
    """From raw rows to the different activities: normalised, grouped, merged, days taken in."""
    out = resolve.resolve(activities(spark))
    return out.select("ord", "name", "date", "start", "reservation", "duplicate_count", F.size("sources").alias("n_sources"), F.coalesce(F.size(F.coalesce("conflicts", F.array().cast(out.schema["conflicts"].dataType))), F.lit(0)).alias("n_conflicts"))


def _markets(spark, sf_dir):
    """Orders as markets of their customers' segments, at the minute that their keys give. On every fifth day they are told in the ways that resolution is for: names with more words or the village, villages
    and starts that aren't known, pages of a customer in two languages, places and organizers."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey"), "o_custkey")
    k, day, none = F.col("o_orderkey"), F.to_date("o_orderdate"), F.lit(None).cast("string")
    odd = F.coalesce(F.unix_date(day) % 5 == 0, F.lit(False))
    source = F.struct(F.col("o_orderpriority").alias("source_id"), none.alias("source_name"), (k % 6 + 1).cast("int").alias("tier"), none.alias("url"))
    return rows.select(
        k.alias("ord"), day.alias("date"), F.concat_ws(" ", "c_mktsegment", F.lit("market"), F.when(odd & (k % 8 == 1), "for clerks").when(odd & (k % 8 == 2), F.col("o_orderpriority"))).alias("name"),
        F.when(odd, F.concat(F.lit("https://markt.nl/"), F.when(k % 2 == 0, "nl").otherwise("en"), F.lit("/klanten/"), F.col("o_custkey").cast("string"))).alias("primary_url"), (k % 5 + 1).cast("int").alias("completeness"),
        F.when(~odd | (k % 16 != 3), k % 1440).cast("int").alias("start"), F.when(~odd | (F.col("o_orderpriority") != "4-NOT SPECIFIED"), F.col("o_orderpriority")).alias("village"),
        F.when(odd & (k % 4 == 0), F.concat_ws(" ", F.lit("Hal"), "c_nationkey")).alias("location_name"), F.when(odd & (k % 4 == 2), F.concat_ws(" ", F.lit("Kade"), "c_nationkey")).alias("address"), F.when(odd & (k % 4 == 1), F.col("c_name")).alias("organizer"),
        F.array(source).alias("sources"),
    )


@query_of()
def q_buckets(spark, sf_dir):
    """Markets grouped into the different ones by date, name, village, start, page and place; too slow as SQL on whole tables, so tests hold buckets against the sequential procedure."""
    return resolve.buckets(_markets(spark, sf_dir)).select("ord", "bucket")


@case_of(golden("id, n", ["(0, 1)", "(1, 2)", "(2, 0)"]))
def q_websites(spark, sf_dir):
    """Independent websites: pages of one host are one, and so are hosts that one registered source names."""
    given = [(0, [("discovery:a-nl:1", "https://www.a.nl/x"), ("a", "https://a.nl/y")]), (1, [("a", "https://a.nl"), ("b", "https://b.nl"), ("B ", "https://c.nl")]), (2, [(None, None)])]
    rows = spark.createDataFrame(given, "id int, sources array<struct<source_id: string, url: string>>")
    return rows.select("id", F.size(resolve.websites(F.col("sources"))).alias("n"))
