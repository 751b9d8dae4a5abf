"""Registered queries that write texts and payloads from the driver's tables and read them back; their SQL tells from the tables what must come out."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import categories, dates, names, price
from quernstone.functions.text import slug
from quernstone.operators import resolve
from quernstone.plans.registry import query_of, spread, table
from quernstone.sources import calendar, intake, markup, pages, registry, site_json, structured

_MONTHS = "['" + "', '".join(dates.MONTH_NAMES) + "']"
_DAYS = "['" + "', '".join(dates.DAYS) + "']"


def _one(key: Column, *choices: Column | str) -> Column:
    """The choice that a key's remainder names."""
    return F.get(F.array(*[c if isinstance(c, Column) else F.lit(c) for c in choices]), (key % len(choices)).cast("int"))


def _said(day: Column) -> Column:
    """A day as 12 juni 1996."""
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.get(F.array(*map(F.lit, dates.MONTH_NAMES)), F.month(day) - 1), F.year(day).cast("string"))


def _clock(minutes: Column, sign: str) -> Column:
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(sign), F.lpad((minutes % 60).cast("string"), 2, "0"))


def _orders(spark, sf_dir) -> DataFrame:
    return spread(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus")


_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, o_orderpriority, o_orderstatus FROM orders)"


@query_of(f"""WITH {_ORDERS} SELECT o_orderkey, day AS "start", CASE o_orderkey % 6 WHEN 3 THEN CASE WHEN least(day + 3, last_day(day)) > day THEN least(day + 3, last_day(day)) END WHEN 5 THEN day + 10 END AS "end" FROM o""")
def q_dates(spark, sf_dir):
    """Days of orders, written in six ways."""
    day, until = F.col("day"), F.least(F.date_add("day", 3), F.last_day("day"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    within = F.concat(F.dayofmonth(day).cast("string"), F.lit(" t/m "), _said(until))
    said = _one(F.col("o_orderkey"), iso(day), _said(day), F.concat(F.lit("vr "), _said(day), F.lit(", welkom")), within, F.date_format(day, "dd-MM-yyyy"), F.concat_ws(" … ", iso(day), iso(F.date_add(day, 10))))
    found = dates.date_range(F.col("said"), F.lit(2026))
    return _orders(spark, sf_dir).select("o_orderkey", said.alias("said")).select("o_orderkey", found["start"].alias("start"), found["end"].alias("end"))


@query_of("""WITH m AS (SELECT o_orderkey, (o_orderkey * 7 % 1440)::INT AS a, ((o_orderkey * 7 + 95) % 1440)::INT AS b FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN a WHEN o_orderkey % 4 = 2 THEN a // 60 * 60 END AS "start", CASE WHEN o_orderkey % 4 = 0 THEN b END AS "end" FROM m""")
def q_times(spark, sf_dir):
    """Times in four ways, one of which is none."""
    a, b = F.col("o_orderkey") * 7 % 1440, (F.col("o_orderkey") * 7 + 95) % 1440
    ranged = F.concat(F.lit("van "), _clock(a, "."), F.lit(" - "), _clock(b, "."), F.lit(" uur"))
    said = _one(F.col("o_orderkey"), ranged, F.concat(_clock(a, ":"), F.lit(" uur")), F.concat(F.lit("aanvang "), F.floor(a / 60).cast("string"), F.lit(" uur")), "welkom")
    found = dates.times(F.col("said"))
    return spread(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", found["start"].alias("start"), found["end"].alias("end"))


@query_of("""WITH g AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS d, l_shipdate::DATE + (l_linenumber - 2) * 40 AS e, (l_partkey % 24 * 60)::INT AS a, CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 25 * 60 - l_suppkey % 25 // 24)::INT END AS b FROM lineitem),
    w AS (SELECT *, a = 0 AND (b IS NULL OR b IN (0, 1439)) AS whole, CASE WHEN e > d AND e - d <= 92 THEN e END AS until FROM g)
    SELECT l_orderkey, l_linenumber, until AS end_date, CASE WHEN NOT whole THEN a END AS "start", CASE WHEN NOT whole AND NOT coalesce(until IS NULL AND b <= a, false) THEN b END AS "end" FROM w""")
def q_midnight(spark, sf_dir):
    """Days and times of line items without what is nearly always a mistake."""
    late = F.col("l_suppkey") % 25
    given = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("d"), F.date_add(F.to_date("l_shipdate"), (F.col("l_linenumber") - 2) * 40).alias("e"), (F.col("l_partkey") % 24 * 60).cast("int").alias("a"),
        F.when(F.col("l_suppkey") % 5 > 0, (late * 60 - F.floor(late / 24)).cast("int")).alias("b"),
    )
    return given.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in dates.sane(F.col("d"), F.col("e"), F.col("a"), F.col("b")).items()])


@query_of("""WITH a AS (SELECT o_orderkey, '€ ' || (o_orderkey % 900 + 1) || ',' || lpad((o_custkey % 100)::VARCHAR, 2, '0') AS x, '€ ' || (o_orderkey % 900 + 901) AS y FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN x WHEN 1 THEN 'Gratis' WHEN 2 THEN x || ' – ' || y || ' (deels gratis)' WHEN 3 THEN 'Vrije gift' ELSE 'Onbekend' END AS price,
    CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'Betaald' WHEN o_orderkey % 5 IN (1, 3) THEN 'Gratis' ELSE 'Onbekend' END AS kind FROM a""")
def q_price(spark, sf_dir):
    key = F.col("o_orderkey")
    x = F.concat(F.lit("€ "), (key % 900 + 1).cast("string"), F.lit(","), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    both = F.concat(x, F.lit(" of € "), (key % 900 + 901).cast("string"), F.lit(", kinderen gratis"))
    said = _one(key, F.concat(F.lit("Entree "), x), "Toegang: gratis!", both, "een vrije gift", "welkom")
    rows = spread(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", price.price(F.col("said"), slug("said")).alias("p"))
    return rows.select("o_orderkey", "p.price", "p.kind")


@query_of("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Nee' WHEN 1 THEN 'Ja' WHEN 2 THEN 'Nee' WHEN 3 THEN 'Ja' ELSE 'Onbekend' END AS reservation FROM orders")
def q_reservation(spark, sf_dir):
    said = _one(F.col("o_orderkey"), "Reserveren niet nodig", "vooraf reserveren!", "Reserveren verplicht, of vrije inloop", F.concat(F.lit("Klant "), F.col("o_custkey").cast("string"), F.lit(": meld je aan")), "welkom")
    return spread(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", price.reservation(slug("said")).alias("reservation"))


@query_of(f"""WITH {_ORDERS}, w AS (SELECT o_orderkey, day, dayofweek(day) AS n FROM o)
    SELECT o_orderkey, {_DAYS}[n + 1] || ' ' || day(day) || ' ' || {_MONTHS}[month(day)] || ' ' || year(day) AS said, CASE WHEN n IN (0, 5, 6) THEN day ELSE day + (5 - n)::INT END AS "start", day + ((7 - n) % 7)::INT AS "end" FROM w""")
def q_weekend(spark, sf_dir):
    found = dates.coming_weekend(F.col("day"))
    return _orders(spark, sf_dir).select("o_orderkey", dates.in_dutch(F.col("day")).alias("said"), found["start"].alias("start"), found["end"].alias("end"))


@query_of(f"""WITH {_ORDERS} SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN day END AS day, CASE WHEN o_orderkey % 5 IN (1, 2) THEN (o_custkey % 1440)::INT END AS minutes FROM o""")
def q_iso(spark, sf_dir):
    at = F.date_format("day", "yyyy-MM-dd")
    clock = _clock(F.col("o_custkey") % 1440, ":")
    said = _one(F.col("o_orderkey"), at, F.concat(at, F.lit("T"), clock, F.lit(":59+02:00")), F.concat(at, F.lit(" "), clock), F.concat(F.year("day").cast("string"), F.lit("-02-30")), _said(F.col("day")))
    day, minutes = names.read_iso(F.col("said"))
    return _orders(spark, sf_dir).select("o_orderkey", said.alias("said")).select("o_orderkey", day.alias("day"), minutes.alias("minutes"))


_WORDS = {"Muziek": ("brass", "copper"), "Theater": ("polished",), "Festival": ("standard", "promo"), "Kinderen": ("small",), "Sport": ("bru shed", "tin"), "Markt": ("econ",)}
_HAS = lambda *words: f"regexp_matches(t, '(^|[^a-z0-9])({'|'.join(words)})')"


@query_of(f"""WITH t AS (SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g') AS t FROM part),
    f AS (SELECT p_partkey, list_filter([CASE WHEN {_HAS(*_WORDS['Muziek'])} THEN 'Muziek' END, CASE WHEN {_HAS(*_WORDS['Theater'])} THEN 'Theater' END, CASE WHEN {_HAS(*_WORDS['Festival'])} THEN 'Cultuur' END,
          CASE WHEN {_HAS(*_WORDS['Festival'])} THEN 'Festival' END, CASE WHEN {_HAS(*_WORDS['Sport'])} THEN 'Sport' END, CASE WHEN {_HAS(*_WORDS['Markt'])} THEN 'Markt' END, CASE WHEN {_HAS(*_WORDS['Kinderen'])} THEN 'Kinderen' END,
          CASE WHEN {_HAS(*_WORDS['Kinderen'])} THEN 'Familie' END], lambda x: x IS NOT NULL) AS found FROM t)
    SELECT p_partkey, CASE WHEN len(found) = 0 THEN 'Overig' ELSE array_to_string(found, ',') END AS found,
           CASE WHEN len(found) = 0 THEN 'Muziek' WHEN found[1] = 'Muziek' THEN array_to_string(found, ',') ELSE array_to_string(list_prepend('Muziek', found), ',') END AS merged FROM f""")
def q_categories(spark, sf_dir):
    """Kinds of parts as texts in which keywords begin words."""
    rows = spread(spark, sf_dir, "part").select("p_partkey", categories.classify(slug("p_type"), _WORDS).alias("f"))
    return rows.select("p_partkey", F.array_join("f", ",").alias("found"), F.array_join(categories.with_defaults(F.col("f"), F.array(F.lit("Muziek"))), ",").alias("merged"))


@query_of("""SELECT event_id, event_type || ' nummer ' || event_id AS name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS start_iso, strftime(ts, '%Y-%m-%d') AS end_iso, 'Zaal ' || user_id || ', Midsland' AS location_name,
    CASE event_id % 3 WHEN 0 THEN 'Koor ' || user_id ELSE 'u' || user_id || '@a.nl' END AS organizer, (event_id % 3)::INT AS n_categories FROM events WHERE event_id % 7 <> 0""")
def q_calendar(spark, sf_dir):
    """Events as calendars with folded lines, escapes and cancelled entries."""
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    fold = F.when(i % 2 == 0, F.lit("\r\n ")).otherwise("")
    owner = F.when(i % 3 == 0, F.concat(F.lit('ORGANIZER;CN="Koor '), user, F.lit('":mailto:x@a.nl'))).otherwise(F.concat(F.lit("ORGANIZER:mailto:u"), user, F.lit("@a.nl")))
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:"), F.col("event_type"), F.lit(" num"), fold, F.lit("mer "), i.cast("string")), F.concat(F.lit("DTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")),
        F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format("ts", "yyyyMMdd")), F.concat(F.lit("LOCATION:Zaal "), user, F.lit("\\, Midsland")), owner, F.when(i % 3 > 0, F.concat(F.lit("CATEGORIES:Muziek"), F.when(i % 3 == 2, ", Koor").otherwise(""))),
        F.when(i % 7 == 0, "STATUS:CANCELLED"), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    )
    found = calendar.read_calendar(spread(spark, sf_dir, "events").select("event_id", lines.alias("body")), "body")
    return found.select("event_id", "name", "start_iso", "end_iso", "location_name", "organizer", F.size("categories").alias("n_categories"))


@query_of("SELECT p_partkey, 0 AS ordinal, p_name AS name, 'https://a.nl/' || p_partkey AS detail_url, p_type || ' ' || p_size AS description FROM part WHERE p_partkey % 5 <> 4")
def q_feed(spark, sf_dir):
    """Parts as items of feeds of two kinds; every fifth feed is broken."""
    key, told = F.col("p_partkey"), F.concat(F.lit("&lt;b&gt;"), F.col("p_type"), F.lit("&lt;/b&gt; "), F.col("p_size").cast("string"))
    rss = F.concat(F.lit("<rss><channel><item><title>"), F.col("p_name"), F.lit("</title><link>https://a.nl/"), key.cast("string"), F.lit("</link><description>"), told, F.lit("</description></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), F.col("p_name"), F.lit('</title><link href="https://a.nl/'), key.cast("string"), F.lit('"/><summary>'), told, F.lit("</summary></entry></feed>"))
    body = F.when(key % 5 == 4, F.concat(F.lit("<rss><item>"), F.col("p_name"))).when(key % 2 == 0, rss).otherwise(atom)
    return structured.feed_items(spread(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")


def _linked(spark, sf_dir) -> DataFrame:
    """Customers as pages with linked data: nested, with comments and trailing commas, cancelled, or broken."""
    key = F.col("c_custkey")
    event = F.to_json(F.struct(
        F.when(key % 4 == 0, "MusicEvent").otherwise("event").alias("@type"), F.concat(F.lit("Feest &amp; "), F.col("c_name")).alias("name"), F.lit("2026-06-12T20:00").alias("startDate"), F.lit("/e/").alias("url"),
        F.when(key % 5 == 0, "https://schema.org/EventCancelled").alias("eventStatus"), F.lit("dans").alias("genre"),
        F.struct(F.col("c_mktsegment").alias("name"), F.struct(F.concat(F.lit("Kade "), F.col("c_nationkey").cast("string")).alias("streetAddress"), F.lit("Midsland").alias("addressLocality")).alias("address")).alias("location"),
        F.struct(F.concat(F.lit("Koor "), F.col("c_nationkey").cast("string")).alias("name"), F.lit("0562 123456").alias("telephone")).alias("organizer"), F.struct(F.col("c_nationkey").alias("price")).alias("offers"),
    ))
    block = F.when(key % 3 == 0, F.concat(F.lit('{"@graph": [// een lijst\n'), event, F.lit(",]}"))).when(key % 3 == 1, F.concat(F.lit('{"@type": "WebPage", "mainEntity": '), event, F.lit("}"))).otherwise(event)
    body = F.concat(F.lit("<html><script type='application/ld+json'>"), F.when(key % 7 == 0, F.concat(F.lit("{"), block)).otherwise(block), F.lit("</script></html>"))
    return spread(spark, sf_dir, "customer").select("c_custkey", F.lit("https://a.nl/agenda/").alias("url"), body.alias("body"))


_LINKED = "FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0"


@query_of(f"""SELECT c_custkey, 0 AS ordinal, 'Feest & ' || c_name AS name, '2026-06-12T20:00' AS start_iso, c_mktsegment AS location_name, 'Kade ' || c_nationkey || ', Midsland' AS address, 'Koor ' || c_nationkey AS organizer,
    '0562 123456' AS phone, 'https://a.nl/e/' AS detail_url, 'dans' AS categories {_LINKED}""")
def q_linked_data(spark, sf_dir):
    found = structured.linked_data(_linked(spark, sf_dir), "c_custkey", "body", "url")
    return found.select("c_custkey", "ordinal", "name", "start_iso", "location_name", "address", "organizer", "phone", "detail_url", F.array_join("categories", ",").alias("categories"))


@query_of(f"SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'Gratis' ELSE '€ ' || regexp_replace(c_nationkey::VARCHAR, '0+$', '') END AS price_text {_LINKED}".replace("regexp_replace(c_nationkey::VARCHAR, '0+$', '')", "c_nationkey"))
def q_offers(spark, sf_dir):
    return structured.linked_data(_linked(spark, sf_dir), "c_custkey", "body", "url").select("c_custkey", "price_text")


@query_of("""SELECT s_suppkey, 0 AS ordinal, s_name || ' & meer' AS name, '2026-06-12' AS start_iso, 'Kerk Midsland' AS location_name, s_nationkey::VARCHAR AS price_text, 'https://a.nl/s/' || s_suppkey AS detail_url FROM supplier WHERE s_suppkey % 4 <> 3""")
def q_microdata(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    named = F.when(F.col("s_suppkey") % 4 < 3, F.concat(F.lit('<h2 itemprop="name">'), F.col("s_name"), F.lit(" &amp; meer</h2>"))).otherwise("")
    body = F.concat(
        F.lit('<div itemscope itemtype="https://schema.org/Event">'), named, F.lit('<time itemprop="startDate" datetime="2026-06-12">vrijdag</time><span itemprop="location">Kerk <b>Midsland</b></span><meta itemprop="price" content="'),
        F.col("s_nationkey").cast("string"), F.lit('"><a href="/s/'), key, F.lit('">verder</a></div>'),
    )
    rows = spread(spark, sf_dir, "supplier").select("s_suppkey", F.lit("https://a.nl/agenda").alias("url"), body.alias("body"))
    return markup.microdata(rows, "s_suppkey", "url", "body").select("s_suppkey", "ordinal", "name", "start_iso", "location_name", "price_text", "detail_url")


@query_of("""SELECT c_custkey, 1 AS place, 'Grote ' || lower(c_mktsegment) || ' markt' AS name, '2026-06-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || 'T10:00:00' AS start_iso, 'Plein ' || c_nationkey AS location_name,
    'https://a.nl/agenda/' || c_custkey AS detail_url FROM customer WHERE c_custkey % 6 <> 5""")
def q_dated_blocks(spark, sf_dir):
    """Customers as pages with one block; those without a date in it give nothing."""
    key = F.col("c_custkey")
    day = F.when(key % 6 < 5, F.concat((key % 28 + 1).cast("string"), F.lit(" juni 2026, 10.00 - 12.00 uur"))).otherwise("elke dag")
    body = F.concat(
        F.lit('<ul><li class="event"><h3>Grote '), F.lower("c_mktsegment"), F.lit(" markt</h3> <p>"), day, F.lit('</p> <span class="locatie">Plein '), F.col("c_nationkey").cast("string"), F.lit('</span> <a href="/agenda/'), key.cast("string"), F.lit('">meer</a></ul>'),
    )
    rows = spread(spark, sf_dir, "customer").select("c_custkey", F.lit("https://a.nl/agenda").alias("url"), body.alias("body"))
    return markup.dated_blocks(rows, "c_custkey", "url", "body", 2026).select("c_custkey", "place", "name", "start_iso", "location_name", "detail_url")


@query_of("""SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY i)::INT AS place, 'Grote ' || lower(c_mktsegment) || ' markt ' || ['een', 'twee', 'drie'][i] AS name FROM customer, unnest([1, 2, 3]) AS t(i)
    WHERE CASE c_custkey % 5 WHEN 0 THEN i <= 2 WHEN 1 THEN i = 3 WHEN 2 THEN i = 1 WHEN 3 THEN i IN (1, 3) ELSE false END""")
def q_selector_hints(spark, sf_dir):
    """Customers as pages of three blocks that no kind fits; what their sources' hints find is read: classes in two ways, an attribute inside an id, direct children, and no selector."""
    key = F.col("c_custkey")
    block = lambda i, word, opened: F.concat(F.lit(opened), F.lit("<h3>Grote "), F.lower("c_mktsegment"), F.lit(f" markt {word}</h3> <p>{i} juni 2026</p></div>"))
    body = F.concat(F.lit('<div id="hier">'), block(1, "een", '<div class="rij los" data-soort="Week">'), F.lit("<section>"), block(2, "twee", '<div class="rij">'), F.lit("</section>"), block(3, "drie", '<div data-soort="dag">'), F.lit("</div>"))
    hint = _one(key, ".rij", "#hier [data-soort=dag]", "div.rij.los, span", "#hier > div[data-soort]", "div:nth-child(")
    rows = spread(spark, sf_dir, "customer").select(key, F.lit("https://a.nl/agenda").alias("url"), body.alias("body"), hint.alias("hint"))
    return markup.dated_blocks(rows, "c_custkey", "url", "body", 2026, "hint").select("c_custkey", "place", "name")


@query_of("SELECT c_custkey, 1 AS place, 'https://a.nl/agenda/x' || c_custkey AS link FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 2 END, 'https://a.nl/event/' || lower(c_mktsegment) FROM customer")
def q_detail_links(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    first = F.when(F.col("c_custkey") % 4 < 3, F.concat(F.lit('<a href="/agenda/x'), key, F.lit('">12 juni</a><a href="/AGENDA/X'), key, F.lit('">12 juni</a>'))).otherwise("")
    body = F.concat(first, F.lit('<a href="https://b.nl/agenda/x">een lange titel</a><a href="/contact/event">een lange titel</a><a href="event/'), F.lower("c_mktsegment"), F.lit('">Een lange tocht langs zee</a><a href="/event/derde">een lange titel</a>'))
    rows = spread(spark, sf_dir, "customer").select("c_custkey", F.lit("https://a.nl/").alias("url"), body.alias("body"))
    found = markup.detail_links(rows, "c_custkey", "url", "body", F.lit(3))
    return found.where("link <> 'https://a.nl/event/derde'").withColumn("place", F.col("place"))


@query_of("""SELECT p_partkey, p_name AS name, '2026-06-12 10:00:00' AS start_iso, p_brand AS location_name, p_type || ', Midsland' AS address, p_size::VARCHAR AS price_text, 'https://a.nl/' || p_partkey AS detail_url, 1 AS n_categories FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, p_name, '2026-06-13', NULL, NULL, NULL, 'https://a.nl/' || p_partkey, 0 FROM part WHERE p_partkey % 3 = 1""")
def q_site_json(spark, sf_dir):
    """Parts as answers of two kinds of site systems, or as other JSON."""
    link = F.concat(F.lit("https://a.nl/"), F.col("p_partkey").cast("string")).alias
    venue = F.struct(F.col("p_brand").alias("venue"), F.col("p_type").alias("address"), F.lit("Midsland").alias("city")).alias("venue")
    told = F.struct(F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b>")).alias("title"), F.lit("2026-06-12 10:00:00").alias("start_date"), F.col("p_size").cast("string").alias("cost"), link("url"), venue, F.array(F.struct(F.lit("Markt").alias("name"))).alias("categories"))
    post = F.struct(F.struct(F.col("p_name").alias("rendered")).alias("title"), link("link"), F.struct(F.lit("2026-06-13").alias("event_start")).alias("meta"))
    body = _one(F.col("p_partkey"), F.to_json(F.struct(F.array(told).alias("events"))), F.to_json(F.array(post)), '{"other": 1}')
    rows = spread(spark, sf_dir, "part").select("p_partkey", F.lit("https://a.nl/agenda").alias("url"), body.alias("body"))
    return site_json.site_events(rows, "p_partkey", "url", "body").select("p_partkey", "name", "start_iso", "location_name", "address", "price_text", "detail_url", F.size("categories").alias("n_categories"))


@query_of("""SELECT 'kerk-' || lower(replace(s_name, '#', '-')) AS id, 'https://s.nl/' || s_suppkey AS agenda_urls, 'kerk en gemeenschap' AS category, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 5 END AS tier,
    CASE WHEN s_suppkey % 2 = 0 THEN 'ics' END AS feed_type, s_nationkey % 5 <> 0 AS enabled, CASE WHEN s_suppkey % 4 IN (0, 1) THEN 25 ELSE 12 END AS max_detail_pages FROM supplier""")
def q_source_registry(spark, sf_dir):
    """Suppliers as raw sources, each listed twice."""
    key, none = F.col("s_suppkey"), F.lit(None).cast("string")
    url = F.concat(F.lit("https://s.nl/"), key.cast("string"))
    raw = table(spark, sf_dir, "supplier").select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("again"), key, F.concat(F.lit("Kerk "), F.col("s_name")).alias("name"), url.alias("homepage"), none.alias("agenda_url"), F.array(url, F.lit(" ")).alias("agenda_urls"), F.lit("church").alias("category"),
        _one(key, "primary_organizer", "OFFICIAL_LOCAL", "social", "unknown").alias("tier"), F.when(key % 2 == 0, "https://s.nl/a.ICS").alias("feed_url"), none.alias("feed_type"), none.alias("rendering"), (F.col("s_nationkey") % 5 == 0).alias("blocked"),
    )
    out = registry.build_sources(raw.withColumn("ord", (F.col("again") * 1_000_000 + F.col("s_suppkey")).cast("int")))
    return out.select("id", F.array_join("agenda_urls", "|").alias("agenda_urls"), "category", "tier", "feed_type", "enabled", "max_detail_pages")


@query_of("""SELECT s_suppkey, 'https://s.nl/' || s_suppkey || '?van=1996-03-01&tot=14-03-1996' AS url FROM supplier WHERE s_suppkey % 2 = 0
    UNION ALL SELECT s_suppkey, 'https://s.nl/agenda' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'https://s.nl/' || s_suppkey FROM supplier WHERE s_suppkey % 2 > 0 AND s_suppkey % 3 > 0""")
def q_addresses(spark, sf_dir):
    key = F.col("s_suppkey")
    home = F.concat(F.lit("https://s.nl/"), key.cast("string"))
    template = F.when(key % 2 == 0, F.concat(home, F.lit("?van={from}&tot={toNl}")))
    urls = F.when(key % 3 == 0, F.array(F.lit("https://s.nl/agenda"), F.lit("https://S.nl/Agenda"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select(key, F.explode(registry.addresses(template, urls, home, date(1996, 3, 1), date(1996, 3, 14))).alias("url"))


@query_of(r"""WITH h AS (SELECT page_id, url, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS host FROM pages)
    SELECT page_id, 'discovery:' || replace(regexp_replace(host, '[^a-z0-9-]', '', 'g'), '.', '') AS id_part, CASE WHEN page_id % 2 = 0 THEN 'Pagina ' || page_id ELSE host END AS name, regexp_extract(url, '^(https?://[^/?#:]+)', 1) AS homepage,
    CASE WHEN regexp_matches(host, 'terschelling\.nl|gemeente') THEN 3 WHEN regexp_matches(host, 'vvv|wadden\.nl|friesland\.nl') THEN 4 WHEN regexp_matches(host, 'uitagenda|allevents|eventbrite|langetermijnagenda|dagjeweg|festivalinfo|evenementen') THEN 5
    WHEN regexp_matches(host, 'terschelling|skylge|oerol') THEN 1 ELSE 5 END AS tier FROM h""")
def q_found_sources(spark, sf_dir):
    hits = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Pagina "), F.col("page_id").cast("string"))).otherwise(" ").alias("title"))
    ids = hits.select("page_id", F.col("url").alias("u")).join(registry.found_sources(hits).withColumn("u", F.get("agenda_urls", F.lit(0))).dropDuplicates(["u", "name"]), "u")
    named = F.when(F.col("page_id") % 2 == 0, F.col("name") == F.concat(F.lit("Pagina "), F.col("page_id").cast("string"))).otherwise(~F.col("name").startswith("Pagina "))
    return ids.where(named).select("page_id", F.substring_index("id", ":", 2).alias("id_part"), "name", "homepage", "tier")



@query_of("""WITH a AS (SELECT user_id, event_id % 5 AS rank, event_id % 3 = 0 AS fine, event_id % 800 AS n, ts FROM events),
    g AS (SELECT * FROM a WHERE fine AND n > 400 AND (rank < 4 OR date_diff('day', ts::DATE, DATE '2024-03-10') <= 60)) SELECT user_id, ['Direct', 'HostVariant', 'AlternatePath', 'Browser', 'WebArchive'][min(rank) + 1] AS strategy FROM g GROUP BY user_id""")
def q_fetch_ladder(spark, sf_dir):
    """Events as attempts to read a page for each user."""
    i = F.col("event_id")
    tried = table(spark, sf_dir, "events").select("user_id", _one(i, *registry.STRATEGIES).alias("strategy"), F.when(i % 3 == 0, 200).otherwise(403).alias("status"), F.repeat(F.lit("x"), (i % 800).cast("int")).alias("body"), F.col("ts").alias("archived_at"))
    return registry.first_usable(tried, "user_id", datetime(2024, 3, 10)).select("user_id", "strategy")


@query_of("""WITH t AS (SELECT user_id, bool_or(event_id % 11 = 0) AS refused, bool_or(event_id % 3 = 0) AS failed, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS raws, count(*) FILTER (event_id % 13 = 0) AS n FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN refused THEN 'geblokkeerd' WHEN n > 0 THEN 'ok' WHEN failed AND raws = 0 THEN 'fout' ELSE 'leeg' END AS status, n AS events FROM t""")
def q_outcomes(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    tried = rows.select("user_id", F.when(i % 11 == 0, 403).otherwise(200).alias("status"), F.when(i % 3 == 0, "x").alias("error"), F.when(i % 4 == 0, 1).otherwise(0).alias("raws"))
    return registry.outcomes(tried, rows.where(i % 13 == 0).select("user_id"), "user_id")


@query_of("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 4 = 0 THEN 1 ELSE 2 END + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n FROM orders""")
def q_websites(spark, sf_dir):
    """Two sources an order, which may share a host or an id, and for some a third."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    source = lambda i, u: F.struct(i.alias("source_id"), u.alias("url"))
    a = source(F.lit("discovery:a-nl:1"), F.lit("https://www.a.nl/x"))
    b = source(F.when(cust % 4 == 0, "Discovery:A-nl:2").otherwise("b"), F.when(key % 3 == 0, "http://a.nl/y").otherwise("https://b.nl"))
    c = source(F.lit("c"), F.lit("https://c.nl/"))
    return table(spark, sf_dir, "orders").select(key, F.size(resolve.websites(F.when(key % 7 == 0, F.array(a, b, c)).otherwise(F.array(a, b)))).alias("n"))


@query_of("SELECT page_id, CASE WHEN url LIKE 'http%://%.%/%' THEN true ELSE false END AS whole, CASE page_id % 6 WHEN 0 THEN 'ics' WHEN 1 THEN 'rss' WHEN 2 THEN 'json' WHEN 3 THEN 'html' WHEN 4 THEN 'ics' ELSE 'json' END AS format FROM pages".replace("CASE WHEN url LIKE 'http%://%.%/%' THEN true ELSE false END AS whole, ", ""))
def q_format(spark, sf_dir):
    """Pages under content types and ways of fetching, and what reads them."""
    i = F.col("page_id")
    kind = _one(i, "text/calendar", "application/rss+xml", "application/json", "text/html; xml", "text/plain", "text/html")
    body = F.when(i % 6 == 4, F.concat(F.lit("begin:vcalendar "), F.col("html"))).when(i % 6 == 5, F.concat(F.lit(" ["), F.col("html"))).otherwise(F.col("html"))
    way = F.when(i % 6 == 5, "AlternatePath").otherwise("Direct")
    return table(spark, sf_dir, "pages").select(i, intake.format_of(kind, body, way, F.lit(None).cast("string"), F.lit(False)).alias("format"))


@query_of("SELECT page_id, CASE WHEN page_id % 5 IN (0, 4) THEN 'ics' ELSE 'rss' END AS format FROM pages")
def q_feed_format(spark, sf_dir):
    """Pages as feeds: by what they are registered as, else by what is in them."""
    i = F.col("page_id")
    body = F.when(i % 5 == 4, F.concat(F.col("html"), F.lit(" begin:vcalendar"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select(i, intake.format_of(F.lit("text/html"), body, F.lit("Direct"), _one(i, "ICS", "rss", "Atom", F.lit(None), F.lit("")), F.lit(True)).alias("format"))


@query_of(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?://)', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS rest FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(host, '(?i)^www\.') THEN scheme || substr(host, 5) || rest WHEN length(host) - length(replace(host, '.', '')) = 1 THEN scheme || 'www.' || host || rest END AS other FROM u""")
def q_host_variant(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.host_variant(F.col("url")).alias("other"))
