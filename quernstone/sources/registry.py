"""Registries of sources and what is asked of them: cleaned source lists, addresses for a period, questions for search engines, attempts to fetch."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import truncate
from quernstone.operators.query import first_per, ranked
from quernstone.plans.steps import attach, settle
from quernstone.sources.pages import usable

# Fixed values. Tiers by their raw names; detail pages that are read of sources in the first three tiers and of others.
RAW_TIERS = {"primary_organizer": 1, "official_venue": 2, "official_local": 3, "tourist_calendar": 4, "aggregator": 5, "social": 6}
OTHER_TIER, DETAIL_PAGES, FEWER_DETAIL_PAGES, LONGEST_ID = 5, 25, 12, 60
# Fixed values. Categories of sources by what their category and name say, the first that fits.
CATEGORIES = (
    ("municipal|gemeente|official municipal|bestuurlijk", "officiële lokale bron"), (r"tourist|vvv|wadden|friesland\.nl", "toeristische website"), ("museum", "museum"),
    ("theat|cinema|bioscoop|cultur|podium|concertzaal", "cultuur en theater"), ("festival", "festival"), ("nature|natuur|staatsbosbeheer|natuurmonument", "natuurorganisatie"),
    ("excursion|excursie|rondleiding|wadlopen|boat|rederij|vaart", "excursieorganisatie"), ("sport|race|run|loop|marathon|zeil|toernooi", "sport en wedstrijden"), ("horeca|caf|restaurant|bar|paviljoen|pub|kroeg", "horeca en live muziek"),
    ("camping|holiday|park|resort|vakantie|stayokay|jeugdherberg", "camping en vakantiepark"), ("church|kerk|parochie|gemeente protest", "kerk en gemeenschap"), ("associat|vereniging|dorpsbelang|plaatselijk|dorpshuis", "lokale vereniging"),
    ("ticket|weeztix|eventbrite|paylogic|stager|yesplan", "ticketplatform"), ("news|nieuws|courant|omrop|krant|weekblad", "lokaal nieuws"), ("aggregat|uitagenda|allevents|festivalinfo|agenda", "evenementenkalender"), ("organizer|organisator", "organisator"),
)
OTHER_CATEGORY = "overige openbare bron"
# Fixed values. How a page can be had, the most direct way first; oldest archived page that counts.
STRATEGIES, OLDEST_DAYS = ("Direct", "HostVariant", "AlternatePath", "Browser", "WebArchive"), 60
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
MOST_MONTHS = 4


def build_sources(raw: DataFrame) -> DataFrame:
    """Sources from raw rows (ord, name, homepage, agenda_url, agenda_urls, category, tier, feed_url, feed_type, rendering, blocked), each list of addresses once.

    Rows without a name or an address go. Blocked sources stay, but aren't enabled.
    """
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    listed = F.filter(F.concat(F.array(F.trim("agenda_url")), F.coalesce("agenda_urls", F.array().cast("array<string>"))), has)
    urls = F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(F.filter(F.array("homepage"), has)))
    rows = raw.withColumn("agenda_urls", urls).where(has(F.col("name")) & (F.size("agenda_urls") > 0))
    rows = first_per(rows, [F.lower(F.array_join("agenda_urls", "|"))], [F.col("ord")])
    said = F.lower(F.concat_ws(" ", F.coalesce("category", F.lit("")), "name"))
    category = F.coalesce(*[F.when(said.rlike(p), label) for p, label in CATEGORIES], F.lit(OTHER_CATEGORY))
    tier = F.coalesce(*[F.when(F.lower("tier") == k, n) for k, n in RAW_TIERS.items()], F.lit(OTHER_TIER))
    feed = F.coalesce("feed_type", F.when(F.lower("feed_url").rlike(r"\.ics"), "ics").when(F.lower("feed_url").rlike("feed|rss"), "rss"))
    return rows.select(
        F.substring(F.lower(F.btrim(F.regexp_replace("name", r"(?U)[^\w]+", "-"), F.lit("-"))), 1, LONGEST_ID).alias("id"), "name", "homepage", "agenda_urls", category.alias("category"), tier.alias("tier"), "feed_url", feed.alias("feed_type"),
        F.coalesce("rendering", F.lit("server")).alias("rendering"), F.coalesce("blocked", F.lit(False)).alias("blocked"), (~F.coalesce("blocked", F.lit(False))).alias("enabled"), F.when(tier <= 3, DETAIL_PAGES).otherwise(FEWER_DETAIL_PAGES).alias("max_detail_pages"),
    )


def addresses(template: Column, urls: Column, homepage: Column, first: date, last: date) -> Column:
    """The addresses to read for a period: the template filled in, the agenda's, or else the homepage; each once whatever its case."""
    filled = template
    for key, value in {"{from}": f"{first:%Y-%m-%d}", "{to}": f"{last:%Y-%m-%d}", "{fromNl}": f"{first:%d-%m-%Y}", "{toNl}": f"{last:%d-%m-%Y}", "{year}": str(first.year), "{month}": f"{first:%m}"}.items():
        filled = F.replace(filled, F.lit(key), F.lit(value))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    all_ = F.concat(F.filter(F.array(filled), has), F.coalesce(urls, F.array().cast("array<string>")))
    every = F.when(F.size(all_) > 0, all_).otherwise(F.filter(F.array(homepage), has))
    return F.filter(every, lambda u, i: F.array_position(F.transform(every, lambda x: F.lower(x)), F.lower(u)) == i + 1)


# Fixed values. Tiers of pages found by searching, by what their host says, the first that fits.
FOUND_TIERS = (
    (r"terschelling\.nl|gemeente", 3), (r"vvv|wadden\.nl|friesland\.nl", 4), ("uitagenda|allevents|eventbrite|langetermijnagenda|dagjeweg|festivalinfo|evenementen", 5), ("terschelling|skylge|oerol", 1),
)


def guess_tier(host: Column) -> Column:
    """The tier of a page found by searching, by its host."""
    return F.coalesce(*[F.when(host.rlike(p), tier) for p, tier in FOUND_TIERS], F.lit(OTHER_TIER))


def found_sources(hits: DataFrame) -> DataFrame:
    """Sources for pages found by searching (url, title): one a page, under an id of its host and a hash of its address."""
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/?#:]+)", 1)
    name = F.when(F.coalesce(F.trim("title") != "", F.lit(False)), truncate(F.col("title"), 90)).otherwise(host)
    ident = F.concat(F.lit("discovery:"), F.replace(F.regexp_replace(host, "[^a-z0-9-]", ""), F.lit("."), F.lit("")), F.lit(":"), F.lower(F.hex(F.abs(F.xxhash64("url")))))
    return hits.select(ident.alias("id"), name.alias("name"), F.regexp_extract("url", r"^(https?://[^/?#:]+)", 1).alias("homepage"), F.array("url").alias("agenda_urls"), guess_tier(host).alias("tier"), F.lit(True).alias("discovered"), F.lit(8).alias("max_detail_pages"))


def month_names(first: date, last: date) -> list[str]:
    """The months from first to last, MOST_MONTHS at most, as Dutch texts."""
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    return [f"{MONTHS[(first.month - 1 + i) % 12]} {first.year + (first.month - 1 + i) // 12}" for i in range(max(0, min(count, MOST_MONTHS)))]


def questions(places: DataFrame, general: list[str], terms: list[str], first: date, last: date, per_place: int) -> DataFrame:
    """ordinal, question for search engines: general ones, with months, then places (name, type, ambiguous, use_as_search_term) with terms; each once whatever its case.

    Terms a place follow its kind, so places meet only the terms that they use.
    """
    months = month_names(first, last)
    spark = places.sparkSession
    said = [q for g in general for q in (g, *[f"{g} {m}" for m in months[:2]])]
    broad = spark.createDataFrame([(0, "", i, q) for i, q in enumerate(said)], "rank int, place string, n int, question string")
    rank = F.coalesce(*[F.when(F.col("type") == k, i) for i, k in enumerate(("dorp", "buurtschap", "gehucht", "venue", "landmark"), 1)])
    asked = F.when(F.col("ambiguous") | (F.char_length("name") <= 5), F.concat("name", F.lit(" Terschelling"))).otherwise(F.col("name"))
    count = F.when(F.col("type") == "dorp", per_place).when(F.col("type").isin("buurtschap", "gehucht"), max(3, per_place // 2)).otherwise(2)
    own = F.transform(F.slice(F.array(*map(F.lit, terms)), F.lit(1), count), lambda t: F.concat(asked, F.lit(" "), t))
    if months:
        own = F.concat(own, F.when(F.col("type") == "dorp", F.array(F.concat(asked, F.lit(f" agenda {months[0]}")))).otherwise(F.array().cast("array<string>")))
    local = places.where(F.coalesce("use_as_search_term", F.lit(True)) & rank.isNotNull()).select(rank.alias("rank"), F.col("name").alias("place"), F.posexplode(own).alias("n", "question"))
    once = first_per(broad.unionByName(local), [F.lower("question")], [F.col("rank"), F.col("place"), F.col("n")])
    return once.orderBy("rank", "place", "n").select("rank", "place", "n", "question")


def first_usable(attempts: DataFrame, key: str, now: datetime) -> DataFrame:
    """The attempt (key, strategy, status, body, archived_at) of each address that is usable and most direct; archived pages only if young.

    One aggregate: the payload goes with the least rank.
    """
    rank = F.coalesce(*[F.when(F.col("strategy") == s, i) for i, s in enumerate(STRATEGIES)], F.lit(len(STRATEGIES)))
    young = F.coalesce(F.col("strategy") != "WebArchive", F.lit(True)) | F.coalesce(F.datediff(F.lit(now).cast("timestamp"), "archived_at") <= OLDEST_DAYS, F.lit(False))
    good = attempts.where(usable(F.col("status").between(200, 299), F.col("body")) & young)
    return good.groupBy(key).agg(F.min_by("strategy", rank).alias("strategy"), F.min_by("body", rank).alias("body"))


# Fixed values. Answers that say that a page doesn't exist, and characters of a page that a browser has to show.
NO_PAGE, FEWEST_SHOWN = (404, 410), 800


def climbed(pages: DataFrame) -> DataFrame:
    """host, ord and strategy: by which way each page was had, or Failed, or Skipped, when ways are tried in turn and hosts are remembered.

    pages are what each way gives, in the order (ord, long) in which a run asks: host, ord, direct (status, 0 without an answer), direct_fits, variant (null without one), variant_fits, data (whether another path
    of the host has data), shown (characters in a browser, null without one), archived (whether a young copy is kept). A page that doesn't exist ends the climb; a host that answers neither way isn't asked for
    data. A host once had by browser only is asked so from then on; one that gave no answer at all is asked no more. What a host is remembered for begins with its first such page, whichever comes
    first, so one aggregate tells it; hosts with very many pages are joined by broadcast.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    silent = (F.col("direct") == 0) & (F.coalesce("variant", F.lit(0)) == 0)
    late = F.when(F.coalesce("shown", F.lit(0)) > FEWEST_SHOWN, "Browser").when(yes("archived"), "WebArchive").otherwise("Failed")
    first = F.when(yes("direct_fits"), "Direct").when(F.col("direct").isin(*NO_PAGE), "Failed").when(F.col("variant").isNotNull() & yes("variant_fits"), "HostVariant").when(~silent & yes("data"), "AlternatePath").otherwise(late)
    rows = settle(pages.withColumns({"first": first, "late": late}).withColumn("silent", silent & (F.col("first") == "Failed") & ~F.col("direct").isin(*NO_PAGE)))
    hosts = rows.groupBy("host").agg(F.count("*").alias("size"), F.min(F.when(F.col("first") == "Browser", F.col("ord"))).alias("shown_at"), F.min(F.when(F.col("silent"), F.col("ord"))).alias("silent_at"))
    never = F.lit((1 << 63) - 1)
    known = settle(hosts.withColumns({"shown_at": F.coalesce("shown_at", never), "silent_at": F.coalesce("silent_at", never)}))
    met = attach(rows, known, ["host"], "size")
    skipped = (F.col("silent_at") < F.col("shown_at")) & (F.col("ord") > F.col("silent_at"))
    by_browser = (F.col("shown_at") < F.col("silent_at")) & (F.col("ord") > F.col("shown_at"))
    return met.select("host", "ord", F.when(skipped, "Skipped").when(by_browser, F.col("late")).otherwise(F.col("first")).alias("strategy"))


def first_questions(asked: DataFrame, most: int) -> DataFrame:
    """The first questions (rank, place, n, question) of a run in their order, `most` at most; all if most is 0 or less."""
    if most <= 0:
        return asked
    return ranked(asked, [F.col("rank"), F.col("place"), F.col("n")], "_turn").where(F.col("_turn") <= most).drop("_turn")


def outcomes(attempts: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Status of each source: geblokkeerd if a site refused, else fout or leeg without activities, else ok. attempts: key, status, error, raws; events: key."""
    tried = attempts.groupBy(key).agg(F.max(F.col("status").isin(401, 403)).alias("refused"), F.max(F.col("error").isNotNull()).alias("failed"), F.sum("raws").alias("raws"))
    got = events.groupBy(key).agg(F.count("*").alias("events"))
    n = F.coalesce("events", F.lit(0))
    empty = F.when(F.col("failed") & (F.coalesce("raws", F.lit(0)) == 0), "fout").otherwise("leeg")
    status = F.when(F.coalesce("refused", F.lit(False)), "geblokkeerd").when(n == 0, empty).otherwise("ok")
    return tried.join(got, key, "left").select(key, status.alias("status"), n.alias("events"))
