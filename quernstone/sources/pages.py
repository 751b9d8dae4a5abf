"""Recorded pages: whether they can be used, what else to try, and which are candidates for activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.fixed import ASSETS, BLOCKED_HOSTS
from quernstone.functions.text import host_of, path_of
from quernstone.operators.query import contains_any, first_per

LEAST_LENGTH = 400
PER_HOST = 2


def usable(success: Column, body: Column) -> Column:
    return F.coalesce(success & (F.trim(body) != "") & (F.char_length(body) > LEAST_LENGTH), F.lit(False))


def looks_like_data(content_type: Column, body: Column) -> Column:
    """Whether a payload is a calendar, a feed or JSON, by its type or its beginning."""
    kind, text = F.coalesce(content_type, F.lit("")), F.coalesce(body, F.lit(""))
    return kind.rlike("json|xml|calendar") | text.rlike(r"(?i)\ABEGIN:VCALENDAR|\A\s*[\[{]|<rss|<feed")


def host_variant(url: Column) -> Column:
    """The address with www. taken away, or added where the host has two labels; null for other hosts."""
    scheme, host, rest = (F.regexp_extract(url, r"^(https?://)([^/?#]+)(.*)$", i) for i in (1, 2, 3))
    dots = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))
    return F.when(host.rlike(r"(?i)^www\."), F.concat(scheme, F.substring(host, 5, 1 << 20), rest)).when(dots == 1, F.concat(scheme, F.lit("www."), host, rest))


def alternate_paths(url: Column) -> Column:
    """Addresses under which the same agenda may be found in a form for machines."""
    root = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    path = F.regexp_replace(path_of(url), r"/+$", "")
    # Fixed values. Where common site systems put calendars and feeds.
    return F.array(
        F.concat(root, path, F.lit("/?ical=1")),
        F.concat(root, path, F.lit("/feed/")),
        F.concat(root, F.lit("/wp-json/tribe/events/v1/events?per_page=50")),
        F.concat(root, F.lit("/wp-json/wp/v2/tribe_events?per_page=50")),
        F.concat(root, F.lit("/feed/")),
        F.concat(root, F.lit("/events.ics")),
    )


def candidates(hits: DataFrame, url: str, order: str) -> DataFrame:
    """hits that may be agenda pages: web addresses of hosts that aren't blocked, no assets, each page once (first in order)."""
    host, path = F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1), path_of(F.col(url))
    fit = (host != "") & ~contains_any(host, BLOCKED_HOSTS) & ~path.rlike(rf"(?i)\.({'|'.join(ASSETS)})$")
    page = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"/+$", ""))
    return first_per(hits.where(fit), [page], [F.col(order)])


def relevance(url: Column, text: Column) -> Column:
    """How likely a page is an agenda of the island, in points."""
    # Fixed values. Signs of a relevant page and their points.
    signs = (
        (host_of(url).rlike("terschelling|skylge|oerol"), 40),
        (F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("terschelling")), 12),
        (F.lower(path_of(url)).rlike("agenda|event|evenement|activiteit|programma|kalender|uitagenda|voorstelling|concert|expositie"), 25),
        (host_of(url).rlike("vvv|wadden|uitagenda|agenda"), 10),
        (host_of(url).endswith(".nl"), 6),
        (F.char_length(path_of(url)) <= 1, -5),
    )
    total = F.lit(0)
    for sign, points in signs:
        total = total + F.when(sign, points).otherwise(0)
    return total


def best_per_host(hits: DataFrame, url: str, score: Column, tie: str, most: int = PER_HOST) -> DataFrame:
    scored = hits.withColumn("score", score).withColumn("host", host_of(F.col(url)))
    return first_per(scored, [F.col("host")], [F.desc("score"), F.col(tie)], most)
