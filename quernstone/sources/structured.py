"""Activities that pages state in linked data, and items of feeds."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.markup import absolute

DEPTH = 8
_FIELDS = ("name", "start_iso", "end_iso", "description", "location_name", "address", "phone", "email", "organizer", "website", "detail_url", "price_text", "ticket_url", "raw_text")
# Fixed values. Parts of an address in their order, and properties that name categories.
_ADDRESS, _CATEGORIES = ("streetAddress", "postalCode", "addressLocality", "addressRegion"), ("keywords", "genre", "about", "eventAttendanceMode")
_JOINT = " \n "
#: What may stand in JSON that is read with patience: texts, which stay, and comments, which don't.
_LENIENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.DOTALL)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])')
_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
_TAG = re.compile(r"<[^>]+>")


def _text(value: object) -> str | None:
    """What a JSON value says as a text: itself, its first part that says something, or its name."""
    if isinstance(value, str):
        return " ".join(unescape(value).split()) or None
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int | float):
        return json.dumps(value)
    if isinstance(value, list):
        return next((t for t in map(_text, value) if t), None)
    return _text(value.get("name")) if isinstance(value, dict) else None


def _events(node: object, depth: int = 0) -> Iterator[dict]:
    if depth > DEPTH:
        return
    if isinstance(node, list):
        for part in node:
            yield from _events(part, depth + 1)
    elif isinstance(node, dict):
        kinds = node.get("@type")
        if any(isinstance(k, str) and k.lower().endswith("event") for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield node
        for key, part in node.items():
            if key != "@context":
                yield from _events(part, depth + 1)


def _amount(raw: str) -> str:
    """A price as shown: free if zero, decimals with a comma; what is no number stays."""
    try:
        value = Decimal(raw.strip().replace(",", "."))
    except InvalidOperation:
        return raw
    return "Gratis" if value == 0 else f"€ {value:.2f}".rstrip("0").rstrip(".").replace(".", ",")


def _offers(value: object) -> tuple[str | None, str | None]:
    """Price and ticket address of an offer or a list of them; different prices show the least and the greatest, which are compared as texts."""
    offers = [o for o in (value if isinstance(value, list) else [value]) if isinstance(o, dict)]
    said = sorted({p for o in offers if (p := _text(o.get("price")) or _text(o.get("lowPrice")))})
    shown = " – ".join(map(_amount, said if len(said) < 2 else (said[0], said[-1]))) or None
    return shown, next((u for o in offers if (u := _text(o.get("url")))), None)


def _first(value: object, fields: dict[str, object]) -> dict[str, str | None]:
    """What the first part of a value that has a name says; fields tell how each text is had of an object."""
    said: dict[str, str | None] = dict.fromkeys(fields)
    for part in value if isinstance(value, list) else [value]:
        if isinstance(part, str):
            said["name"] = part
        elif isinstance(part, dict):
            said = {k: said[k] or take(part) for k, take in fields.items()}
        if said["name"] is not None:
            break
    return said


def _address(place: dict) -> str | None:
    given = place.get("address")
    if isinstance(given, dict):
        return ", ".join(t for k in _ADDRESS if (t := _text(given.get(k)))) or None
    return given if isinstance(given, str) else None


def _row(event: dict, page: str) -> dict | None:
    if not _text(event.get("name")) or "cancelled" in str(event.get("eventStatus", "")).lower():
        return None
    of = lambda key: lambda part: _text(part.get(key))
    place = _first(event.get("location"), {"name": of("name"), "phone": of("telephone"), "email": of("email"), "address": _address})
    host = _first(event.get("organizer"), {"name": of("name"), "phone": of("telephone"), "email": of("email"), "website": lambda part: absolute(_text(part.get("url")), page)})
    shown, ticket = _offers(event.get("offers"))
    row = {
        "name": _text(event["name"]), "start_iso": _text(event.get("startDate")), "end_iso": _text(event.get("endDate")), "description": _text(event.get("description")), "location_name": place["name"], "address": place["address"],
        "phone": place["phone"] or host["phone"], "email": place["email"] or host["email"], "organizer": host["name"] or _text(event.get("performer")), "website": host["website"],
        "detail_url": absolute(_text(event.get("url")), page) or page or None, "price_text": shown, "ticket_url": absolute(ticket, page),
    }
    row["raw_text"] = _JOINT.join(row[k] for k in ("name", "description", "location_name", "address", "organizer", "price_text") if row[k])
    return row | {"categories": [t for k in _CATEGORIES if (t := _text(event.get(k)))]}


def _parsed(block: str) -> object:
    """A block's JSON, comments and commas before a closing bracket left out; None if it is broken."""
    try:
        return json.loads(block)
    except ValueError:
        try:
            keep = lambda m: m[1] or ""
            return json.loads(_TRAILING.sub(keep, _LENIENT.sub(keep, block)))
        except (ValueError, RecursionError):
            return None


def linked_data(payloads: DataFrame, id_col: str, body: str, url: str | None = None) -> DataFrame:
    """A row (id, ordinal, fields) for each named event in a page's ld+json scripts that isn't cancelled, nested ones too; addresses are made whole by the page's url.

    Spark cuts the scripts out of the pages and only pages that have any reach Python. Broken scripts, nulls and pages without any give no row.
    """
    scripts = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(_SCRIPT), F.lit(1))
    page = F.coalesce(F.col(url), F.lit("")) if url else F.lit("")
    found = payloads.select(F.col(id_col).cast("long").alias("id"), page.alias("page"), scripts.alias("scripts")).where(F.size("scripts") > 0)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for i, page, blocks in zip(x["id"], x["page"], x["scripts"], strict=True):
                rows = [r for b in blocks for e in _events(_parsed(b)) if (r := _row(e, page))]
                out += [{"id": i, "ordinal": k} | r for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["id", "ordinal", *_FIELDS, "categories"])

    schema = "id long, ordinal int, " + ", ".join(f"{f} string" for f in _FIELDS) + ", categories array<string>"
    return found.mapInPandas(read, schema).withColumnRenamed("id", id_col)


def _items(body: str) -> list[dict]:
    try:
        root = ET.fromstring(body.strip())
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""
    out = []
    for item in root.iter():
        if local(item) in ("item", "entry"):
            parts = {}
            for part in item:
                parts.setdefault(local(part), part)
            said = lambda k, parts=parts: " ".join(_TAG.sub(" ", unescape("".join(parts[k].itertext()))).split()) if k in parts else ""
            link = (parts["link"].get("href") or said("link")) if "link" in parts else ""
            if said("title"):
                out.append({"name": said("title"), "detail_url": link, "description": said("description") or said("summary") or said("content")})
    return out


def feed_items(payloads: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row (id, ordinal, name, detail_url, description) for each titled item of an RSS or Atom payload; malformed ones and nulls give none."""
    feeds = payloads.select(F.col(id_col).cast("long").alias("id"), F.col(body).alias("body")).where(F.col(body).rlike("(?i)<(rss|feed|rdf)"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = [{"id": i, "ordinal": k} | r for i, b in zip(x["id"], x["body"], strict=True) for k, r in enumerate(_items(b))]
            yield pd.DataFrame(out, columns=["id", "ordinal", "name", "detail_url", "description"])

    return feeds.mapInPandas(read, "id long, ordinal int, name string, detail_url string, description string").withColumnRenamed("id", id_col)
