"""Activities in the JSON of site systems, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.names import without_entities
from quernstone.functions.text import collapse

_EVENT = "title string, start_date string, utc_start_date string, end_date string, utc_end_date string, description string, excerpt string, url string, cost string, venue string, organizer string, categories string"
_POST = "title string, content string, excerpt string, link string, meta string"
OUT = ("name", "start_iso", "end_iso", "date_text", "description", "location_name", "address", "phone", "website", "organizer", "price_text", "detail_url", "categories", "raw_text")
JOINT = " \n "


def _plain(text: Column) -> Column:
    """Without entities and tags; null if nothing is left."""
    return F.nullif(collapse(F.regexp_replace(without_entities(text), "<[^>]+>", " ")), F.lit(""))


def _said(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def _rendered(value: Column) -> Column:
    """A field that is a text or an object with a rendered text."""
    return F.coalesce(F.get_json_object(value, "$.rendered"), F.when(~value.startswith("{"), value))


def site_events(payloads: DataFrame, id_col: str, url: str, body: str) -> DataFrame:
    """A row for each activity of a calendar plug-in's answer ({"events": [...]}), and for each post of a list of posts.

    Events need a title and a start, posts a title; posts take their days from well-known fields or leave them to their text.
    Nulls, broken and other JSON give no row.
    """
    given = payloads.select(F.col(id_col), F.col(url).alias("_url"), F.col(body).alias("_body"))
    events = given.where(F.col("_body").rlike(r"\A\s*\{")).select(id_col, "_url", F.posexplode(F.from_json("_body", f"events array<struct<{_EVENT.replace(' string', ': string')}>>")["events"]).alias("ordinal", "e"))
    e, venue = F.col("e"), lambda k: _said(F.get_json_object(F.col("e.venue"), f"$.{k}"))
    address = F.array_join(F.array_compact(F.array(venue("address"), venue("zip"), venue("city"))), ", ")
    organizer = F.coalesce(F.get_json_object(e["organizer"], "$[0].organizer"), F.get_json_object(e["organizer"], "$.organizer"))
    named = F.from_json(F.coalesce(e["categories"], F.lit("[]")), "array<struct<name: string>>")
    categories = F.filter(F.transform(named, lambda c: c["name"]), lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    tribe = {
        "name": _plain(e["title"]), "start_iso": F.coalesce(_said(e["start_date"]), _said(e["utc_start_date"])), "end_iso": F.coalesce(_said(e["end_date"]), _said(e["utc_end_date"])),
        "date_text": F.lit(None).cast("string"), "description": _plain(F.coalesce(_said(e["description"]), _said(e["excerpt"]))), "location_name": venue("venue"), "address": F.nullif(address, F.lit("")),
        "phone": venue("phone"), "website": venue("website"), "organizer": _said(organizer), "price_text": _said(e["cost"]), "detail_url": F.coalesce(_said(e["url"]), "_url"), "categories": F.coalesce(categories, F.array().cast("array<string>")),
    }
    told = events.select(id_col, "ordinal", *[c.alias(k) for k, c in tribe.items()]).where("name is not null and start_iso is not null")
    told = told.withColumn("raw_text", F.concat_ws(JOINT, "name", "description", "location_name", "address", "organizer", "price_text"))

    posts = given.where(F.col("_body").rlike(r"\A\s*\[")).select(id_col, "_url", F.posexplode(F.from_json("_body", f"array<struct<{_POST.replace(' string', ': string')}>>")).alias("ordinal", "p"))
    p, meta = F.col("p"), lambda *keys: F.coalesce(*[_said(F.get_json_object(F.col("p.meta"), f"$.{k}")) for k in keys])
    none = F.lit(None).cast("string")
    post = {k: none for k in OUT} | {
        "name": _plain(_rendered(p["title"])), "description": _plain(F.coalesce(_rendered(p["content"]), _rendered(p["excerpt"]))), "detail_url": F.coalesce(_said(p["link"]), "_url"),
        "start_iso": meta("_EventStartDate", "event_start", "start_date"), "end_iso": meta("_EventEndDate", "event_end", "end_date"), "categories": F.array().cast("array<string>"),
    }
    written = posts.select(id_col, "ordinal", *[c.alias(k) for k, c in post.items() if k not in ("raw_text", "date_text")]).where("name is not null")
    written = written.withColumn("raw_text", F.concat_ws(JOINT, "name", F.coalesce("description", F.lit("")))).withColumn("date_text", F.col("raw_text"))
    return told.select(id_col, "ordinal", *OUT).unionByName(written.select(id_col, "ordinal", *OUT))
