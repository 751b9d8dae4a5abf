"""iCalendar payloads as rows, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import collapse


def _property(block: Column, name: str, pattern: str = r"[^\r\n]*") -> Column:
    found = F.regexp_extract(block, rf"(?mi)^{name}(?:;[^:\r\n]*)?:({pattern})", 1)
    return F.when(found != "", found)


def _plain(value: Column) -> Column:
    """A value without the escapes of the format."""
    for escape, meaning in (("\\n", " "), ("\\N", " "), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        value = F.replace(value, F.lit(escape), F.lit(meaning))
    return F.when(value.isNotNull(), collapse(value))


def iso_of(stamp: Column) -> Column:
    """20260612T200000Z as 2026-06-12T20:00:00Z and 20260612 as 2026-06-12; others as they are."""
    full = F.regexp_replace(stamp, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)$", "$1-$2-$3T$4:$5:$6$7")
    return F.regexp_replace(full, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def read_calendar(payloads: DataFrame, body: str) -> DataFrame:
    """payloads with one row for each event of their calendar that has a name and isn't cancelled.

    Folded lines are joined first. Recurring events are listed once, as written. No event, a null or another format gives no row.
    """
    unfolded = F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?si)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))
    rows = payloads.select("*", F.posexplode(blocks).alias("ordinal", "_block"))
    block = F.col("_block")
    organizer = F.coalesce(F.nullif(F.regexp_extract(block, r"(?mi)^ORGANIZER[^:\r\n]*;CN=\"?([^\":;\r\n]+)", 1), F.lit("")), F.regexp_replace(_property(block, "ORGANIZER"), "(?i)^mailto:", ""))
    out = {
        "name": _plain(_property(block, "SUMMARY")),
        "start_iso": iso_of(F.trim(_property(block, "DTSTART"))),
        "end_iso": iso_of(F.trim(_property(block, "DTEND"))),
        "description": _plain(_property(block, "DESCRIPTION")),
        "location_name": _plain(_property(block, "LOCATION")),
        "detail_url": F.trim(_property(block, "URL")),
        "organizer": _plain(organizer),
        "categories": F.filter(F.transform(F.split(F.coalesce(_property(block, "CATEGORIES"), F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != ""),
    }
    cancelled = F.coalesce(F.upper(F.trim(_property(block, "STATUS"))) == "CANCELLED", F.lit(False))
    return rows.where(~cancelled).select(*[c for c in payloads.columns if c != body], "ordinal", *[c.alias(k) for k, c in out.items()]).where("name <> ''")
