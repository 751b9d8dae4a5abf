"""Dutch and ISO dates and times in texts, as built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.fixed import MONTHS
from quernstone.functions.text import collapse, let

_NAMES = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
# Fixed values. How dates and times are written.
ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
ACROSS_MONTHS = rf"(?i)\b(\d{{1,2}})\s+({_NAMES})\.?\s*(\d{{4}})?\s*(?:t/m|tot en met|tm|-)\s*(\d{{1,2}})\s+({_NAMES})\.?\s*(\d{{4}})?\b"
WITHIN_MONTH = rf"(?i)\b(\d{{1,2}})\s*(?:t/m|tot en met|tm|-|/)\s*(\d{{1,2}})\s+({_NAMES})\.?\s*(\d{{4}})?\b"
TEXTUAL = rf"(?i)\b(\d{{1,2}})\s*(?:e|de|ste)?\s+({_NAMES})\.?\s*(\d{{4}})?\b"
NUMERIC = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})\b"
TIME_RANGE = r"(?i)\b([0-2]?\d)[:.u]([0-5]\d)\s*(?:-|tot|t/m|until|/)\s*([0-2]?\d)[:.u]([0-5]\d)\b"
STRICT_TIME = r"\b([0-2]?\d)[:.u]([0-5]\d)\b"
LOOSE_TIME = r"(?i)\b(?:om|vanaf|start(?:t)?(?:\s+om)?|aanvang)\s+([0-2]?\d)\s*uur\b"
RANGE_WORD = r"(?i)\b(tot|t/m|-|until)\b"
FARTHEST_END = 120
LONGEST_SPAN = 92


def plain(text: Column) -> Column:
    """Dashes become hyphens, white space single spaces."""
    return collapse(F.regexp_replace(text, "[–—]", "-"))


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.try_element_at(table, F.lower(name))


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, null if there is no such day between the years 1900 and 2200."""
    made = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    return F.when(y.between(1900, 2200) & m.isNotNull() & d.isNotNull(), made)


def _parts(text: Column, pattern: str, count: int, use: Callable[..., Column]) -> Column:
    """use of the groups of the first match, null without one; the text is scanned once and the match taken apart once.

    What of a match is no match by itself (a space at its end) stays at the last group, which is a number then or nothing.
    """
    groups = lambda found: F.split(F.regexp_replace(found, pattern, "\n".join(f"${i}" for i in range(1, count + 1))), "\n")
    taken = lambda found: F.when(found != "", let(groups(found), lambda p: use(*[F.get(p, F.lit(i)) for i in range(count)])))
    return let(F.regexp_extract(text, pattern, 0), taken)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _year(text: Column, other: Column) -> Column:
    y = _int(text)
    return F.when((y > 1900) & (y < 2200), y).otherwise(other)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _ordered(start: Column, end: Column, farthest: int | None = None) -> Column:
    """The span from start on, with its end if that comes later and not too late; null without a start."""

    def made(p: Column) -> Column:
        first, last = p["start"], p["end"]
        fits = last > first if farthest is None else (last > first) & (F.datediff(last, first) <= farthest)
        return F.when(first.isNotNull(), _span(first, F.when(fits, last)))

    return let(_span(start, end), made)


def date_range(text: Column, year: Column) -> Column:
    """The first date or range of dates in a text (struct start, end), null without one; year stands in where none is given.

    ISO dates come first, then ranges across months, ranges within a month, single dates in words, and day-month-year in digits;
    a form whose day doesn't exist gives way to the next one.
    """
    def whole(start: Column, end: Column) -> Column:
        """The span if both days exist."""
        return let(_span(start, end), lambda p: F.when(p["start"].isNotNull() & p["end"].isNotNull(), _ordered(p["start"], p["end"])))

    def across(d1: Column, m1: Column, y1: Column, d2: Column, m2: Column, y2: Column) -> Column:
        given = F.struct(_month(m1).alias("m1"), _month(m2).alias("m2"), _year(y2, year).alias("y"))
        return let(given, lambda g: whole(_date(_year(y1, F.when(g["m1"] > g["m2"], g["y"] - 1).otherwise(g["y"])), g["m1"], _int(d1)), _date(g["y"], g["m2"], _int(d2))))

    def within(d1: Column, d2: Column, m: Column, y: Column) -> Column:
        return let(F.struct(_month(m).alias("m"), _year(y, year).alias("y")), lambda g: whole(_date(g["y"], g["m"], _int(d1)), _date(g["y"], g["m"], _int(d2))))

    def in_words(said: Column) -> Column:
        one = _parts(F.coalesce(F.get(said, F.lit(0)), F.lit("")), TEXTUAL, 3, lambda d, m, y: F.struct(_year(y, year).alias("y"), _month(m).alias("m"), _int(d).alias("d")))
        two = lambda g: _parts(F.coalesce(F.get(said, F.lit(1)), F.lit("")), TEXTUAL, 3, lambda d, m, y: _date(_year(y, g["y"]), _month(m), _int(d)))
        return let(one, lambda g: _ordered(_date(g["y"], g["m"], g["d"]), two(g), FARTHEST_END))

    def in_digits(d: Column, m: Column, y: Column) -> Column:
        whole_year = let(_int(y), lambda n: F.when(n < 100, n + 2000).otherwise(n))
        return let(_date(whole_year, _int(m), _int(d)), lambda day: F.when(day.isNotNull(), _span(day, F.lit(None).cast("date"))))

    def iso(found: Column) -> Column:
        at = lambda i: _parts(F.coalesce(F.get(found, F.lit(i)), F.lit("")), ISO, 3, lambda y, m, d: _date(_int(y), _int(m), _int(d)))
        return _ordered(at(0), at(1))

    def read(t: Column) -> Column:
        return F.coalesce(
            let(F.regexp_extract_all(t, F.lit(ISO), F.lit(0)), iso),
            _parts(t, ACROSS_MONTHS, 6, across),
            _parts(t, WITHIN_MONTH, 4, within),
            let(F.regexp_extract_all(t, F.lit(TEXTUAL), F.lit(0)), in_words),
            _parts(t, NUMERIC, 3, in_digits),
        )

    return let(plain(text), read)


def _minutes(h: Column, m: Column) -> Column:
    return F.when(_int(h) <= 23, _int(h) * 60 + _int(m))


def times(text: Column) -> Column:
    """Start and end in minutes of the day (struct start, end), both null if no time is written."""
    none = F.lit(None).cast("int")

    def singly(t: Column) -> Column:
        each = F.transform(F.regexp_extract_all(t, F.lit(STRICT_TIME), F.lit(0)), lambda x: _minutes(F.regexp_extract(x, STRICT_TIME, 1), F.regexp_extract(x, STRICT_TIME, 2)))
        second = lambda found: F.when(t.rlike(RANGE_WORD), F.get(found, F.lit(1)))
        loose = _minutes(F.regexp_extract(t, LOOSE_TIME, 1), F.lit("0"))
        return let(F.array_compact(each), lambda found: F.when(F.size(found) > 0, _span(F.get(found, F.lit(0)), second(found))).otherwise(_span(loose, none)))

    def ranged(h1: Column, m1: Column, h2: Column, m2: Column) -> Column:
        return let(_minutes(h1, m1), lambda start: F.when(start.isNotNull(), _span(start, _minutes(h2, m2))))

    return let(plain(text), lambda t: F.coalesce(_parts(t, TIME_RANGE, 4, ranged), singly(t)))


def sane(date: Column, end_date: Column, start: Column, end: Column) -> dict[str, Column]:
    """end_date, start and end without what is nearly always a mistake: whole days as times, ends before starts, spans of months."""
    whole_day = F.coalesce((start == 0) & (end.isNull() | end.isin(0, 1439)), F.lit(False))
    first, last = F.when(~whole_day, start), F.when(~whole_day, end)
    until = F.when((end_date > date) & (F.datediff(end_date, date) <= LONGEST_SPAN), end_date)
    wrong = F.coalesce(until.isNull() & (last <= first), F.lit(False))
    return {"end_date": until, "start": first, "end": F.when(~wrong, last)}


# Fixed values. Days and months in Dutch, from Sunday and from January on.
DAYS = ("zondag", "maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag")
MONTH_NAMES = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")


def in_dutch(day: Column) -> Column:
    """A date in words, as vrijdag 12 juni 2026."""
    named = lambda words, i: F.get(F.array(*map(F.lit, words)), i - 1)
    return F.when(day.isNotNull(), F.concat_ws(" ", named(DAYS, F.dayofweek(day)), F.dayofmonth(day), named(MONTH_NAMES, F.month(day)), F.year(day)))


def coming_weekend(today: Column) -> Column:
    """The coming Friday to Sunday (struct start, end), or what is left of it if it has begun."""
    n = F.dayofweek(today)  # 1 is Sunday, 6 Friday, 7 Saturday
    start = F.when(n.isin(1, 6, 7), today).otherwise(F.next_day(today, "Fri"))
    return _span(start, F.when(n == 1, today).otherwise(F.next_day(start, "Sun")))


def quick_range(today: Column, asked: str) -> Column:
    """The days (struct start, end) that a short word asks for: today, tomorrow, weekend, or a number of days from today on; null for other words."""
    if asked == "weekend":
        return coming_weekend(today)
    if asked in ("today", "tomorrow"):
        return let(F.date_add(today, int(asked == "tomorrow")), lambda day: _span(day, day))
    number = re.match(r"\s*([+-]?\d+)", asked)
    return _span(today, F.date_add(today, int(number[1]) - 1)) if number else F.lit(None).cast("struct<start: date, end: date>")
