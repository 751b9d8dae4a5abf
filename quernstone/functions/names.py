"""What names, organizers, contacts and addresses are, and cleaning of what pages say."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quernstone.functions.text import LATIN_ONLY, collapse, latin_slug, slug, truncate

LONGEST_TEXT = 1200
# Fixed values. Prefixes and endings that don't belong to a name, and signs around it.
PREFIX, ENDING, AROUND = r"(?i)^\s*(?:agenda|evenement|activiteit)\s*[:\-–]\s*", r"(?i)\s*[|·•]\s*(?:VVV|Terschelling|Agenda)\s*$", " -–|•:»«"
# Fixed values. What menus and labels say, titles of sites, words of dates.
MENU = (
    r"(?iU)^(?:lees\s+meer|lees\s+verder|meer\s+info\w*|bekijk\s+\w+|klik\s+hier|terug|volgende|vorige|home|menu|cookie\w*|privacy\w*|nieuwsbrief|inloggen|zoeken|filter\w*|alle\s+\w+|toon\s+\w+|"
    r"vandaag|morgen|gisteren|overmorgen|today|tomorrow|bewerken|edit|(?:event|evenement)\s*details?|details|read\s+more|book\s+now|boek(?:en|ing)?\s+(?:uw|je|nu|hier|online)|reserveer|bestel|"
    r"koop\s+(?:uw|je|nu|tickets?|kaarten)|plan\s+(?:uw|je)|aanmelden|inschrijven|datum|tijd|locatie|adres|prijs|entree|organisator|categorie)\b"
)
SITE_TITLE = r"(?iU)^(?:evenementen\w*|agenda|activiteiten|uitagenda|uitjes|wat\s+te\s+(?:doen|beleven)|home|welkom|vakantie\w*|toerisme)\b"
WEEKDAYS = r"(?iU)\b(?:maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag|ma|di|wo|do|vr|za|zo)\b\.?"
DATE_WORDS = r"(?iU)\b(?:jan|feb|mrt|maart|apr|mei|jun|juni|jul|juli|aug|augustus|sep|sept|september|okt|oktober|nov|november|dec|december|januari|februari|april|uur|t/m|tot|en|van|de|het|een)\b"
CONTACT = (
    r"\b(?:contact(?:persoon)?|informatie bij|inlichtingen bij|meer info(?:rmatie)? bij|neem contact op met|aanmelden bij)\s*[:\-]?\s*"
    r"([A-ZÀ-Ý][\p{L}'’\-]+(?:\s+(?:van|de|den|der|ter|te)\s+)?(?:\s+[A-ZÀ-Ý][\p{L}'’\-]+){0,2})"
)
ADDRESS = r"(?U)\b[A-ZÀ-Ý][\w'’\-]*(?:\s+[A-ZÀ-Ýa-zà-ÿ][\w'’\-]*){0,3}(?:straat|laan|weg|plein|dijk|pad|kade|singel|dwarsstraat|buren|wal|hoek|steeg|gracht)\s+\d+\s?[a-zA-Z]?\b"
# Fixed values. Lengths of names, organizers and contacts, and words that an organizer has at most, with a dash and without.
LEAST_LETTERS, ORGANIZER_LENGTH, CONTACT_LENGTH, ORGANIZER_WORDS, DASHED_WORDS = 4, (2, 80), (3, 60), 9, 5
POSTCODE, FARTHEST_POSTCODE = r"\b\d{4}\s?[A-Z]{2}\b", 30


@pandas_udf(StringType())
def without_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape(t) if t and "&" in t else t)


def clean(text: Column) -> Column:
    """A text on one line, cut to LONGEST_TEXT; null if it says nothing."""
    line = collapse(without_entities(text))
    return F.when(~F.lower(line).isin("", "null", "n.v.t."), truncate(line, LONGEST_TEXT))


def without_noise(name: Column) -> Column:
    return F.btrim(collapse(F.regexp_replace(F.regexp_replace(name, PREFIX, ""), ENDING, "")), F.lit(AROUND))


def without_weekdays(text: Column) -> Column:
    return collapse(F.regexp_replace(text, WEEKDAYS, " "))


def is_name(name: Column) -> Column:
    """Whether a text can name an activity: no menu entry, not mostly digits, with a word beside dates."""
    words = F.split(collapse(F.regexp_replace(without_weekdays(F.regexp_replace(name, r"[\d:.\-–—/]+", " ")), DATE_WORDS, " ")), " ")
    kept = F.filter(words, lambda w: (F.char_length(w) >= 2) & w.rlike(r"\p{L}"))
    digits = F.regexp_count(name, F.lit(r"\p{Nd}"))
    return ~name.rlike(MENU) & ~name.rlike(r"\d[A-Z][a-z]") & (digits <= F.floor(F.char_length(name) / 2)) & (F.char_length(F.array_join(kept, "")) >= LEAST_LETTERS)


def is_organizer(text: Column) -> Column:
    """Whether a text can name an organizer: not the title of a site, no year, few words."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    dashed = (words > DASHED_WORDS) & text.rlike(r"\s[-–—]\s")
    return F.char_length(text).between(*ORGANIZER_LENGTH) & ~text.rlike(SITE_TITLE) & ~F.contains(text, F.lit("|")) & ~text.rlike(r"\b(?:19|20)\d{2}\b") & (words <= ORGANIZER_WORDS) & ~dashed


def find_contact(text: Column) -> Column:
    found = collapse(F.regexp_extract(F.coalesce(text, F.lit("")), CONTACT, 1))
    return F.when(F.char_length(found).between(*CONTACT_LENGTH), found)


def find_address(text: Column) -> Column:
    """The first street and number, with the postcode that follows within FARTHEST_POSTCODE characters; null without one."""
    given = F.coalesce(text, F.lit(""))
    street = F.regexp_extract(given, ADDRESS, 0)
    rest = F.substring(given, F.instr(given, street) + F.char_length(street), F.lit(FARTHEST_POSTCODE + 7))
    near = F.regexp_extract(rest, rf"^.{{0,{FARTHEST_POSTCODE - 1}}}?({POSTCODE})", 1)
    return F.when(street != "", F.when(near != "", F.concat(collapse(street), F.lit(", "), near)).otherwise(collapse(street)))


def once_each(text: Column) -> Column:
    """A list with commas without parts that repeat one before; other texts as they are."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.filter(parts, lambda p, i: F.array_position(F.transform(parts, _folded), _folded(p)) == i + 1)
    return F.when(F.size(kept) < F.size(parts), F.array_join(kept, ", ")).otherwise(text)


def _folded(part: Column) -> Column:
    """The slug of a part of Latin letters; of others, which Python would have to fold, the letters and digits in lower case."""
    others = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(part), "-_'’", "    "), r"[^\p{L}\p{Nd} ]", ""), " +", " "))
    return F.when(part.rlike(LATIN_ONLY), latin_slug(part)).otherwise(others)


def read_iso(text: Column) -> tuple[Column, Column]:
    """Date and minutes of the day of an ISO text as the wall clock there shows them; null where it has none."""
    pattern = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?\s*$"
    day = F.try_to_date(F.regexp_extract(text, pattern, 1), "yyyy-MM-dd")
    hour, minute = F.regexp_extract(text, pattern, 2).try_cast("int"), F.regexp_extract(text, pattern, 3).try_cast("int")
    return day, F.when(day.isNotNull() & (hour <= 23) & (minute <= 59), hour * 60 + minute)


def slug_of(*parts: Column) -> Column:
    return slug(F.concat_ws(" ", *parts))
