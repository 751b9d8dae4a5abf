"""Prices and reservations as texts state them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.dates import plain
from quernstone.functions.fixed import DONATION, FREE, RESERVATION_NO, RESERVATION_YES, UNKNOWN
from quernstone.functions.text import slug_text

# Fixed values. An amount in euros.
AMOUNT = r"(?i)(?:€|EUR\s?)\s?(\d{1,4}(?:[.,]\d{1,2})?)"


def _says(slugged: Column, phrases: tuple[str, ...]) -> Column:
    return slugged.rlike("|".join(slug_text(p) for p in phrases))


def price(text: Column, slugged: Column) -> Column:
    """Struct price and kind (Betaald, Gratis, Onbekend); several amounts show the first and the last in order of appearance."""
    found = F.regexp_extract_all(plain(text), F.lit(AMOUNT), F.lit(1))
    amounts = F.array_distinct(F.filter(found, lambda a: F.replace(a, F.lit(","), F.lit(".")).try_cast("decimal(10,2)") > 0))
    free = _says(slugged, FREE)
    shown = F.when(F.size(amounts) == 1, F.concat(F.lit("€ "), F.get(amounts, F.lit(0)))).otherwise(F.concat(F.lit("€ "), F.get(amounts, F.lit(0)), F.lit(" – € "), F.get(amounts, F.size(amounts) - 1)))
    shown = F.concat(shown, F.when(free, " (deels gratis)").otherwise(""))
    row = lambda p, k: F.struct(p.alias("price"), F.lit(k).alias("kind"))
    return F.when(F.size(amounts) > 0, row(shown, "Betaald")).when(free, row(F.lit("Gratis"), "Gratis")).when(_says(slugged, DONATION), row(F.lit("Vrije gift"), "Gratis")).otherwise(row(F.lit(UNKNOWN), UNKNOWN))


def reservation(slugged: Column) -> Column:
    """Nee, Ja or Onbekend; what says no is looked for first."""
    return F.when(_says(slugged, RESERVATION_NO), "Nee").when(_says(slugged, RESERVATION_YES), "Ja").otherwise(UNKNOWN)
