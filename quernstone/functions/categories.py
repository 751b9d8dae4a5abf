"""Categories by keywords, as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import let, slug_text

# Fixed values. Categories in the order in which they are shown, and those that bring another with them.
ORDER = ("Muziek", "Theater", "Cultuur", "Festival", "Natuur", "Excursie", "Wandelen", "Sport", "Markt", "Eten & Drinken", "Museum", "Kunst", "Workshop", "Kinderen", "Familie", "Nachtleven", "Overig")
IMPLIED = {"Festival": "Cultuur", "Kinderen": "Familie"}
OTHER = "Overig"


#: Keywords that a table of them has at most.
MOST_KEYWORDS = 5000


def keywords_of(rows: DataFrame) -> dict[str, tuple[str, ...]]:
    """The keywords of each category from a table (category, keyword), for classify. It is a small dimension, which is checked; categories that aren't in ORDER and blank keywords count for nothing."""
    found = rows.where(F.col("category").isin(*ORDER) & (F.trim("keyword") != "")).select("category", "keyword").distinct().limit(MOST_KEYWORDS + 1).collect()
    if len(found) > MOST_KEYWORDS:
        raise ValueError(f"a table of more than {MOST_KEYWORDS} keywords")
    return {c: tuple(sorted(r["keyword"] for r in found if r["category"] == c)) for c in ORDER}


def classify(slugged: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """The categories of a slugged text in ORDER: those of which a keyword begins some word; the other one if none fits, none for empty text.

    The keyword table is a parameter; each category is one pattern, so a text is scanned once for each.
    """

    def read(t: Column) -> Column:
        says = {}
        for name in ORDER:
            words = [re.escape(s) for s in map(slug_text, keywords.get(name, ())) if s]
            says[name] = t.rlike(rf"(?<![a-z0-9])(?:{'|'.join(words)})") if words else F.lit(False)
        for cause, effect in IMPLIED.items():
            says[effect] = says[effect] | says[cause]
        found = F.array_compact(F.array(*[F.when(says[name], name) for name in ORDER]))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(let(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit(OTHER))).otherwise(f)))

    return let(slugged, read)  # the slug and what is found are worked out once


def with_defaults(found: Column, defaults: Column) -> Column:
    """found and the known defaults of a source in ORDER, without the other one beside real ones."""
    order = F.array(*[F.lit(c) for c in ORDER])
    both = F.filter(order, lambda c: F.array_contains(found, c) | F.array_contains(defaults, c))
    return F.when(F.size(both) > 1, F.array_remove(both, OTHER)).otherwise(both)
