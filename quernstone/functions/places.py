"""Places of a gazetteer in texts, the village of an activity, and whether it is on the island."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from quernstone.functions.fixed import UNKNOWN
from quernstone.functions.text import slug_text

# Fixed values. How much a kind of place weighs; signs of the island and of other places.
WEIGHTS = {"dorp": 100, "buurtschap": 90, "gehucht": 85, "venue": 80, "landmark": 60, "natuurgebied": 50, "strand": 45}
OTHER_WEIGHT, MOST_LETTERS, FEWEST_LETTERS = 40, 20, 3
ISLAND = r"(?iu)\b(?:terschelling|schylge|skylge|west-?terschelling|midsland|formerum|baaiduinen|landerum|kinnum|striep|oosterend\s*\(?terschelling|brandaris|boschplaat|oerol|noordsvaarder|koegelwieck|griltjeplak|888[0-9]|889[0-9])\b"
ELSEWHERE = r"(?iu)\b(?:texel|vlieland|ameland|schiermonnikoog|den\s+helder|oudeschild|den\s+burg|harlingen|leeuwarden|franeker|bolsward|sneek|dokkum|groningen|nes\s*\(?ameland|hollum|ballum|buren\s*\(?ameland|oost-?vlieland)\b"
HEAD, FEWEST_LEFT = 220, 4
TELLING = ("dorp", "buurtschap", "gehucht", "venue", "landmark")
# Fixed values. Words beside the name of a place that don't make it an activity.
QUALIFIERS = r"\b(?:centrum|dorp|dorpshuis|haven|strand|paal|kerk|plein|straat|weg|west|oost|noord|zuid|aan|zee|terschelling|het|de|een|en|van|bij|op|in|nl|nederland)\b"

#: Places that a gazetteer has at most.
MOST_PLACES = 2000


@dataclass(frozen=True)
class Place:
    name: str
    kind: str = "overig"
    parent: str | None = None
    variants: tuple[str, ...] = ()
    ambiguous: bool = False

    @property
    def names(self) -> list[str]:
        return [n for n in (self.name, *self.variants) if n and n.strip()]


_JOINTS = re.compile(r"[\s\-]+")


def _folded(text: str) -> str:
    """Text in which all that a name's pattern takes for the same is the same: cases, and runs of white space and hyphens."""
    return _JOINTS.sub(" ", text.replace("\u00a0", " ").casefold().replace("ı", "i").replace("i\u0307", "i"))


#: Characters outside of these may become letters, or cease to be, when cases are folded; within, folding keeps the edges of words.
_ODD = re.compile("[^\u0000-\u024f\u2000-\u206f\u20a0-\u20cf]")


class _Finder:
    """One automaton over all names of a gazetteer: a text is read once, and only names that stand in it as whole words are looked at closely. A name's pattern would read the
    whole text again, so it isn't asked where text and name are ASCII and the name is words with single spaces, for which folding says all that the pattern does.
    """

    def __init__(self, places: tuple[Place, ...]):
        found = []
        for p in places:
            for name in {n.lower(): n for n in reversed(p.names)}.values():
                if len(name) >= FEWEST_LETTERS:
                    found.append((-WEIGHTS.get(p.kind, OTHER_WEIGHT) - min(len(name), MOST_LETTERS), name, p.name))
        self.names = [(name, place) for _, name, place in sorted(found, key=lambda x: x[0])]  # stable, so equal ones keep their order
        by_letters: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(self.names):
            by_letters.setdefault(_folded(name), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for letters, which in by_letters.items():
            self.automaton.add_word(letters, (len(letters) - 1, which, letters == letters.strip(" ")))
        if by_letters:
            self.automaton.make_automaton()
        self.simple = [name.isascii() and _folded(name) == name.lower().strip() for name, _ in self.names]
        self.patterns: dict[int, re.Pattern] = {}

    def _fits(self, i: int, hay: str) -> bool:
        """Whether name i stands in hay between other characters than letters and digits."""
        if i not in self.patterns:
            body = r"[\s\-]+".join(map(re.escape, self.names[i][0].split(" ")))
            self.patterns[i] = re.compile(rf"(?<![^\W_]){body}(?![^\W_])", re.IGNORECASE)
        return self.patterns[i].search(hay) is not None

    def __call__(self, text: str | None) -> list[str]:
        hay = (text or "").replace("\u00a0", " ")
        if not self.names or not hay.strip():
            return []
        padded, found, odd, plain = f" {_folded(hay)} ", {}, _ODD.search(hay), hay.isascii()
        for end, (more, which, edged) in self.automaton.iter(padded[1:-1]):
            if which[0] not in found and (odd or not edged or not (padded[end + 2].isalnum() or padded[end - more].isalnum())):
                found[which[0]] = which
        near = sorted(i for which in found.values() for i in which)
        return list(dict.fromkeys(self.names[i][1] for i in near if (plain and self.simple[i]) or self._fits(i, hay)))


@lru_cache(4)
def _finder(places: tuple[Place, ...]) -> _Finder:
    return _Finder(places)


@dataclass
class Gazetteer:
    """A list of places of some thousands at most, which travels with the functions that use it."""

    places: list[Place]

    @classmethod
    def of(cls, rows: DataFrame) -> Gazetteer:
        """From a table name, type, parent, variants, ambiguous. It is a small dimension, which is checked."""
        found = rows.select("name", "type", "parent", "variants", "ambiguous").limit(MOST_PLACES + 1).collect()
        if len(found) > MOST_PLACES:
            raise ValueError(f"a gazetteer of more than {MOST_PLACES} places")
        return cls([Place(r["name"], r["type"], r["parent"], tuple(r["variants"] or ()), bool(r["ambiguous"])) for r in found])

    def found_in(self, text: str | None) -> list[str]:
        """Names of the places that a text mentions, the weightiest first."""
        return _finder(tuple(self.places))(text)

    def find(self, text: Column) -> Column:
        """found_in of a column. A Python worker builds the automaton once."""
        places = tuple(self.places)

        @pandas_udf(ArrayType(StringType()))
        def names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = _finder(places)
            for texts in batches:
                yield texts.map(finder)

        return names(text)

    def _named(self, fits) -> Column:
        return F.array(*[F.lit(p.name) for p in self.places if fits(p)]).cast("array<string>")

    def village(self, hits: Column) -> Column:
        """The first village among places found, else the first hamlet, else the place that the first one with a parent belongs to."""
        first = lambda names: F.get(F.filter(hits, lambda h: F.array_contains(names, h)), F.lit(0))
        by_lower = {p.name.lower(): p.name for p in reversed(self.places)}
        parents = {p.name: by_lower.get(p.parent.lower(), UNKNOWN) for p in self.places if p.parent and p.parent.strip()}
        of = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv]) if parents else F.create_map().cast("map<string,string>")
        parent = F.try_element_at(of, first(self._named(lambda p: p.name in parents)))
        return F.coalesce(first(self._named(lambda p: p.kind == "dorp")), first(self._named(lambda p: p.kind in ("buurtschap", "gehucht"))), parent, F.lit(UNKNOWN))

    def on_island(self, text: Column, url: Column, island_source: Column) -> Column:
        """Whether an activity is on the island: not if only another place is named at the beginning; else if its source is, a sign of the island or a clear place is found."""
        hay = F.concat(F.coalesce(text, F.lit("")), F.lit(" \n "), F.coalesce(url, F.lit("")))
        head = F.substring(hay, 1, HEAD)
        clear = F.arrays_overlap(self.find(hay), self._named(lambda p: not p.ambiguous and p.kind in TELLING))
        return F.when(head.rlike(ELSEWHERE) & ~head.rlike(ISLAND), False).otherwise(F.coalesce(island_source, F.lit(False)) | hay.rlike(ISLAND) | clear)

    def only_place(self, slugged: Column, hits: Column) -> Column:
        """Whether a slugged name says no more than a place: what is left without the names of its places and their qualifiers is short."""
        known = {p.name: [s for s in map(slug_text, p.names) if s] for p in self.places}
        of = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]) if known else F.create_map().cast("map<string,array<string>>")
        names = F.flatten(F.transform(hits, lambda h: F.coalesce(F.try_element_at(of, h), F.array().cast("array<string>"))))
        rest = F.aggregate(names, slugged, lambda s, n: F.replace(s, n, F.lit(" ")))
        left = F.trim(F.regexp_replace(F.regexp_replace(rest, QUALIFIERS, " "), r"\s+", " "))
        return (F.size(hits) > 0) & (F.char_length(left) < FEWEST_LEFT)


def only_elsewhere(text: Column) -> Column:
    """Whether a text names another place and has no sign of the island."""
    return F.coalesce(text.rlike(ELSEWHERE) & ~text.rlike(ISLAND), F.lit(False))
