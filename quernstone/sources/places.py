"""The registry of places from raw rows, and hits from recorded result pages of search engines."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.sources.markup import Node, _rows

# Fixed values. Kinds of places by what their raw kind says, the first that fits.
KINDS = (
    ("^dorp$", "dorp"), ("^buurtschap$", "buurtschap"), ("^gehucht$", "gehucht"), ("venue|paviljoen|camping|hotel|jeugdherberg|theater|museum|kerk|caf", "venue"), ("strand", "strand"),
    ("natuurgebied|meer|duin|bos|polder|zandplaat|eiland|vallei", "natuurgebied"), ("landmark|baken|historisch|haven", "landmark"), ("festival", "evenement"),
)
OTHER_KIND = "overig"
# Fixed values. Names too general to search for, and variants that are places elsewhere.
NOT_SEARCHED = ("Terschelling", "Waddenzee", "Noordzee", "Griend", "Wadden")
RISKY = ("Zeerijp", "Kaart", "West", "Hoorn", "Lies", "Oosterend", "Hee", "Noordhoek", "Halfweg", "Duunt")
LONGEST_DROPPED = 2


def kind_of(raw: Column) -> Column:
    return F.coalesce(*[F.when(raw.rlike(f"(?i){p}"), kind) for p, kind in KINDS], F.lit(OTHER_KIND))


def build_places(raw: DataFrame) -> DataFrame:
    """Places (name, type, parent, variants, source, ambiguous, use_as_search_term) from raw rows of the same columns but the last."""
    lower = lambda words: [w.lower() for w in words]
    fits = lambda v: (F.char_length(F.trim(v)) > LONGEST_DROPPED) & ~F.lower(v).isin(lower(RISKY))
    variants = F.filter(F.coalesce("variants", F.array().cast("array<string>")), lambda v: F.coalesce(fits(v), F.lit(False)))
    return raw.select(
        "name", kind_of(F.coalesce("type", F.lit(""))).alias("type"), F.nullif("parent", F.lit("")).alias("parent"), variants.alias("variants"), "source",
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), (~F.lower("name").isin(lower(NOT_SEARCHED))).alias("use_as_search_term"),
    )


def _unwrapped(href: str | None) -> str | None:
    """The address that a redirect of an engine leads to; None if it is no web address or the engine's own."""
    whole = f"https:{href}" if href and href.startswith("//") else href or ""
    try:
        target = parse_qs(urlsplit(whole).query).get("uddg", [whole])[0]
        parts = urlsplit(target)
    except ValueError:
        return None
    return target if parts.scheme in ("http", "https") and parts.netloc and "duckduckgo.com" not in parts.netloc else None


def _has(node: Node, *names: str) -> bool:
    return bool(set(node.attrs.get("class", "").split()) & set(names))


def _hits(root: Node, url: str, _: str) -> Iterator[tuple]:
    """Results of the engines whose pages mark each result: its link, title and snippet."""
    for block in root.below():
        inside = list(block.below())
        text = lambda *names, inside=inside: next((x.text() for x in inside if _has(x, *names)), "")
        if block.tag == "div" and _has(block, "snippet") and (block.attrs.get("data-type") == "web" or "data-pos" in block.attrs):
            link = next((x for x in inside if x.tag == "a" and x.attrs.get("href", "").startswith("http")), None)
            if link is not None:
                yield link.attrs["href"], text("title", "snippet-title") or link.text(), text("snippet-description", "snippet-content"), "brave"
        elif block.tag == "div" and _has(block, "result", "web-result"):
            link = next((x for x in inside if x.tag == "a" and _has(x, "result__a")), None)
            target = _unwrapped(link.attrs.get("href")) if link is not None else None
            if target:
                yield target, link.text(), text("result__snippet"), "duckduckgo"


def search_hits(pages: DataFrame, id_col: str, url: str, body: str) -> DataFrame:
    """A row (id, page_url, ordinal, link, title, snippet, engine) for each result of recorded result pages. Other pages and nulls give none."""
    hint = F.col(body).rlike(r"class\s*=\s*[\"'][^\"']*(?:snippet|result)")
    return _rows(pages, id_col, url, body, hint, _hits, "link string, title string, snippet string, engine string")
