"""Activities in the markup of pages: microdata, dated blocks, and links to pages of single activities.

Python only takes pages apart into rows of texts; dates, titles and the choice among blocks are built-in expressions and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import dates, names
from quernstone.functions.fixed import ASSETS
from quernstone.functions.text import collapse, find_email, find_phone, path_of, slug, truncate
from quernstone.plans.steps import settle
from quernstone.sources.selectors import matches

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_ITSELF = {"li": ("ul", "ol"), "tr": ("table",), "p": ("div", "section", "article", "li", "td")}
# Fixed values. Parts of class names (or tags) that mark blocks, titles, descriptions and places, in the order in which they are tried.
BLOCKS = (".event", ".agenda", ".activiteit", ".evenement", ".programma", ".kalender", ".calendar", "article", "li.", ".card", ".listing", ".tribe", ".post", "tr")
TITLES = ("h1", "h2", "h3", "h4", "h5", ".title", ".titel", ".naam", ".heading", ".summary", "a strong", "a")
DESCRIPTIONS = (".description", ".beschrijving", ".intro", ".excerpt", ".samenvatting", ".summary", "p")
LOCATIONS = (".location", ".locatie", ".venue", ".plaats", ".where", ".address", ".adres")
# Fixed values. Signs of dates, labels, sentences, and paths of activities.
DATED = r"(?i)\b\d{1,2}\s*(?:jan|feb|mrt|maart|apr|mei|jun|jul|aug|sep|okt|nov|dec)|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"
LABEL = (
    r"(?iU)^\s*(?:datum|date|tijd|time|wanneer|waar|locatie|location|adres|prijs|entree|kosten|aanvang|organisator|categorie|type|start|einde|van|tot|info|lees\s+meer|meer\s+info|bekijk|klik|terug|volgende|vorige|"
    r"home|menu|zoeken|filter|alle\s+evenementen|agenda|vandaag|morgen|gisteren|overmorgen|deze\s+week|volgende\s+week|dit\s+weekend|today|tomorrow|bewerken|edit|delen|share|reserveren|boeken|tickets?)\b\s*[:\-–,]?"
)
SENTENCE = (
    r"(?iU)^(?:met|voor|in|op|de|het|een|dit|deze|tijdens|onder|bij|na|door|with|for|during|the|this|at)\b.{28,}|"
    r".{45,}\b(?:en|and|of|or|maar|omdat|zodat|waarbij|waaronder|inclusief|including|meer|more)\b.{12,}"
)
FILLER = (
    r"(?iU)\b(?:jan|feb|mrt|maart|apr|mei|jun|juni|jul|juli|aug|augustus|sep|sept|september|okt|oktober|nov|november|dec|december|januari|februari|april|january|february|march|may|june|july|august|october|"
    r"uur|t/m|tot|en|van|de|het|een|gehele|dag|hele)\b"
)
DETAIL = r"event|agenda|activiteit|evenement|programma|voorstelling|concert|expositie|workshop|excursie|kalender|uitagenda|/\d{4}/\d{2}"
NOT_DETAIL = r"/(?:wp-admin|wp-login|privacy|cookie|contact|nieuwsbrief|sitemap|tag|author|feed)"
SHORTEST, LONGEST, ENOUGH, MOST_BLOCKS = 12, 1400, 3, 400
JOINT = " \n "
_DATED = re.compile(DATED)


class Node:
    """An element with what is in it."""

    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo.extend(reversed(x.parts))
        return " ".join("".join(out).split())

    def below(self) -> Iterator[Node]:
        todo = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))

    def fits(self, rule: str) -> bool:
        """Rules are a tag, .part of a class, a tag with any class (li.), or a tag inside a link (a strong); links need an address."""
        if rule.startswith("."):
            return rule[1:] in self.attrs.get("class", "").lower()
        if rule.endswith("."):
            return self.tag == rule[:-1] and "class" in self.attrs
        if rule == "a strong":
            return self.tag == "strong" and self.link_above() is not None
        return self.tag == rule and (rule != "a" or "href" in self.attrs)

    def link_above(self) -> str | None:
        x = self
        while x is not None:
            if x.tag == "a" and "href" in x.attrs:
                return x.attrs["href"]
            x = x.parent
        return None


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_ITSELF:
            x = self.at
            while x.parent is not None and x.tag not in _CLOSES_ITSELF[tag] and x.tag != tag:
                x = x.parent
            if x.tag == tag:
                self.at = x.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def _rows(pages: DataFrame, id_col: str, url: str, body: str, sign: Column, take: Callable[[Node, str, str], Iterator[tuple]], columns: str, hint: str | None = None) -> DataFrame:
    """take() of each page, its address and its source's hint as rows id, page_url, ordinal and columns; pages without the sign don't reach Python."""
    fields = [c.split(" ")[0] for c in columns.split(", ")]
    told = F.coalesce(F.trim(hint), F.lit("")) if hint else F.lit("")
    given = pages.where(F.coalesce(sign, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("page_url"), F.col(body).alias("body"), told.alias("hint"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = [(i, u, k, *row) for i, u, b, h in zip(x["id"], x["page_url"], x["body"], x["hint"], strict=True) for k, row in enumerate(take(tree(b), u, h))]
            yield pd.DataFrame(out, columns=["id", "page_url", "ordinal", *fields])

    return given.mapInPandas(read, f"id long, page_url string, ordinal int, {columns}").withColumnRenamed("id", id_col)


def absolute(href: str | None, base: str) -> str | None:
    """An address made whole by its page's, null if it is no web address."""
    try:
        whole = urljoin(base, (href or "").strip())
    except ValueError:
        return None
    return whole if href and whole.startswith(("http://", "https://")) else None


_PROPERTIES = {"name": "name", "start_iso": "startDate", "end_iso": "endDate", "description": "description", "location_name": "location", "address": "address", "organizer": "organizer", "price_text": "price"}


def _items(root: Node, url: str, _: str) -> Iterator[tuple]:
    for scope in root.below():
        if "itemscope" in scope.attrs and "event" in scope.attrs.get("itemtype", "").lower():
            said, link = {}, None
            for x in scope.below():
                for prop in x.attrs.get("itemprop", "").lower().split():
                    said.setdefault(prop, " ".join((x.attrs.get("content") or x.attrs.get("datetime") or "").split()) or x.text())
                if link is None and x.fits("a"):
                    link = x.attrs["href"]
            if said.get("name"):
                yield *[said.get(p.lower()) for p in _PROPERTIES.values()], absolute(link, url) or url, scope.text()


def microdata(pages: DataFrame, id_col: str, url: str, body: str) -> DataFrame:
    """A row for each named Event of a page's microdata. Null and broken pages give what can be read."""
    return _rows(pages, id_col, url, body, F.col(body).rlike("(?i)itemscope"), _items, ", ".join(f"{c} string" for c in (*_PROPERTIES, "detail_url", "raw_text")))


def _links(root: Node, url: str, _: str) -> Iterator[tuple]:
    for x in root.below():
        if x.fits("a") and (link := absolute(x.attrs["href"], url)):
            yield link, x.text()


def detail_links(pages: DataFrame, id_col: str, url: str, body: str, most: Column) -> DataFrame:
    """The first `most` links of a page that may lead to single activities (most: a column of id_col's rows or a constant), in order of appearance."""
    found = _rows(pages, id_col, url, body, F.col(body).rlike("(?i)<a\\s"), _links, "link string, text string")
    host = lambda c: F.regexp_extract(F.lower(c), r"^https?://([^/?#:]+)", 1)
    path = F.lower(path_of(F.col("link")))
    fit = (host(F.col("link")) == host(F.col("page_url"))) & (F.char_length(path) >= 6) & ~path.rlike(rf"\.(?:{'|'.join(ASSETS)})$") & ~path.rlike(NOT_DETAIL) & path.rlike(DETAIL)
    told = F.col("text").rlike(DATED) | (F.char_length("text") > SHORTEST)
    by_page = Window.partitionBy(id_col)
    first = F.row_number().over(Window.partitionBy(id_col, F.lower("link")).orderBy("ordinal"))
    kept = found.withColumn("_first", first).where((F.col("_first") == 1) & fit & told).withColumn("place", F.row_number().over(by_page.orderBy("ordinal")))
    return kept.where(F.col("place") <= most).select(id_col, "place", "link")


def _blocks(root: Node, url: str, hint: str) -> Iterator[tuple]:
    """Blocks under the kinds that they are of; what the source's hint finds comes before all kinds, as number -1."""
    for n in root.below():
        kinds = [-1] * (hint != "" and matches(n, hint)) + [k for k, rule in enumerate(BLOCKS) if n.fits(rule)]
        if not kinds:
            continue
        text = n.text()
        if SHORTEST <= len(text) <= LONGEST and _DATED.search(text) and sum(bool(_DATED.search(p.text())) for p in n.parts if isinstance(p, Node)) <= 1:
            inside = list(n.below())
            first = lambda rules, inside=inside: [next((x.text() for x in inside if x.fits(r)), "") for r in rules]
            link = next((x.attrs["href"] for x in inside if x.fits("a")), None) or n.link_above()
            yield kinds, text, first(TITLES), first(DESCRIPTIONS), first(LOCATIONS), absolute(link, url) or url


def usable_title(t: Column) -> Column:
    """Whether a text can be the title of an activity: no label, date, sentence or lump, and two words beside dates."""
    wordy = F.regexp_replace(t, r"[\d:.\-–—/]+", " ")
    words = F.filter(F.split(wordy, r"\s+"), lambda w: (F.char_length(w) >= 2) & w.rlike(r"\p{L}"))
    left = collapse(F.regexp_replace(names.without_weekdays(wordy), FILLER, " "))
    undated = F.regexp_replace(F.regexp_replace(names.without_weekdays(t), DATED, " "), r"(?iU)\b(?:uur|t/m|tot en met|tot|en)\b", " ")
    only_date = F.char_length(collapse(F.regexp_replace(undated, r"[\d\s:.\-–—/]+", " "))) < 4
    lump = t.rlike(r"\d[A-Z][a-z]") | (t.endswith(".") & (F.size(F.split(t, " ")) > 6))
    return F.char_length(t).between(4, 120) & ~t.rlike(LABEL) & ~t.rlike(SENTENCE) & ~only_date & ~lump & (F.size(words) >= 2) & (F.char_length(left) >= 4)


def dated_blocks(pages: DataFrame, id_col: str, url: str, body: str, year: int, hint: str | None = None) -> DataFrame:
    """Activities from blocks of a page that show a date and a title, for pages without better data.

    hint names a column with a selector that the page's source gives for its blocks; it is tried first, and what is no selector is passed over. Kinds of blocks are tried in order until one gives ENOUGH new activities; equal names with equal texts count once, MOST_BLOCKS a page is
    the limit that the feature has.
    """
    columns = "kinds array<int>, text string, titles array<string>, descriptions array<string>, locations array<string>, detail_url string"
    found = _rows(pages, id_col, url, body, F.col(body).rlike(DATED), _blocks, columns, hint)
    title = F.get(F.filter("titles", usable_title), F.lit(0))
    lead = r"(?i)^\s*(?:lees meer|meer info|bekijk)\s*[:\-–]?\s*"
    named = settle(found.withColumns({"_title": title, "span": dates.date_range(F.col("text"), F.lit(year))}))  # long expressions, else worked out again in all that is made of them
    named = named.where("_title is not null and span is not null").withColumn("name", F.btrim(collapse(F.regexp_replace("_title", lead, "")), F.lit(" -–|•:")))
    named = settle(named.drop("_title").withColumns({"clock": dates.times(F.col("text")), "slug": slug("name")}))
    each = named.withColumn("kind", F.explode("kinds"))
    once = F.row_number().over(Window.partitionBy(id_col, "slug", "text").orderBy("kind", "ordinal"))
    each = each.withColumn("_once", once).where("_once = 1")
    each = each.withColumn("_got", F.count("*").over(Window.partitionBy(id_col, "kind")))
    before = F.max(F.col("_got") >= ENOUGH).over(Window.partitionBy(id_col).orderBy("kind").rangeBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("kind", "ordinal"))
    kept = each.withColumn("_over", F.coalesce(before, F.lit(False))).where("not _over").withColumn("place", place).where(F.col("place") <= MOST_BLOCKS)

    clock = lambda m: F.concat(F.lit("T"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(":00"))
    iso = lambda d, m: F.when(d.isNotNull(), F.concat(F.date_format(d, "yyyy-MM-dd"), F.coalesce(clock(m), F.lit(""))))
    told = F.get(F.filter("descriptions", lambda d: F.char_length(d) >= 25), F.lit(0))
    rest = collapse(F.replace(F.col("text"), F.col("name"), F.lit(" ")))
    labelled = collapse(F.regexp_extract("text", r"(?i)\b(?:locatie|plaats|waar|adres)\s*[:\-]\s*([^|•\n]{2,120})", 1))
    text = F.col("text")
    return kept.select(
        id_col, "page_url", "place", "name", iso(F.col("span.start"), F.col("clock.start")).alias("start_iso"), iso(F.col("span.end"), F.col("clock.end")).alias("end_iso"),
        truncate(F.coalesce(told, F.when(F.char_length(rest) >= 30, rest)), 800).alias("description"),
        F.coalesce(F.get(F.filter("locations", lambda x: F.char_length(x).between(2, 140)), F.lit(0)), F.nullif(labelled, F.lit(""))).alias("location_name"),
        names.find_address(text).alias("address"), find_phone(text).alias("phone"), find_email(text).alias("email"), "detail_url", text.alias("raw_text"),
    )
