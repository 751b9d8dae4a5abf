"""Names that meet, websites, blocks of days and hints of sources against plain procedures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_resolve import DAY, activity, bare, lev, near, table
from test_resolve import alike as likeness

from quernstone.functions import text
from quernstone.operators import alike, components, resolve
from quernstone.sources import markup, selectors


def test_alike_names_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(alike, "TILE", 7)
    rng = random.Random(3)
    words = ["concert", "concerten", "koor", "kerkkoor", "veemarkt", "beestenmarkt", "markt", "midsland", "midslander", "2026", "é", "a", "zaal", "grote", "grotte", "zomeravond", "zomeravonden"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(60)} | {"x", "yz", "abc", "abd", "concert!", "Cóncert"})
    rows = [(("hot" if i % 3 else "b"), n) for i, n in enumerate(names)]
    given = spark.createDataFrame(rows, "block string, name string").select("block", "name", *alike.form_of(F.col("name")))
    forms = given.select("block", "form", "slug", "words").distinct()
    by_form = {}
    for r in given.collect():
        by_form.setdefault((r["block"], r["form"]), r["name"])
    for least in (0.62, 0.80):
        got = {(r["a"], r["b"]): (r["like"], r["back"]) for r in alike.alike(forms, forms, least).collect()}
        want = {}
        for (g, a), x in by_form.items():
            for (h, b), y in by_form.items():
                if g == h and max(likeness(x, y), likeness(y, x)) >= least:
                    want[a, b] = (likeness(x, y), likeness(y, x))
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want if k[0] != k[1])


def test_matching_words_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = {"".join(rng.choices("abc", k=rng.randint(3, 16))) for _ in range(150)}
    for w in list(vocabulary):
        for _ in range(2):
            i = rng.randrange(len(w))
            vocabulary |= {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1 :], w + "en"}
    vocabulary.discard("")
    got = {tuple(r) for r in alike.matching_words(spark.createDataFrame([(w,) for w in vocabulary], "word string")).collect()}
    assert got == {(a, b) for a in vocabulary for b in vocabulary if a != b and near(a, b)}
    assert lev("kitten", "sitting") == 3


def test_components_of_stars_and_chains(spark):
    rng = random.Random(9)
    links = [(0, i) for i in range(1, 4000)] + [(10_000 + i, 10_001 + i) for i in range(120)] + [(20_000 + rng.randrange(300), 20_000 + rng.randrange(300)) for _ in range(200)] + [(7_000_000, 7_000_000), (None, 3)]
    rng.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_days_are_in_one_block_of_each_range_that_holds_them(spark):
    rng = random.Random(2)
    ranges = [(dt.date(1969, 1, 1) + dt.timedelta(rng.randrange(40_000)), rng.choice([0, 1, 2, 6, 31, 400, 9000])) for _ in range(60)]
    rows = [(a, a + dt.timedelta(n), a + dt.timedelta(k)) for a, n in ranges for k in {-1, 0, n // 2, n, n + 1}]
    given = spark.createDataFrame(rows, "a date, b date, d date")
    out = given.select("a", "b", "d", F.size(F.array_intersect(resolve.blocks_within(F.col("a"), F.col("b")), resolve.blocks_of(F.col("d")))).alias("n"), F.size(resolve.blocks_within(F.col("a"), F.col("b"))).alias("many")).collect()
    assert all(r["n"] == int(r["a"] <= r["d"] <= r["b"]) and r["many"] <= 2 * resolve.LEVELS + 3 for r in out)


def _absorbed(rows):
    """The procedure one after another: hosts from the longest on, parts by date and arrival, villages learned on the way."""
    events = [dict(r) for r in rows]
    gone = set()
    for host in sorted((e for e in events if e["end_date"] and e["end_date"] > e["date"]), key=lambda e: (-(e["end_date"] - e["date"]).days, e["date"], e["ord"])):
        if host["ord"] in gone:
            continue
        for part in sorted(events, key=lambda e: (e["date"], e["ord"])):
            if part is host or part["ord"] in gone or part["date"] < host["date"] or (part["end_date"] or part["date"]) > host["end_date"]:
                continue
            if max(likeness(host["name"], part["name"]), likeness(bare(host), bare(part))) < 0.80:
                continue
            if host["village"] and part["village"] and host["village"] != part["village"]:
                continue
            host["village"] = host["village"] or part["village"]
            host["start"] = host["start"] if host["start"] is not None else part["start"]
            host["duplicate_count"] += part["duplicate_count"]
            gone.add(part["ord"])
    return {e["ord"]: (e["village"], e["start"], e["duplicate_count"]) for e in events if e["ord"] not in gone}


@pytest.mark.parametrize("seed", [1, 2])
def test_days_are_taken_in_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    heads = ["Oerol", "Oerol festival", "Oerol Midsland", "Veemarkt", "Veemarkten Hoorn", "Zomerfeest"]
    rows = []
    for i in range(45):
        day = DAY + dt.timedelta(rng.randrange(12))
        rows.append(activity(i, rng.choice(heads), f"https://a.nl/{i}", date=day, end_date=day + dt.timedelta(rng.randint(1, 6)) if rng.random() < 0.4 else None, village=rng.choice([None, None, "Midsland", "Hoorn"]), start=rng.choice([None, 600])))
    got = {r["ord"]: (r["village"] if r["village"] != "Onbekend" else None, r["start"], r["duplicate_count"]) for r in resolve.absorb(table(spark, rows)).collect()}
    assert got == _absorbed(rows)


def test_selectors():
    root = markup.tree('<div id="top" class="lijst groot"><ul><li class="Rij" data-dag="ma-1"><b>x</b></li><li lang="nl-be" data-dag="di"></li></ul><p title="a, b">y</p></div>')
    found = lambda s: [x.tag for x in root.below() if selectors.matches(x, s)]
    assert found("li") == ["li", "li"] and found(".Rij") == ["li"] and found(".rij") == [] and found("[class='rij' i]") == ["li"]
    assert found("#top li[data-dag^=ma] > b") == ["b"] and found("#top > li") == [] and found("ul > li, p") == ["li", "li", "p"]
    assert found("div.groot.lijst [data-dag$='i']") == ["li"] and found("[lang|=nl]") == ["li"] and found("[title='a, b']") == ["p"] and found("[data-dag*='-']") == ["li"] and found("[class~=groot]") == ["div"]
    assert found("*") == ["div", "ul", "li", "b", "li", "p"]
    assert [found(s) for s in ("li:first-child", "", ">", "li >", "[", "li[data", "..x", "a + b")] == [[]] * 8
    assert text.slug_text("Één’s") == "een s"


def test_names_of_large_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """A block of more than FEW names is judged many pairs at a time: tiles, other letters than Latin, long names and empty ones."""
    monkeypatch.setattr(alike, "FEW", 20)
    monkeypatch.setattr(alike, "WIDE_TILE", 64)
    rng = random.Random(12)
    slugs = {"".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(150)} | {"", "я", "яа", "東京都", "東京", "a" * 31, "a" * 33}
    for n in (30, 40, 60, 64, 66, 90):
        long = rng.choices("abcdefgh", k=n)
        slugs |= {"".join(long), "".join(long[: n - 3]), "".join(long[2:]) + "xy", "".join(c if rng.random() < 0.75 else "q" for c in long)}
    slugs = sorted(slugs)
    rows = [("large", s, s) for s in slugs] + [("small", s, s) for s in slugs[:9]] + [("one", "zz", "zz")]
    least = 0.62
    got = [(r["a"], r["b"]) for r in alike._by_letters(spark.createDataFrame(rows, "block string, form string, slug string"), least).collect()]
    want = {(a, b) for i, a in enumerate(slugs) for b in slugs[i + 1 :] if a and 1 - lev(a, b) / max(len(a), len(b)) >= least - 1e-12}
    assert len(got) == len(set(got)) and set(got) == want
    assert 40 < len(want) < len(slugs) ** 2 / 4
    short = [s for s in slugs if len(s) <= alike.BITS]
    large = spark.createDataFrame([("large", s, s, len(slugs)) for s in slugs], "block string, form string, slug string, n long")
    many = {(min(r), max(r)) for r in alike._many_at_once(large, least).collect()}
    assert many == {p for p in want if p[0] in short or p[1] in short}


def test_links_grow_fewer_with_each_round(spark, monkeypatch):
    """Rows that rounds write follow the links and not the links times the rounds."""
    written = []

    def counted(df):
        out = settle(df)
        written.append(out.count())
        return out

    settle = components.settle
    monkeypatch.setattr(components, "settle", counted)
    links = [(f"{c:03d}-{i:02d}", f"{c:03d}-{i + 1:02d}") for c in range(60) for i in range(24)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: f"{n[:3]}-00" for pair in links for n in pair}
    assert sum(written) < 10 * len(links)
