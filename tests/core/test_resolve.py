"""Entity resolution against the plain sequential procedure, on small tables."""

import datetime as dt
import random
import re

from quernstone.functions import text
from quernstone.operators import resolve

SCHEMA = (
    "ord long, date date, end_date date, start int, `end` int, name string, primary_url string, completeness int, description string, village string, location_name string, address string, "
    "organizer string, contact_person string, phone string, email string, website string, price string, ticket_url string, price_kind string, reservation string, categories array<string>, "
    "duplicate_count long, sources array<struct<source_id: string, source_name: string, tier: int, url: string>>"
)
DAY = dt.date(2026, 6, 12)


def activity(ord_, name, url="https://a.nl/een-pagina", tier=3, **more):
    row = dict.fromkeys(c.strip().split(" ")[0].strip("`") for c in SCHEMA.split("sources array")[0].strip(", ").split(","))
    row |= {"ord": ord_, "date": DAY, "name": name, "primary_url": url, "completeness": 3, "price_kind": "Onbekend", "reservation": "Onbekend", "categories": ["Overig"], "duplicate_count": 1}
    row |= {"sources": [(f"s{url}", "bron", tier, url)]} | more
    return row


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def near(a, b):
    return a == b or (min(len(a), len(b)) >= 5 and (a in b or b in a or 1 - lev(a, b) / max(len(a), len(b)) >= 0.80))


def paired(a, b):
    left, n = list(b), 0
    for word in a:
        at = next((k for k, other in enumerate(left) if near(word, other)), None)
        if at is not None:
            del left[at]
            n += 1
    return n


def words(name):
    return text.slug_text(re.sub(r"\b(19|20)\d{2}\b", " ", name)).split()


def alike(a, b):
    x, y = text.slug_text(a), text.slug_text(b)
    if not x or not y:
        return float(x == y)
    letters = 1 - lev(x, y) / max(len(x), len(y))
    p, q = words(a), words(b)
    m = paired(p, q)
    few, many = sorted((p, q), key=len)
    whole = 0.75 if few and sum(map(len, few)) >= 8 and paired(few, many) == len(few) else 0
    return max(letters, len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())), m / (len(p) + len(q) - m) if p and q else 0, whole)


def bare(e):
    name = e["name"].replace(e["village"], " ") if e["village"] else e["name"]
    name = " ".join(name.split()).strip(" -–,:|")
    return name if len(text.slug_text(name)) >= 4 else e["name"]


def same(a, b):
    like = max(alike(a["name"], b["name"]), alike(bare(a), bare(b)))
    if a["date"] != b["date"] or like < 0.62:
        return False
    if a["primary_url"] == b["primary_url"]:
        return True
    if a["start"] is not None and b["start"] is not None and abs(a["start"] - b["start"]) > 45:
        return False
    if a["village"] and b["village"] and a["village"] != b["village"]:
        return False
    return like >= 0.88 or (a["start"] is not None and a["start"] == b["start"]) or bool(a["village"] and a["village"] == b["village"])


def sequential(rows):
    out = {}
    for day in {r["date"] for r in rows}:
        found = []
        for e in sorted((r for r in rows if r["date"] == day), key=lambda r: (min(s[2] for s in r["sources"]), -r["completeness"], r["ord"])):
            at = next((b for b in found if any(same(x, e) for x in b)), None)
            if at is None:
                found.append(at := [])
            at.append(e)
            out[e["ord"]] = at[0]["ord"]
    return out


def test_buckets_follow_the_order_of_arrival(spark):
    rng = random.Random(4)
    heads, tails = ["Veemarkt", "Zomermarkt", "Concert koor", "Concert koren", "Wandeltocht"], ["", " Midsland", " Hoorn", " bij kerk", " 2026", " grote zaal"]
    rows = [
        activity(i, rng.choice(heads) + rng.choice(tails), f"https://{rng.choice('abc')}.nl/pagina{rng.randrange(12)}", rng.randint(1, 3), completeness=rng.randint(1, 3),
                 date=DAY + dt.timedelta(rng.randrange(2)), start=rng.choice([None, 600, 630, 645, 680, 700, 720]), village=rng.choice([None, "Midsland", "Hoorn"]))
        for i in range(90)
    ]
    rows += [dict(rows[k], ord=100 + n) for n, k in enumerate([0, 0, 0, 5, 5, 7])]
    want = sequential(rows)
    got = {r["ord"]: r["bucket"] for r in resolve.buckets(table(spark, rows)).select("ord", "bucket").collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_no_dates_and_empty_tables(spark):
    assert resolve.resolve(table(spark, [activity(1, "Markt", date=None)])).count() == 0


def test_fields_come_from_the_most_trusted_and_contradictions_are_told(spark):
    rows = [
        activity(1, "Concert in de kerk", "https://a.nl/concert", 2, start=1200, location_name="Kerk", description="kort", price="€ 5", price_kind="Betaald", categories=["Muziek"]),
        activity(2, "Concert in de kerk", "https://b.nl/concert", 4, start=1215, location_name="Dorpshuis", description="een langer verhaal", organizer="Koor", categories=["Overig"]),
        activity(3, "Concert in de kerk", "https://www.a.nl/nl/concert", 2, start=1200, location_name="Theater", completeness=2, phone="0562 123456"),
    ]
    out = resolve.fuse(resolve.buckets(table(spark, rows))).collect()
    assert len(out) == 1
    e = out[0]
    assert (e["location_name"], e["organizer"], e["phone"], e["start"], e["price_kind"], e["duplicate_count"]) == ("Kerk", "Koor", "0562 123456", 1200, "Betaald", 3)
    assert e["categories"] == ["Muziek"] and [s["url"] for s in e["sources"]] == ["https://a.nl/concert", "https://www.a.nl/nl/concert", "https://b.nl/concert"]
    told = {c["field"]: (c["chosen"], c["rejected"], c["resolved"], c["affects"]) for c in e["conflicts"]}
    assert told["Locatie"] == ("Kerk", ["Dorpshuis"], True, True)  # the other page of the same website doesn't contradict
    assert told["Starttijd"][1:] == (["1215"], True, True) and told["Beschrijving"][3] is False


def test_days_go_into_the_longer_activity(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [
        activity(1, "Oerol festival", "https://a.nl/oerol-heel", end_date=day(3)),
        activity(2, "Oerol festival", "https://b.nl/oerol-dag1", date=day(1), village="Hoorn", start=600),
        activity(3, "Oerol festival", "https://c.nl/oerol-dag2", date=day(2), village="Midsland"),
        activity(4, "Oerol festival", "https://d.nl/oerol-later", date=day(5)),
        activity(5, "Oerol festival", "https://e.nl/oerol-kort", date=day(1), end_date=day(2), village="Hoorn"),
        activity(6, "Veemarkt", "https://a.nl/veemarkt", date=day(1)),
    ]
    rows[4]["date"], rows[4]["start"], rows[1]["start"] = day(1), 900, 600
    got = {r["ord"]: (r["village"], r["start"], r["duplicate_count"]) for r in resolve.resolve(table(spark, rows)).collect()}
    assert got[1] == ("Hoorn", 600, 3) and set(got) == {1, 3, 4, 6}


def test_pairs_of_days_come_out_of_the_join_once_each(spark):
    """Pairs were made once for each of their alike names and shuffled to be told apart, so the disk grew with the square of the input."""
    import datetime as dt

    day = dt.date(2026, 6, 1)
    rows = [(i, day + dt.timedelta(i % 7), day + dt.timedelta(i % 7 + 3) if i % 3 == 0 else None, "Concert in Midsland", [None, "Midsland", "Hoorn"][i % 4 % 3]) for i in range(60)]
    found = resolve.containing(spark.createDataFrame(rows, "ord long, date date, end_date date, name string, village string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    got = sorted((r["host"], r["part"]) for r in found.collect())
    want = sorted((h[0], p[0]) for h in rows for p in rows if h[2] and h[0] != p[0] and h[1] <= p[1] <= h[2] and (p[2] or p[1]) <= h[2])
    assert got == want
