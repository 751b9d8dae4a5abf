"""The markets of q_buckets: every stage of resolution has something to do, and the rows are those of the sequential procedure."""

import datetime as dt
import functools

import test_resolve as plain
from quernstone.functions import text
from quernstone.operators import resolve
from quernstone.plans import activities

COLUMNS = ("ord", "date", "name", "primary_url", "completeness", "start", "village", "location_name", "address", "organizer", "sources")
FIRST = dt.date(1996, 1, 5)  # days since 1970 are a multiple of five, so this is a day of oddities


def tables(spark, folder):
    orders = [(i * 37, i % 60, ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED"][i % 3], dt.datetime.combine(FIRST + dt.timedelta(i % 10 // 9), dt.time())) for i in range(150)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    people = [(i, f"Customer#{i * 1237:09}", ["BUILDING", "MACHINERY"][i % 2], i % 5) for i in range(60)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def page(e):
    return e["primary_url"] and e["primary_url"].replace("/nl/", "/").replace("/en/", "/")


alike = functools.cache(plain.alike)


@functools.cache
def near_text(a, b, least):
    if a is None or b is None:
        return False
    a, b = text.slug_text(a), text.slug_text(b)
    words = set(a.split()) | set(b.split())
    return 1 - plain.lev(a, b) / max(len(a), len(b)) >= least or len(set(a.split()) & set(b.split())) / len(words) >= least or a in b or b in a


def same(a, b):
    """Whether the later b is the same as the earlier a."""
    if a["date"] != b["date"]:
        return False
    like = max(alike(a["name"], b["name"]), alike(plain.bare(a), plain.bare(b)))
    if like < resolve.ALIKE:
        return False
    if a["primary_url"] and page(a) == page(b):
        return True
    if a["start"] is not None and b["start"] is not None and abs(a["start"] - b["start"]) > resolve.MINUTES or a["village"] and b["village"] and a["village"] != b["village"]:
        return False
    backed = a["start"] is not None and a["start"] == b["start"] or a["village"] and a["village"] == b["village"]
    return bool(like >= resolve.SURE or backed or any(near_text(a[c], b[c], least) for c, least in resolve.SOFT.items()))


def sequential(rows, fits=same):
    out, found = {}, []
    for e in sorted(rows, key=lambda r: (r["sources"][0]["tier"], -r["completeness"], r["ord"])):
        at = next((b for b in found if any(fits(x, e) for x in b)), None)
        if at is None:
            found.append(at := [])
        at.append(e)
        out[e["ord"]] = at[0]["ord"]
    return out


def test_all_that_resolution_goes_by_has_an_effect_on_the_buckets(spark, tmp_path):
    """Names were the same for a segment and pages and places were null, so the stages that meet by alike names, pages and places had nothing to find."""
    folder = tables(spark, tmp_path)
    rows = [r.asDict() for r in activities._markets(spark, folder).select(*COLUMNS).collect()]
    want = sequential(rows)
    assert {r["ord"]: r["bucket"] for r in activities.q_buckets(spark, folder).collect()} == want
    blanks = [{"primary_url": None}, {"village": "Hoorn"}, {"start": 600}, {"completeness": 1}, {"location_name": None, "address": None, "organizer": None}]
    for blank in blanks:
        assert sequential([r | blank for r in rows]) != want, blank
    assert sequential(rows, lambda a, b: a["name"] == b["name"] and same(a, b)) != want
