"""Questions, reports, stores and the following of links on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.operators import answer, query, search
from quernstone.plans import answers, derived
from quernstone.sources import health, intake, registry, store
from quernstone.sources import places as geo

DAY = dt.date(2026, 6, 12)


def test_ranges():
    assert query.parse_range(None, None, DAY) == (DAY, dt.date(2026, 6, 25))
    assert query.parse_range(dt.date(2026, 7, 1), dt.date(2026, 6, 1), DAY) == (dt.date(2026, 6, 1), dt.date(2026, 7, 1))
    with pytest.raises(ValueError):
        query.parse_range(DAY, dt.date(2027, 8, 1), DAY)


def test_filters(spark):
    rows = [("1", "Gratis", "Ja"), ("2", "Betaald", "Nee"), ("3", None, None)]
    given = spark.createDataFrame(rows, "id string, kind string, reservation string")
    kept = lambda c: sorted(r["id"] for r in given.where(c).collect())
    assert kept(answer.price_is(F.col("kind"), "GRATIS")) == ["1"]
    assert kept(answer.price_is(F.col("kind"), "duur")) == ["1", "2", "3"] == kept(answer.price_is(F.col("kind"), None))
    assert kept(answer.equals(F.col("reservation"), "nee")) == ["2"] and kept(answer.equals(F.col("reservation"), "*")) == ["1", "2", "3"]


def test_json_leaves_nulls_out(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, 2.5, None)], "run_id int, last_value double, name string")
    assert sorted(r["json"] for r in answer.as_json(rows).collect()) == ['{"runId":1,"name":"x"}', '{"runId":2,"lastValue":2.5}']


def test_reports_of_empty_tables(spark):
    nothing = answers._stored(spark, "/root/testdata/sf0.001").limit(0)
    assert answer.unverified(nothing).collect() == [] == answer.facets(nothing).collect()
    assert search.ask(nothing, answer.Question(), DAY).collect() == []
    assert query.ranked(nothing, [F.col("id")], "place").collect() == []


def test_stores(spark, tmp_path):
    assert store.read_or_empty(spark, f"{tmp_path}/none", "a int, b string").collect() == []
    store.save_results(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/events")
    assert [tuple(r) for r in store.read_last(spark, f"{tmp_path}/events", "a long, b string").collect()] == [(1, None)]
    store.save_json(spark.createDataFrame([(1, None), (2, "x")], "a int, some_text string"), f"{tmp_path}/json")
    assert sorted(tuple(r) for r in store.read_or_empty(spark, f"{tmp_path}/json", "a int, someText string", "json").collect()) == [(1, None), (2, "x")]
    for i in range(43):
        if i in (0, 1, 42):
            rows = [(f"r{j}", dt.datetime(2026, 1, 1) + dt.timedelta(days=j)) for j in ([i] if i < 2 else range(2, 43))]
            store.add_run(spark.createDataFrame(rows, "run_id string, searched_at timestamp"), f"{tmp_path}/runs")
    kept = [r["run_id"] for r in store.read_last(spark, f"{tmp_path}/runs", "run_id string, searched_at timestamp").collect()]
    assert sorted(kept) == sorted(f"r{j}" for j in range(3, 43))


def test_health_table(spark, tmp_path):
    now = dt.datetime(2026, 6, 12)
    old = dt.datetime(2026, 4, 1)
    of = lambda *rows: spark.createDataFrame(rows, store.HEALTH)
    store.save_health(of(("a", 1, now, None), ("b", 3, old, None), ("c", 2, now, None)), f"{tmp_path}/health", now)
    store.save_health(of(("a", 0, None, now), ("d", 1, now, None)), f"{tmp_path}/health", now)
    assert sorted((r["host"], r["failures"]) for r in store.read_last(spark, f"{tmp_path}/health", store.HEALTH).collect()) == [("a", 0), ("c", 2), ("d", 1)]
    urls = spark.createDataFrame([("https://a.nl/x",), ("https://B.nl:8080/y",), ("geen",)], "url string")
    left = health.reachable(urls, "url", spark.createDataFrame([("b.nl", True), ("a.nl", False)], "host string, skip boolean"))
    assert sorted(r["url"] for r in left.collect()) == ["geen", "https://a.nl/x"]


def test_links_that_are_followed(spark):
    body = '<a href="/agenda/een-tocht">Een lange tocht langs zee</a><a href="/agenda/twee-tochten">Nog een lange tocht langs zee</a>'
    pages = spark.createDataFrame([(1, "https://a.nl/agenda", body, 2), (2, "https://b.nl/agenda", body, 5)], "id long, url string, body string, most int")
    raws = [(1, 0, "https://a.nl/e/1"), (1, 1, "https://A.nl/agenda"), (1, 2, "https://a.nl/E/1")] + [(2, i, f"https://b.nl/e/{i}") for i in range(3)]
    links = intake.links_to_follow(pages, spark.createDataFrame(raws, "payload long, place long, detail_url string"), "most")
    found = sorted(tuple(r) for r in links.collect())
    assert found == [(1, 1, "https://a.nl/e/1"), (1, 2, "https://a.nl/agenda/een-tocht"), *[(2, i + 1, f"https://b.nl/e/{i}") for i in range(3)]]
    stored = spark.createDataFrame([(7, "https://b.nl/e/1"), (8, "https://b.nl/ander"), (1, "https://a.nl/e/1")], "id long, url string")
    assert [r["id"] for r in intake.with_details(pages, links, stored).collect()] == [7]


def test_formats(spark):
    rows = [("text/calendar", "", None, None, False, "ics"), (None, "BEGIN:vcalendar", None, None, False, "ics"), ("application/xml", "<rss", None, None, False, "rss"), ("application/xhtml+xml", "<p", None, None, False, "html"),
            ("application/json", "{}", None, None, False, "json"), ("text/html", " [1]", "AlternatePath", None, False, "json"), ("text/html", " [1]", "Direct", None, False, "html"), (None, "x", None, "ICS", True, "ics"),
            (None, "BEGIN:VCALENDAR", None, "atom", True, "rss"), (None, "x BEGIN:VCALENDAR", None, None, True, "ics"), (None, None, None, None, True, "rss"), (None, None, None, None, None, "html")]
    given = spark.createDataFrame(rows, "kind string, body string, way string, feed string, is_feed boolean, want string")
    found = given.select("want", intake.format_of(F.col("kind"), F.col("body"), F.col("way"), F.col("feed"), F.col("is_feed")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in found), found


def test_places_and_questions_from_nothing(spark):
    raw = spark.createDataFrame([], "name string, type string, parent string, variants array<string>, source string, ambiguous boolean")
    assert geo.build_places(raw).collect() == []
    assert registry.month_names(dt.date(2026, 11, 1), dt.date(2027, 1, 1)) == ["november 2026", "december 2026", "januari 2027"]


def test_keys_that_look_like_postcodes_of_the_island(spark, tmp_path):
    rows = [(k, "MACHINERY", 1) for k in (8886, 8887, 8890, 8897, 8892, 17)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(r["ord"] for r in answers.q_normalise(spark, str(tmp_path)).collect()) == [8890, 8892]


def test_small_files_are_dealt_to_many_tasks(spark):
    """Heavy work on each row isn't one task because the file is small."""
    sf, tasks = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (derived._linked(spark, sf), derived._orders(spark, sf), answers._raws(spark, sf), answers._payloads(spark, sf)):
        assert rows.rdd.getNumPartitions() == tasks
