"""Dates and times in odd texts."""

import datetime as dt

from pyspark.sql import functions as F

from quernstone.functions import dates


def test_what_has_no_match_is_not_worked_out(spark):
    """Without a match nothing is asked of the groups, so forms that a text doesn't have cost one scan each."""
    rows = spark.createDataFrame([("12 juni",), ("welkom",), ("",)], "t string")
    got = rows.select(dates._parts(F.col("t"), dates.TEXTUAL, 3, lambda d, m, y: F.concat_ws("|", d, m, F.btrim(y))).alias("x")).collect()
    assert [r["x"] for r in got] == ["12|juni|", None, None]


def test_dates_end_where_their_words_end(spark):
    day = lambda m, d, y=2026: dt.date(y, m, d)
    want = {
        "12 juni welkom": (day(6, 12), None), "12 jan. in de kerk": (day(1, 12), None), "12 jan.": (day(1, 12), None), "op 3 mei 2025, zaal 2": (day(5, 3, 2025), None), "31-02-2026": None, "29-02-24": (day(2, 29, 2024), None),
        "30 december t/m 2 januari in Hoorn": (day(12, 30, 2025), day(1, 2)), "12 - 15 juni : markt": (day(6, 12), day(6, 15)), "31 t/m 2 juni": (day(6, 2), None), "2026-13-01": None, "1850-01-01": None, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r["t"]: r["x"] for r in rows.select("t", dates.date_range(F.col("t"), F.lit(2026)).alias("x")).collect()}
    assert {t: x and tuple(x) for t, x in got.items()} == want
