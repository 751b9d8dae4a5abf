"""Runs a query and its SQL side by side."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def differences(spark, name, catalog, sf_dir):
    """Rows that only the query has, and rows that only the SQL has."""
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    expected = want.fetchall()
    got = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    found = Counter(tuple(_plain(v) for v in r) for r in got.select(*columns).collect())
    asked = Counter(tuple(_plain(v) for v in r) for r in expected)
    return found - asked, asked - found
