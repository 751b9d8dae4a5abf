import pytest
from compare import differences

from types import SimpleNamespace

from quernstone.plans import catalog, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    more, less = differences(spark, name, catalog, SF)
    assert not more and not less, (list(more)[:3], list(less)[:3])


@pytest.mark.parametrize("name", sorted(registry.CASES))
def test_known_rows(spark, name):
    """Small fixtures whose rows are known."""
    more, less = differences(spark, name, SimpleNamespace(QUERIES=registry.CASES, SQL=registry.CASE_SQL), SF)
    assert not more and not less, (list(more)[:3], list(less)[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_sorted_queries_are_in_order(spark):
    rows = catalog.QUERIES["q_sort_default"](spark, SF).collect()
    keys = [(r["day"], r["start"] is None, r["start"] or 0, r["o_orderpriority"].lower(), r["o_orderkey"], r["place"]) for r in rows]
    assert sorted(keys) == sorted(keys, key=lambda k: k[-1]) and [k[-1] for k in sorted(keys)] == list(range(1, len(keys) + 1))
