"""Rounds over few rows on a session of many shuffle partitions."""

import os

from quernstone.llm import components, pii
from quernstone.llm.common import shared_folder


def _parts(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return sum(f.startswith("part-") and not f.endswith(".crc") for _, _, names in os.walk(folder) for f in names)


def test_rounds_over_few_rows_write_few_files(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = _parts(spark)
        links = spark.range(300).selectExpr("id as a", "id + 1 as b").where("a % 10 <> 9")
        found = {r["node"]: r["component"] for r in components.components(links).collect()}
        assert found == {i: i // 10 * 10 for i in range(300)}
        between = _parts(spark)
        assert between - before < 3 * 61  # the links, which aren't counted yet, and small tables
        edges = spark.range(400).selectExpr("id % 20 as pattern", "id as value", "cast(if(id % 4 = 0, 1, null) as int) as seed")
        pii._scores(edges).collect()
        assert _parts(spark) - between < 3 * 61
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
