"""Rows of few sources are dealt to all tasks."""

from quernstone.plans import activities


def test_rows_of_few_sources_go_to_all_tasks(spark):
    """Rows were shuffled by their source, so the heavy work on each of them ran in as many tasks as there are sources, or fewer."""
    rows = activities.activities(spark)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
