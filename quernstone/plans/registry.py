"""Where queries are registered, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries over small fixtures, and SQL that gives the rows they should; the tests run them.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def query_of(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def case_of(sql: str):
    def add(f):
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table dealt to as many tasks as a shuffle has, for heavy work on each row: a small file with many rows is one task otherwise. Only the columns that are asked for are dealt."""
    return table(spark, sf_dir, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def fixture(spark: SparkSession, rows: list[str]) -> DataFrame:
    """Rows of id and text."""
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def golden(columns: str, rows: list[str]) -> str:
    """SQL that gives known rows."""
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"
