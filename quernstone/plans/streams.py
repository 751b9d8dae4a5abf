"""Registered queries on streams: the events of the driver as a stream that is replayed to its end, with SQL over the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.registry import query_of, table
from quernstone.plans.steps import settle
from quernstone.streaming import requests


def _replayed(spark, sf_dir, shape) -> DataFrame:
    """What a stream over the events gives until they are all read: shape(stream) written to the shared folder and read from there."""
    settle(spark.range(1))  # names the shared folder if the session hasn't
    out = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    run = shape(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out)


def _requests(events: DataFrame) -> DataFrame:
    """Events as requests of engines, seven seconds apart; every third gives nothing."""
    i = F.col("event_id")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + i * 7)
    return events.select(F.col("event_type").alias("engine"), i.alias("id"), at.alias("at"), (i % 3).alias("hits"), (F.col("user_id") % 7).alias("run"), F.concat(F.when(i % 2 == 0, "https://A.nl/").otherwise("https://a.nl/"), (F.col("user_id") % 40).cast("string")).alias("url"), i.cast("string").alias("body"))


@query_of("""WITH RECURSIVE e AS (SELECT event_type AS engine, event_id AS id, event_id * 7 AS s, event_id % 3 AS hits, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
    f AS (SELECT engine, id, hits, n, true AS made, CASE WHEN hits = 0 THEN s + 40 ELSE 0 END AS until FROM e WHERE n = 1 UNION ALL
    SELECT e.engine, e.id, e.hits, e.n, e.s >= f.until, CASE WHEN e.s >= f.until AND e.hits = 0 THEN e.s + 40 ELSE f.until END FROM f JOIN e ON e.engine = f.engine AND e.n = f.n + 1)
    SELECT engine, id, hits FROM f WHERE made""")
def q_engine_rest(spark, sf_dir):
    """The requests that are made when an engine rests after an empty answer."""
    return _replayed(spark, sf_dir, lambda s: requests.made_requests(_requests(s))).select("engine", "id", "hits")


@query_of("""SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id % 7, user_id % 40)::VARCHAR AS body FROM events""")
def q_url_cache(spark, sf_dir):
    """Each request of a run is served with what the first one of its address got."""
    firsts = _replayed(spark, sf_dir, lambda s: requests.first_requests(_requests(s)).select("run", "key", "body"))
    return requests.served(_requests(table(spark, sf_dir, "events")).drop("body"), firsts).select("id", "body")
