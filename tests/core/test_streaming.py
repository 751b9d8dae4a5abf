from pyspark.sql import functions as F

from quernstone.plans import streams
from quernstone.streaming import requests
from quernstone.streaming.health import follow_health


def test_failures_in_a_row_by_host(spark, tmp_path):
    batches = [
        [("a", "2024-01-01 00:00:00", True), ("b", "2024-01-01 00:00:00", True), ("a", "2024-01-01 00:01:00", True)],
        [("a", "2024-01-01 00:02:00", False), ("b", "2024-01-01 00:03:00", True), ("a", "2024-01-01 00:04:00", True)],
        [("c", "2024-01-01 08:00:00", True)],
    ]
    schema = "host string, at string, failed boolean"
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = follow_health(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        keep = lambda df, _: seen.append(sorted((r["host"], r["failures"], r["unwell"]) for r in df.collect()))
        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
    seen = [rows for rows in seen if rows]
    # after eight hours a and b have rested and may be tried again
    assert seen[:3] == [[("a", 2, True), ("b", 1, False)], [("a", 1, False), ("b", 2, True)], [("c", 1, False)]]
    assert [r for rows in seen[3:] for r in rows] == [("a", 1, False), ("b", 2, False)]


def _given(spark, path, order):
    """Requests of three engines and 28 addresses, in some order, as the table events of a folder of several files."""
    rows = spark.range(3000).select(F.col("id").alias("event_id"), (F.col("id") * 37 % 280).alias("user_id"), F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("event_type"))
    rows.repartition(7).sortWithinPartitions(order).write.parquet(f"{path}/events.parquet")
    return rows


def test_the_first_request_is_the_earliest_whatever_the_order_of_rows(spark, tmp_path):
    rows = _given(spark, tmp_path, F.desc("event_id"))
    least = {}
    for r in rows.orderBy("event_id").collect():
        least.setdefault((r["user_id"] % 7, r["user_id"] % 40), str(r["event_id"]))
    found = {r["id"]: r["body"] for r in streams.q_url_cache(spark, str(tmp_path)).collect()}
    assert found == {r["event_id"]: least[r["user_id"] % 7, r["user_id"] % 40] for r in rows.collect()}


def test_engines_rest_across_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(requests, "PIECE", 10)
    rows = _given(spark, tmp_path, F.desc("event_id")).orderBy("event_id").collect()
    until, made = {}, []
    for r in rows:
        at = r["event_id"] * 7
        if at >= until.get(r["event_type"], 0):
            made.append(r["event_id"])
            if r["event_id"] % 3 == 0:
                until[r["event_type"]] = at + 40
    assert sorted(r["id"] for r in streams.q_engine_rest(spark, str(tmp_path)).collect()) == made
