"""Steps of iterative plans."""

from pyspark.sql import functions as F

from quernstone.plans.steps import MOST_BROADCAST, by_measure, settle

THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grew_since_its_files_is_not_broadcast(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    large = settle(few.select(F.explode(F.sequence(F.lit(1), F.lit(200))).alias("i"), (F.col("id") * 200).alias("j")).select((F.col("i") + F.col("j")).alias("k"), F.sha2(F.concat_ws("-", "i", "j"), 256).alias("text")))
    before = [spark.conf.get(key, None) for key in THRESHOLDS]
    seen = []

    class Watched(type(large)):
        def checkpoint(self, eager=True):
            seen.append([spark.conf.get(key, None) for key in THRESHOLDS])
            return super().checkpoint(eager)

    joined = large.join(large.withColumnRenamed("text", "other"), "k")
    out = settle(Watched(joined._jdf, spark))
    assert out.count() == 200_000
    assert seen == [["-1", str(MOST_BROADCAST)]]
    assert [spark.conf.get(key, None) for key in THRESHOLDS] == before
    with by_measure(spark):
        assert "BroadcastHashJoin" not in _plan(large.join(large.withColumnRenamed("text", "other"), "k")).split("Initial Plan")[0]
    assert [spark.conf.get(key, None) for key in THRESHOLDS] == before


def test_settings_come_back_after_an_error(spark):
    before = [spark.conf.get(key, None) for key in THRESHOLDS]
    try:
        settle(spark.range(3).select(F.raise_error(F.lit("no"))))
    except Exception:
        pass
    assert [spark.conf.get(key, None) for key in THRESHOLDS] == before
