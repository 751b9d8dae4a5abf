"""Tables that outlast a run: registries, results, reports, the history of runs and the health of hosts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from quernstone.operators.answer import as_json
from quernstone.sources.health import merged_health

# Fixed values. Runs that the history keeps.
KEPT_RUNS = 40
HEALTH = "host string, failures long, last_failure timestamp, last_success timestamp"
#: Versions of a table that are kept beside the last one, for readers that began before it.
KEPT_VERSIONS = 2
_COMMIT = "turn long, version string, batch long"


def _plain(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(""))


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """file and object (its text) of each JSON object in the files at a path: a file is one document, or has one on each line; arrays count for what is in them."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    listed = lambda c: F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    is_list = F.col("value").rlike(r"\A\s*\[")
    by_line = F.expr(r"try_parse_json(regexp_extract(value, r'\A\s*([^\r\n]*)', 1))").isNotNull()  # the first line is whole
    whole = files.withColumn("parts", F.when(by_line, F.split("value", r"\r?\n")).otherwise(F.array("value")))
    each = whole.select("file", F.explode("parts").alias("value")).where(F.trim("value") != "")
    return each.select("file", F.explode(F.when(is_list, F.coalesce(listed(F.col("value")), F.array("value"))).otherwise(F.array("value"))).alias("object"))


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows that JSON files hold, and file and object of what is no object.

    Files may be indented arrays of objects, single objects, or have an object or an array on each line. Names go by their letters: agenda_urls, agendaUrls and AgendaUrls are one. Values that don't
    fit their type and columns that are lacking are null, other columns are left out. A file is read by one task, as registries are small.
    """
    wanted = StructType.fromDDL(schema)
    read = _objects(spark, path).withColumn("of", F.from_json("object", "map<string,string>"))
    good = F.col("of").isNotNull() & F.col("object").rlike(r"\A\s*\{") & F.expr("try_parse_json(object)").isNotNull()

    def typed(kind: DataType, name: str) -> Column:
        named = F.transform_keys("of", lambda k, _: _plain(k))
        found = F.try_element_at(named, F.lit(name.lower().replace("_", "")))
        if isinstance(kind, ArrayType | StructType | MapType):
            return F.from_json(found, kind.simpleString())
        return found if isinstance(kind, StringType) else found.try_cast(kind)

    rows = read.where(good).select(*[typed(f.dataType, f.name).alias(f.name) for f in wanted])
    return rows, read.where(~F.coalesce(good, F.lit(False))).select("file", "object")


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one of the schema if there is none or its files are no such files; columns that it lacks are null, others are left out.

    JSON is read as read_json has it; what is broken in it is left out here, and told there.
    """
    wanted = StructType.fromDDL(schema)
    try:
        if form == "json":
            return read_json(spark, path, schema)[0]
        found = spark.read.format(form).load(path)
    except (AnalysisException, PySparkException, Py4JJavaError):  # no such table, or files whose footers can't be read
        return spark.createDataFrame([], wanted)
    have = set(found.columns)
    return found.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


# --- tables in versions


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/commits", _COMMIT)


def write_version(rows: DataFrame, path: str) -> str:
    """Writes rows beside the versions of a table; readers don't see them before they are committed."""
    version = uuid.uuid4().hex
    rows.write.parquet(f"{path}/versions/{version}")
    return version


def commit(spark: SparkSession, path: str, version: str, batch: int | None = None) -> None:
    """Makes a version the last one: a row more in a list that is only added to, in a file that appears whole. Older versions than KEPT_VERSIONS back are removed."""
    known = _commits(spark, path).orderBy(F.desc("turn")).limit(KEPT_VERSIONS + 2).collect()
    turn = max((r["turn"] for r in known), default=0) + 1
    spark.createDataFrame([(turn, version, batch)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    for r in known[KEPT_VERSIONS:]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{r['version']}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """rows in place of what the table held. A run that ends between the two steps leaves the table as it was."""
    commit(rows.sparkSession, path, write_version(rows, path), batch)


def read_last(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last version that was committed, or an empty table of the schema."""
    last = _commits(spark, path).orderBy(F.desc("turn")).first()
    return read_or_empty(spark, f"{path}/versions/{last['version']}", schema) if last else spark.createDataFrame([], StructType.fromDDL(schema))


def save_results(events: DataFrame, path: str) -> None:
    """The activities of the last run, in place of those of the run before."""
    save(events, path)


def save_json(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON without nulls, in place of what was there."""
    as_json(rows).withColumnRenamed("json", "value").write.mode("overwrite").text(path)


def newest(history: DataFrame, most: int = KEPT_RUNS) -> DataFrame:
    """The newest runs (run_id, searched_at, ...), as many as the history keeps."""
    return history.orderBy(F.desc("searched_at"), "run_id").limit(most)


def add_run(report: DataFrame, path: str) -> None:
    """The history with a run's report; runs beyond KEPT_RUNS fall out."""
    known = read_last(report.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema))
    save(newest(report.unionByName(known)), path)


def save_health(fresh: DataFrame, path: str, now: datetime, batch: int | None = None) -> None:
    """The health of hosts after a run, merged into what is known. fresh: HEALTH."""
    save(merged_health(read_last(fresh.sparkSession, path, HEALTH), fresh, now), path, batch)


def health_sink(path: str, clock: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """What a stream's foreachBatch calls to merge its batches (HEALTH) into the table at a path. A batch that comes again after a crash changes nothing."""

    def write(fresh: DataFrame, batch: int) -> None:
        if _commits(fresh.sparkSession, path).where(F.col("batch") >= batch).isEmpty():
            save_health(fresh, path, clock(), batch)

    return write
