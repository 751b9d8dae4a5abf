"""Mixing sources to target weights by hash-random keys, prefix sums and a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import attach, cut, fresh, quoted

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hex digits of the key that name its range bucket: 4096 buckets a source, so one that holds 10 billion rows has buckets of some millions, which a task sorts.
BUCKET_DIGITS = 3
_WORD = r"[^\x20\x09-\x0D]+"


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank 0, 1, ... in the given order: sorted in ranges, with the counts of the ranges before added."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # one row for each of n partitions
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(0)
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("rank", (row - 1 + offset).cast("long")).drop("_part")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source_size, weight, ...) with target: share of all sizes split by weight, at most `most` times a source's size.

    What a full source can't take is shared among the others by weight, round by round, until no source is above its limit.
    A round is one aggregate; the limits reached only grow, so it ends.
    """
    limit = F.col("source_size") * F.lit(most)
    row = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    want, full, taken, weight = share * (row["s"] or 0), 0, 0.0, row["w"] or 0
    while weight:
        above = F.col("weight") * F.lit(want - taken) / F.lit(weight) > limit
        now = sources.agg(F.sum(F.when(above, limit)).alias("c"), F.count_if(above).alias("n"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if now["n"] == full:
            break
        full, taken, weight = now["n"], now["c"], now["w"] or 0
    if not weight:
        return sources.withColumn("target", limit)
    return sources.withColumn("target", F.when(above, limit).otherwise(F.col("weight") * F.lit(want - taken) / F.lit(weight)))


def _parts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What places a row in the mix: whether its source is null, the source, its size, its key, and a mark of its text that tells rows of one id apart."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return {"none": F.col(source_col).isNull(), "source": F.coalesce(F.col(source_col), F.lit("")), "size": size, "key": key, "mark": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, size, key, mark, src, source_size, target, passes, part) and sources (none, source, n, rank, ...)."""
    rows = cut(docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in _parts(docs, id_col, text_col, source_col).items()]))
    sources = rows.groupBy("none", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = _ranked(sources, [F.col("none"), F.col("source")])
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    sources = targets(cut(sources.withColumn("weight", weight)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = cut(sources.withColumn("passes", passes))

    placed = attach(rows, sources, ["none", "source"], "n", rows.count())
    placed = cut(placed.select("id", "size", "key", "mark", F.col("rank").alias("src"), "source_size", "target", "passes", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")))
    sums = placed.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target") - F.col("passes") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("at")))
    return placed.join(before, ["src", "bucket"]).withColumn("at", at).withColumn("part", part), sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words, repeats counted) and epochs (passes that take any of it).

    Sizes are words between ASCII white space; null text has size 0. The documents of a source come in the order of
    a hash of their ids; whole passes are taken while they fit, then a pass up to the source's budget, in which the
    document at the cut is taken in part. So each source's taken words are its target rounded down. A null source is a source,
    the last one. Rows of one id are told apart by size and text; repeated rows are each a row. An empty table gives an empty result. Further columns are ignored.
    """
    rows, _ = _plan(docs, id_col, text_col, source_col, weights)
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        (F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int").alias("epochs"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs as the mix takes them: whole, once for each pass that takes them; all columns stay, whatever their names.

    The last pass of a source stops after the row that brings its words nearest to the target, so a source misses it by at most half a document. A row's place
    in that pass goes by its own id hash, id, size and text, so each row is decided alone and texts aren't shuffled: only where each source stops
    is joined to them. Null texts and texts without words go with the rows around them; repeated rows come and go together. An empty table gives an empty result.
    """
    rows, sources = _plan(docs, id_col, text_col, source_col, weights)
    place = F.struct("key", "id", "size", "mark")
    stops = rows.where((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))).groupBy(F.col("src").alias("rank")).agg(F.max(place).alias("stop"))
    ends = cut(sources.join(stops, "rank", "left").select("none", "source", "n", "passes", "stop"))
    none, source, size, key, mark, count, passes, stop, one = fresh(docs, "none", "source", "size", "key", "mark", "n", "passes", "stop", "pass")
    ends = ends.withColumnsRenamed({"none": none, "source": source, "n": count, "passes": passes, "stop": stop})
    keyed = docs.withColumns(dict(zip((none, source, size, key, mark), _parts(docs, id_col, text_col, source_col).values(), strict=True)))
    total = ends.agg(F.sum(count)).first()[0] or 0
    found = attach(keyed, ends, [none, source], count, total)
    mine = F.struct(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(size).alias("size"), F.col(mark).alias("mark"))
    times = (F.col(passes) + F.when(mine <= F.col(stop), 1).otherwise(0)).cast("int")
    return found.where(times > 0).withColumn(one, F.explode(F.sequence(F.lit(1), times))).select(*quoted(docs))
