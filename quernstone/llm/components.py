"""Connected components of a link table by repeated contraction, with skew-safe relabelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import ROWS_A_PART, attach, cut, packed


def _relabel(rows: DataFrame, to: DataFrame, column: str, total: int) -> DataFrame:
    """rows with `column` replaced by what `to` (node, root, n) maps it to."""
    named = to.select(F.col("node").alias(column), F.col("root").alias("_root"), F.col("n"))
    return attach(rows, named, [column], "n", total).withColumn(column, F.coalesce("_root", F.col(column))).drop("_root", "n")


def _last_rounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, root of the few links that are left: the same rounds within one task."""
    links = pd.concat(list(frames) or [pd.DataFrame({"a": [], "b": []}, dtype=np.int64)])
    nodes, ends = np.unique(links[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    with np.errstate(over="ignore"):
        mixed = nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # one to one, so no two are equal
    order = np.argsort(mixed ^ (mixed >> np.uint64(32)))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    root = np.arange(len(nodes))
    while len(a):
        least = rank.copy()
        np.minimum.at(least, a, rank[b])
        np.minimum.at(least, b, rank[a])
        to = order[least]
        root, a, b = to[root], to[a], to[b]
        a, b = a[a != b], b[a != b]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a, b: long); component is the smallest node that can be reached.

    In each round every node moves to the neighbour (or itself) of least hashed id; links are renamed and repeated
    ones dropped. The hash makes the number of rounds logarithmic whatever the ids; each round is
    checkpointed. Nodes with many links are renamed through a broadcast whose size is bounded. When no more links are left than one
    task can well hold, the rounds over them are one job, which spares the driver a dozen plans.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while (total := edges.count()) > 0:
        edges = packed(edges, total)
        if total <= ROWS_A_PART:
            steps.append(cut(edges.coalesce(1).mapInPandas(_last_rounds, "node long, root long")))
            break
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count("*").alias("n"))
        to = cut(packed(least.select(F.col("a").alias("node"), F.least("m", rank("a"))["id"].alias("root"), "n"), 2 * total))
        steps.append(to.select("node", "root"))
        moved = _relabel(_relabel(edges, to, "a", 2 * total), to, "b", 2 * total)
        edges = cut(packed(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), total))
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    ends = steps[-1]
    for to in reversed(steps[:-1]):  # where a node of an earlier round ends up
        n = to.count()
        held = to.groupBy("root").agg(F.count("*").alias("n"))
        target = held.join(ends.select(F.col("node").alias("root"), F.col("root").alias("_end")), "root", "left")
        target = cut(packed(target.select("root", F.coalesce("_end", F.col("root")).alias("_end"), "n"), n))
        ends = cut(packed(attach(to, target, ["root"], "n", n).select("node", F.col("_end").alias("root")), n))
    n = ends.count()
    least = cut(packed(ends.groupBy("root").agg(F.min("node").alias("_m"), F.count("*").alias("n")), n))
    found = attach(ends, least, ["root"], "n", n)
    return found.select("node", F.least("_m", "root").alias("component"))
