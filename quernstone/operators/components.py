"""Connected components by contraction, for links of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.steps import attach, settle


def _renamed(rows: DataFrame, to: DataFrame, column: str) -> DataFrame:
    """rows with the nodes of a column replaced by the roots that `to` (node, root, size) has for them; size counts the rows of a node in both columns together."""
    return attach(rows, to.select(F.col("node").alias(column), "root", "size"), [column], "size").withColumn(column, F.col("root")).drop("root", "size")


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached from each one. links has columns a and b; loops name nodes without links.

    In a round each node moves to the one of least hash among itself and those beside it, links are renamed, and those within one node or met already are dropped. Hashes make the
    rounds logarithmic in the nodes whatever their order, and fewer links are left each time, so all rounds together cost little more than the first. Nodes with very many links are
    renamed by broadcast.
    """
    given = settle(links.select("a", "b").where("a is not null and b is not null"))
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    pair = lambda rows: settle(rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rank = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))
    edges, rounds = pair(given), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("least"), F.count("*").alias("size"))
        to = settle(least.select(F.col("a").alias("node"), F.least("least", rank("a"))["node"].alias("root"), "size"))
        rounds.append(to.select("node", "root"))
        edges = pair(_renamed(_renamed(edges, to, "a"), to, "b"))
    if not rounds:
        return nodes.select("node", F.col("node").alias("component"))
    ends = rounds[-1]
    for to in reversed(rounds[:-1]):  # where a node of an earlier round ends up
        held = to.groupBy("root").agg(F.count("*").alias("size"))
        target = held.join(ends.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left")
        target = settle(target.select("root", F.coalesce("end", "root").alias("end"), "size"))
        ends = settle(attach(to, target, ["root"], "size").select("node", F.col("end").alias("root")))
    least = settle(ends.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size")))
    found = attach(ends, least, ["root"], "size").select(F.col("node").alias("found"), "component")
    return nodes.join(found, F.col("node") == F.col("found"), "left").select("node", F.coalesce("component", "node").alias("component"))


def websites_of(sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, site: which independent website each host and registry id of a group's sources belongs to.

    sources has the keys (never null), host and id; empty ones tell nothing. A host and an id that one source names are one website, whatever the number of sources.
    """
    token = lambda kind: F.when(F.col(kind) != "", F.concat(F.lit(f"{kind}:"), kind))
    named = sources.select(*keys, token("host").alias("x"), token("id").alias("y")).select(*keys, F.coalesce("x", "y").alias("x"), F.coalesce("y", "x").alias("y")).where("x is not null").distinct()
    node = lambda c: F.struct(*keys, F.col(c).alias("token"))
    found = components(named.select(node("x").alias("a"), node("y").alias("b")))
    return found.select("node.*", F.col("component.token").alias("site"))
