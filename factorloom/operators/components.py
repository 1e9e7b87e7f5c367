"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.session import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and its neighbours; aggregates on the map side, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges have u > v on entry and on exit."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (
        both.join(_least_neighbour(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )
    small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
    linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link in edges(u, v); component is the smallest node.

    Nulls and loops are ignored, repeated and reversed links count once, an empty table gives an
    empty result. Nodes and edges stay in Spark; each round is written to the shared folder. A hub's
    neighbours are never gathered: its minimum is a partial aggregate and its links are an equi-join,
    which adaptive execution splits.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        then = scratch.keep(_round(now))
        new = _mark(then)
        scratch.drop(now)
        now = then
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
