"""Connected components of links between ids, by alternating star steps.

Each round hangs every neighbour of a node on the smallest node of its
neighbourhood, first the larger neighbours, then the smaller ones, until the
edges are stars around the smallest id of each component. Edges stay
distributed; a round is aggregates and equi-joins on node ids, so a node with
very many neighbours costs its joins, which adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_few


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over ``edges(u, v)`` with u > v."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> (node, component) for every node with a link to another."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    sign = None
    while True:
        edges = cut_few(star(star(edges, larger=True), larger=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
