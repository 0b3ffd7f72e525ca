"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.session import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours, beside each neighbour."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of the links (u, v).

    Nodes without links are not returned. Each round hangs a node's neighbours
    onto its least neighbour, first the larger ones and then the smaller, until
    all links point at the least node; rounds grow with the logarithm of the
    longest path. A node with many links is pre-aggregated to its minimum, and
    the joins may split it.
    """
    links = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.filter("u > v").distinct()
        small = _least(larger)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        links = materialize(small.filter("u > v").distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
