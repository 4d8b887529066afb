"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every vertex of the edges ``u, v`` (long): the least id that it reaches.

    Alternates large-star and small-star steps until the edges are stars around the least vertices, which
    takes a number of rounds that grows with the logarithm of the largest component. A vertex's least
    neighbour is an aggregate with partial results, written out and joined back: the join stands alone, so a vertex
    of very many edges can be split over tasks. No component is ever gathered in one place. Self loops, repeated
    edges and edges with a null end are ignored; a vertex without other edges gets no row, and no edges give no rows.
    The result is a written table.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        # Large-star: each vertex ties its larger neighbours to its least one.
        ways = _both_ways(edges)
        least = materialise(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        discard(least, edges)
        # Small-star: each vertex ties its smaller neighbours and itself to the least of them.
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(least, large)
        # The edges as a set: their number and two independent sums of hashes.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    inner = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = materialise(inner.unionByName(roots))
    discard(edges)
    return out
