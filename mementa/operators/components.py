"""Connected components by alternating large-star and small-star (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mementa.operators.common import HEAVY_KEY_ROWS, lookup_join
from mementa.session import reliable_checkpoint


def _large_star(edges: DataFrame, heavy_rows: int, total: int) -> DataFrame:
    """Link every larger neighbour of a vertex to the least vertex around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    least = least.select("u", "n", F.least("u", "m").alias("root"))
    linked = lookup_join(both.filter("v > u"), least, "u", "n", heavy_rows, total)
    return linked.select(F.col("v").alias("hi"), F.col("root").alias("lo")).filter("hi <> lo").distinct()


def _small_star(edges: DataFrame, heavy_rows: int, total: int) -> DataFrame:
    """Link a vertex and its smaller neighbours to the least of them."""
    least = edges.groupBy("hi").agg(F.count("*").alias("n"), F.min("lo").alias("root"))
    linked = lookup_join(edges, least, "hi", "n", heavy_rows, total).select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
    return linked.filter("hi <> lo").unionByName(
        least.select("hi", F.col("root").alias("lo"))
    ).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, heavy_rows: int = HEAVY_KEY_ROWS) -> DataFrame:
    """(vertex, component) for every vertex of ``edges(a, b)``; the component is its least vertex.

    Each round is two aggregations with map-side combine.  Hubs go through the broadcast branch of
    ``lookup_join``.  Rounds grow with the logarithm of the component size, and each one ends in a
    reliable checkpoint, so a lost executor costs one round.
    """
    state = reliable_checkpoint(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    mark = _fingerprint(state)
    while mark[0] > 0:
        state = reliable_checkpoint(_small_star(_large_star(state, heavy_rows, 2 * mark[0]), heavy_rows, 2 * mark[0]))
        seen, mark = mark, _fingerprint(state)
        if seen == mark:
            break
    members = state.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
    roots = state.select(F.col("lo").alias("vertex"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)
