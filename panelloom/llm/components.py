"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them. edges: u > v, distinct; they are deleted when the star is written.

    Large: the neighbours above a node move to the least of all its neighbours and itself; small: those below it, and
    the node itself, move to the least of them. A hub's neighbours are combined before the shuffle, and the join brings
    one row back to each, so Spark can split a hub's share.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = edges.join(least, "u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    star = materialize(out.filter("u != v").distinct(), "star")
    discard(edges, least)
    return star


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Each round is a table in the shared folder, which goes when the next is written; the rounds end when a large and a small
    star change nothing, after a number of rounds that grows with the logarithm of the longest path. Loops, repeated and
    reversed edges are allowed; edges with a null are dropped, and a node whose only edges are loops is left out.
    """
    ordered = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(ordered, "edges")
    state, before = _state(now), None
    while state != before:
        before = state
        now = _star(_star(now, large=True), large=False)
        state = _state(now)
    children = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
