"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")
    ).first()
    return tuple(row)


def _linked(pairs: DataFrame) -> DataFrame:
    """Each neighbour of ``u`` except the centre, tied to the smallest of them.

    ``u`` itself belongs to its neighbourhood. The minimum is an aggregate that
    combines before the shuffle, and the join back may be split by AQE: a hub is
    never gathered in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (long columns a, b).

    The component is the smallest node reachable. Self loops, repeated and
    reversed edges and null ends do not matter; without edges there are no rows.
    Every round is written to the shared folder; rounds grow with the logarithm
    of a component's size.
    """
    pairs = edges.where((F.col("a") != F.col("b")) & F.col("a").isNotNull() & F.col("b").isNotNull())
    now = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _linked(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        # Every edge points downwards here (a > b), so u's neighbours are its smaller ones.
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        tied = _linked(down)
        small = (
            tied.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(tied.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        now = stored(small, "small")
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
