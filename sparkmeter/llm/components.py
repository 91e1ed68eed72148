"""Connected components of a table of links, as joins that keep every link distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmeter.session import Scratch

ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node that can be reached.

    Alternates the large-star and small-star steps: each node's larger neighbours, then its smaller
    ones, are linked to the least node of its neighbourhood. The number of rounds grows with the
    logarithm of the longest path. Each round is written, so that no lineage builds up; a hub is
    one sum and a join that adaptive execution may split.
    """
    held = Scratch(links.sparkSession)
    edges = _settled(held, links.filter("a <> b").select("a", "b"))
    for _ in range(ROUNDS):
        large = _star(edges, large=True)
        small = _settled(held, _star(large, large=False))
        same = small.exceptAll(edges).isEmpty() if _size(small) == _size(edges) else False
        edges = small
        held.drop(kept=1)
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _settled(held: Scratch, edges: DataFrame) -> DataFrame:
    """Links from the larger to the smaller node, each once."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return held.settle(ordered.filter("a <> b").distinct(), "links")


def _size(edges: DataFrame) -> int:
    return edges.count()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.filter("b > a" if large else "b < a")
    moved = near.join(least, "a").select(F.col("b").alias("x"), F.col("a").alias("own"), "m")
    linked = moved.select(F.col("x").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionAll(moved.select(F.col("own").alias("a"), F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()
