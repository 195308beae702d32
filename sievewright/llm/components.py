"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import stage

MOST_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select("v", "m")
    return moved.union(least.select("u", "m")).toDF("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(F.shiftright(mark, 24))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node it is linked to.

    Loops (a = b) and edges with a NULL end are ignored; repeated edges count once; no edges give
    no rows. Every round writes its edges to the shared folder, so lineage stays short; the driver
    only sees counts. Minima are aggregated before the shuffle, hot nodes are joined, never
    collected.
    """
    edges = stage(edges.toDF("a", "b").filter("a <> b").distinct(), "edges")
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        edges = stage(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select("b").distinct()
    return edges.toDF("node", "component").union(roots.select("b", "b"))
