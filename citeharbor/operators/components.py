"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``): root is the smallest
    node that can be reached. NULL ends and loops link nothing; repeated edges count once.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour; chains shorten by half, stars are final. Minima are combined before the shuffle,
    and the joins are plain equi-joins against one row per node, so a node with many neighbours
    can be split. Every round is cut by a checkpoint in the shared folder.
    """
    state = cut(_distinct(edges.select("a", "b").dropna()))
    before = _digest(state)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        grown = both.filter(F.col("b") > F.col("a")).join(smallest, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(_distinct(grown))
        lowest = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut(_distinct(small.unionByName(lowest.withColumnRenamed("m", "b"))))
        after = _digest(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
