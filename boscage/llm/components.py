"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star rounds: each round is a map-side
combined minimum per node and a join, and is written to the shared folder, so
nothing about the graph is gathered anywhere and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round; edges (a, b) with a > b once each."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        joined = both.where(F.col("b") > F.col("a")).join(least, "a")
        pairs = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        joined = edges.join(least, "a")
        pairs = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return pairs.where(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, scratch: Scratch, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge; root is the least node reachable.

    edges: two long columns a, b; null ends, loops and repeats are ignored.
    """
    own = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(own, f"{tag}-0")
    before, name = _mark(now), f"{tag}-0"
    for k in range(1, rounds + 1):
        if not before[0]:
            break
        new = scratch.save(_star(_star(now, True), False), f"{tag}-{k}")
        after = _mark(new)
        scratch.drop(name)
        now, name = new, f"{tag}-{k}"
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
