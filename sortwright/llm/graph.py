"""Connected components over an edge table, by alternating star contraction.

Each round hangs the larger neighbours of every node on its smallest neighbour
(large star), then the smaller ones (small star), until nothing changes. The
number of rounds grows with the logarithm of the longest path. Edges stay
distributed; each round is a staged table, so a lost executor repeats at most
one round; its table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, stage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
    ).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Components of an undirected edge table of two long columns.

    Returns (node, component): every node that has an edge to another node, with
    the smallest node it can reach. Loops, repeated edges and edges with a null
    end are ignored; an empty edge table gives an empty result.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        a.isNotNull() & b.isNotNull() & (a != b)
    )
    now = stage(now.distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(lowest, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(root, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b")))
            .distinct()
        )
        last, now = now, stage(small, "edges")
        discard(last)
        before, state = state, _state(now)
        if before == state:
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)
