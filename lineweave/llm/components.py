"""Connected components of a distributed edge list, by alternating large and small stars.

Each round replaces edges so that nodes point at the least node they have heard of;
the number of rounds grows with the logarithm of a component's width.  Links stay
on the executors; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connect(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b), long ids.  Gives (node, root): each node of an edge and the least node of its component."""
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    star = scratch.write(star, "edges")
    seen = _state(star)
    for _ in range(rounds):
        if not seen[0]:
            break
        # Large star: the neighbours above a node point at the least of its neighbourhood.
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its neighbours below it point at the least of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges", instead_of=[star])
        now = _state(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = star.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
