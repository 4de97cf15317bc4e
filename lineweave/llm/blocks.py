"""From hash buckets to bounded comparison tasks.

Nodes that share a bucket must be compared.  A bucket may hold a third of all
nodes, so neither buckets nor pairs become rows: nodes get a home (the least node
they share a bucket with, one jump further), a home is cut into blocks of bounded
weight by the node's hash, and two blocks are compared, once, if any bucket holds
nodes of both.  A task is one pair of blocks; its size is bounded whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import scratch

#: Keys that the rows of one home are dealt to.
SALTS = 8


def comparisons(members: DataFrame, weights: DataFrame, most: int) -> DataFrame:
    """members: (node, key), distinct; weights: (node, weight).  Gives (node, task, side): a task compares its nodes of side 0 with those of side 1, or, without any, among themselves."""
    shared = members.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    linked = scratch.write(members.join(shared, "key").select("node", "key", "leader"), "linked")
    near = linked.groupBy("node").agg(F.min("leader").alias("near"))
    home = near.join(near.select(F.col("node").alias("near"), F.col("near").alias("home")), "near").select("node", "home").join(weights, "node")
    # Only homes that are cut need their number of cuts; their rows meet it on several keys, so that a hot home is no hot task.
    large = home.groupBy("home").agg(F.ceil(F.sum("weight") / most).alias("cuts")).where("cuts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = home.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(SALTS)).cast("int")).join(large, ["home", "salt"], "left")
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.coalesce("cuts", F.lit(1))))
    blocks = scratch.write(salted.select("node", block.alias("block")), "blocks")
    held = linked.join(blocks, "node").groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    left, right = held.select("key", F.col("block").alias("a"), "n"), held.select("key", F.col("block").alias("b"))
    pairs = left.join(right, "key").where("a < b or (a = b and n > 1)").select("a", "b").distinct().withColumn("task", F.xxhash64("a", "b"))
    pairs = scratch.write(pairs, "pairs")
    sides = pairs.select("task", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("task", F.col("b").alias("block"), F.lit(1).alias("side")))
    return blocks.join(sides, "block").select("node", "task", "side")


def local_roots(n: int, a, b) -> list[int]:
    """The least connected index of each of n, by union and find over index pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
