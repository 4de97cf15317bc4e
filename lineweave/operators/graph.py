"""The network as tables: edges, degrees, shortest paths and chains."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import kernels
from lineweave.operators import lineage


def edges(lines: DataFrame, length: str = "length_m") -> DataFrame:
    """One edge a pair of buses, undirected, no loops; of parallel lines the last by id stays.  Lengths of 0 count as 0.001."""
    ends = lines.where("bus0 is not null and bus1 is not null and bus0 <> bus1").select(F.least("bus0", "bus1").alias("u"), F.greatest("bus0", "bus1").alias("v"), "id", F.col(length).alias("weight"))
    last = ends.groupBy("u", "v").agg(F.max(F.struct("id", "weight")).alias("m"), F.count(F.lit(1)).alias("parallel"))
    return last.select("u", "v", F.col("m.id").alias("id"), F.when(F.col("m.weight") > 0, F.col("m.weight")).otherwise(0.001).alias("weight"), "parallel")


def degrees(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("u").alias("node")).unionAll(edge.select(F.col("v").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def free_ends(edge: DataFrame) -> DataFrame:
    return degrees(edge).where("degree = 1").select("node")


def neighbours(edge: DataFrame) -> DataFrame:
    """Pairs of edges that share a node."""
    ends = edge.select("id", F.explode(F.array("u", "v")).alias("node"))
    a, b = ends.select(F.col("id").alias("a"), "node"), ends.select(F.col("id").alias("b"), "node")
    return a.join(b, "node").where("a < b").select("a", "b").distinct()


#: Largest number of edges that is sent to all executors for shortest paths: at about 300 bytes an edge, 60 MB in each worker.
BROADCAST_EDGES = 200_000


def shortest_paths(edge: DataFrame, queries: DataFrame, most: int = BROADCAST_EDGES) -> DataFrame:
    """queries: (source, target).  Gives (source, target, distance, path), for reachable targets.

    A network of at most `most` edges is broadcast and searched by Dijkstra's method
    from each distinct source; a larger one is relaxed by joins.  Of equally long paths
    both give the one whose nodes come first.
    """
    spark = edge.sparkSession
    rows = edge.select("u", "v", "weight").limit(most + 1).toPandas()
    if len(rows) > most:
        return _relaxed(edge, queries)
    graph: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for u, v, w in rows.itertuples(index=False):
        graph[u].append((v, w))
        graph[v].append((u, w))
    shared = spark.sparkContext.broadcast(dict(graph))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for batch in batches:
            out = []
            for source, targets in zip(batch["source"], batch["targets"], strict=True):
                left, best, done, heap = set(targets), {source: 0.0}, set(), [(0.0, (source,))]
                while heap and left:
                    d, path = heapq.heappop(heap)
                    u = path[-1]
                    if u in done:
                        continue
                    done.add(u)
                    if u in left:
                        left.discard(u)
                        out.append((source, u, d, list(path)))
                    for v, w in net.get(u, ()):
                        if v not in done and d + w <= best.get(v, float("inf")):
                            best[v] = d + w
                            heapq.heappush(heap, (d + w, (*path, v)))
            yield pd.DataFrame(out, columns=["source", "target", "distance", "path"])

    grouped = queries.groupBy("source").agg(F.collect_set("target").alias("targets"))
    return grouped.mapInPandas(run, "source string, target string, distance double, path array<string>")


def _relaxed(edge: DataFrame, queries: DataFrame) -> DataFrame:
    both = edge.select("u", "v", "weight").unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    best = queries.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.array("source").alias("path"))
    fresh = best
    while not fresh.isEmpty():
        step = fresh.join(both, fresh["node"] == both["u"]).select("source", F.col("v").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("v")).alias("path"))
        now = lineage.cut(best.unionByName(step).groupBy("source", "node").agg(F.min(F.struct("distance", "path")).alias("m")).select("source", "node", "m.distance", "m.path"))
        fresh = now.join(best, ["source", "node", "distance"], "left_anti")
        best = now
    return queries.join(best.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", "distance", "path")


def paths_by_length(paths: DataFrame, target_length: str, k: int = 5) -> DataFrame:
    """The k paths whose length is closest to the wanted one."""
    w = Window.partitionBy("a_id").orderBy(F.abs(F.col("distance") - F.col(target_length)), "source", "target")
    return paths.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grow_chains(seeds: DataFrame, parts: DataFrame, buffer: float, ratio: float = 0.8, most: int = 10, reach: float = 1.25, iou: float = 0.2, explain: bool = False) -> DataFrame:
    """Extend short matches from their free ends along neighbouring lines that fit the reference line.

    seeds: (a_id, points, length, chain) with chain an array of ids; parts: the
    candidate lines of each seed (a_id, b_id, points, length, u, v), brought together
    beforehand by box_pairs, so a group holds one reference line's surroundings.  The
    longest fitting neighbour is added until the share of length is reached.
    """
    schema = "a_id string, chain array<string>, added int, ratio double" if not explain else "a_id string, step int, b_id string, decision string, distance double, overlap double"

    def run(key, seed: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out, log = [], []
        lines = {r.b_id: r for r in near.itertuples(index=False)}
        for s in seed.itertuples(index=False):
            target = np.array([[p["x"], p["y"]] for p in s.points])
            chain = [c for c in s.chain if c in lines]
            have = sum(lines[c].length for c in chain)
            added = 0
            while chain and added < most and s.length > 0 and have / s.length < ratio:
                degree: dict = defaultdict(int)
                for c in chain:
                    degree[lines[c].u] += 1
                    degree[lines[c].v] += 1
                free = {n for n, d in degree.items() if d == 1}
                fits = []
                for b, r in sorted(lines.items()):
                    if b in chain or not {r.u, r.v} & free:
                        continue
                    own = np.array([[p["x"], p["y"]] for p in r.points])
                    d = float(kernels.distance_to(own, target).max())
                    o = kernels.buffer_areas(own, target, buffer)[1] if d > reach * buffer else 1.0
                    good = d <= reach * buffer or o >= iou
                    log.append((key[0], added, b, "fits" if good else "too far", d, o))
                    if good:
                        fits.append((-r.length, b))
                if not fits:
                    break
                best = min(fits)[1]
                chain.append(best)
                have += lines[best].length
                added += 1
            out.append((key[0], chain, added, have / s.length if s.length else 0.0))
        names = [f.split()[0] for f in schema.split(", ")]
        return pd.DataFrame(log if explain else out, columns=names)

    return seeds.groupBy("a_id").cogroup(parts.groupBy("a_id")).applyInPandas(run, schema)
