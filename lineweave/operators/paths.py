"""Paths of several model lines between the ends of a reference line: candidates, their scores, ordered assignment.

Lines come as refs (a_id, kv, points, km, r, x, b) and models (b_id, kv, points, km,
circuits, r, x, b), electrical values per km.  Model lines meet in nodes, the places of
their ends; of several lines between two nodes the last by id stays in the network.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import scalars as S
from lineweave.operators import graph, joins, lineage, matching
from lineweave.plans.thresholds import Thresholds


def nodes(models: DataFrame) -> DataFrame:
    """(node, node_x, node_y): the places where model lines end."""
    ends = models.select(F.explode(F.array(G.start(F.col("points")), G.end(F.col("points")))).alias("p"))
    return ends.select(G.node_id(F.col("p")).alias("node"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).groupBy("node").agg(F.min("x").alias("node_x"), F.min("y").alias("node_y"))


def network(models: DataFrame) -> DataFrame:
    """Edges between nodes, as graph.edges gives them."""
    ends = models.select(F.col("b_id").alias("id"), G.node_id(G.start(F.col("points"))).alias("bus0"), G.node_id(G.end(F.col("points"))).alias("bus1"), F.col("km").alias("length_km"))
    return graph.edges(ends, "length_km")


def end_pairs(refs: DataFrame, places: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(a_id, source, target): the nearest nodes of either end within reach, a few of each, all pairs of these."""
    sides = []
    for name, end in (("source", G.start), ("target", G.end)):
        p = end(F.col("points"))
        near = joins.nearest_k(refs.select("a_id", p["x"].alias("x"), p["y"].alias("y")), places, "a_id", "node", ("x", "y"), ("node_x", "node_y"), t.endpoint_km / G.KM_PER_DEGREE, t.nearest_kept)
        place = F.struct(F.col("node_x").alias("x"), F.col("node_y").alias("y"))
        sides.append(near.where(F.col("rank") <= t.pairs_tried).select("a_id", F.col("node").alias(name), place.alias(f"{name}_place")))
    return sides[0].join(sides[1], "a_id").where("source <> target")


def mean_per_km(legs: Column, value: str) -> Column:
    """A value of the legs, weighted by their lengths; a leg without it counts as 0."""
    total = F.aggregate(legs, F.lit(0.0), lambda s, e: s + F.coalesce(e[value], F.lit(0.0)) * e["km"])
    km = F.aggregate(legs, F.lit(0.0), lambda s, e: s + e["km"])
    return F.when(km > 0, total / km)


def path_similarity(refs: list[Column], means: list[Column]) -> Column:
    """Mean closeness of a path's values to the line's; half where one of the two is unknown."""
    each = [F.when((a > 0) & (m > 0), 1 - F.least(F.abs(a - m) / a, F.lit(1.0))).otherwise(0.5) for a, m in zip(refs, means, strict=True)]
    return sum(each) / len(each)


def candidates(refs: DataFrame, models: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(a_id, b_ids, circuits, segments, ratio, score): shortest paths between near nodes.

    Lines of another voltage on a path are left out of it, as long as its length and direction stay right.
    """
    pairs, net = lineage.cut(end_pairs(refs, nodes(models), t)), lineage.cut(network(models))
    found = graph.shortest_paths(net, pairs.select("source", "target").distinct())
    steps = found.select("source", "target", "path", F.posexplode(F.sequence(F.lit(0), F.size("path") - 2)).alias("step", "_i"))
    steps = steps.select("source", "target", "step", F.col("path")[F.col("_i")].alias("p"), F.col("path")[F.col("_i") + 1].alias("q"))
    edge = net.select("u", "v", F.col("id").alias("b_id")).join(models.select("b_id", "kv", "km", "circuits", "r", "x", "b", F.col("points").alias("line")), "b_id")
    legs = steps.join(edge, (F.least("p", "q") == F.col("u")) & (F.greatest("p", "q") == F.col("v")))
    legs = legs.withColumn("line", F.when(G.node_id(G.start(F.col("line"))) == F.col("p"), F.col("line")).otherwise(F.reverse("line")))
    whole = legs.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("step", "b_id", "kv", "km", "circuits", "r", "x", "b", "line"))).alias("legs"))
    a = refs.select("a_id", F.col("kv").alias("a_kv"), F.col("points").alias("a_points"), F.col("km").alias("a_km"), *[F.col(c).alias(f"a_{c}") for c in "rxb"])
    rows = pairs.join(whole, ["source", "target"]).join(a, "a_id")
    rows = rows.withColumn("legs", F.filter("legs", lambda e: F.coalesce(S.compatible(F.col("a_kv"), e["kv"], "strict"), F.lit(False)))).where(F.size("legs") > 0)
    ratio = F.when(F.col("a_km") > 0, F.aggregate("legs", F.lit(0.0), lambda s, e: s + e["km"]) / F.col("a_km")).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).where(F.col("ratio").between(t.ratio_low, t.ratio_high))
    along = G.direction(F.array("source_place", "target_place"))
    rows = rows.withColumn("cosine", G.abs_cos(G.direction(F.col("a_points")), along)).where(F.col("cosine") >= t.direction_least)
    # Where a line was left out the path has a gap: a point of NaN parts it.
    nothing = F.array(G.point(F.lit(float("nan")), F.lit(float("nan"))))
    first = lambda e: e["step"] == F.element_at("legs", 1)["step"]
    before = lambda e: F.exists("legs", lambda o: o["step"] == e["step"] - 1)
    rows = rows.withColumn("line", F.flatten(F.transform("legs", lambda e: F.when(first(e) | before(e), e["line"]).otherwise(F.concat(nothing, e["line"])))))
    measured = matching.line_measures(rows, "a_points", "line", t.corridor_buffer, ("area_share",))
    one = S.electrical_similarity([F.col(f"a_{c}") for c in "rxb"], [F.col("legs")[0][c] for c in "rxb"])
    several = path_similarity([F.col("a_r"), F.col("a_x")], [mean_per_km(F.col("legs"), c) for c in "rx"])
    segments = F.size("legs")
    score = matching.path_score(segments, F.when(segments == 1, one).otherwise(several), F.col("area_share"), F.col("ratio"), F.col("cosine"))
    out = measured.select("a_id", F.col("legs.b_id").alias("b_ids"), F.col("legs.circuits").alias("circuits"), segments.alias("segments"), "ratio", score.alias("score"))
    return out.groupBy("a_id", "b_ids").agg(F.max_by(F.struct("circuits", "segments", "ratio", "score"), "score").alias("m")).select("a_id", "b_ids", "m.*")


def assign(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(a_id, b_ids, ratio, score): reference lines, by string id, take the best path all of whose lines have circuits left and serve no other line of their group.

    found: (a_id, b_ids, circuits, ratio, score); groups: (a_id, parallel_group).  Connected parts of the candidates are folded apart.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, left, mine, done = None, {}, set(), None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.part != part:
                    part, left, mine, done = r.part, {}, set(), None
                for b, c in zip(r.b_ids, r.circuits, strict=True):
                    left.setdefault(b, int(c))
                if r.a_id == done or any(left[b] < 1 for b in r.b_ids) or (r.parallel_group and any((r.parallel_group, b) in mine for b in r.b_ids)):
                    continue
                done = r.a_id
                for b in r.b_ids:
                    left[b] -= 1
                    mine.add((r.parallel_group, b))
                out.append((r.a_id, list(r.b_ids), float(r.ratio), float(r.score)))
            yield pd.DataFrame(out, columns=["a_id", "b_ids", "ratio", "score"])

    parts = matching.candidate_parts(found.select("a_id", F.explode("b_ids").alias("b_id")))
    rows = found.join(parts, "a_id").join(groups, "a_id", "left").select("part", "a_id", "b_ids", "circuits", "ratio", "score", "parallel_group")
    ordered = rows.repartition("part").sortWithinPartitions("part", "a_id", F.desc("score"), "b_ids")
    return ordered.mapInPandas(fold, "a_id string, b_ids array<string>, ratio double, score double")
