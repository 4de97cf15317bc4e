"""The later linkage passes against plain loops over all pairs, and small cases with closed answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave import queries
from lineweave.functions import kernels
from lineweave.operators import graph, lineage, matching, passes
from lineweave.plans.thresholds import Thresholds

SF = "/root/testdata/sf0.001"
T = Thresholds()


def lines(df, key):
    return {r[key]: (r["kv"], np.array([[p["x"], p["y"]] for p in r["points"]]), r["km"]) for r in df.collect()}


def unit(line):
    d = line[-1] - line[0]
    n = math.hypot(*d)
    return d / n if n else d


def strict(a, b):
    return (a == b == 220) or (a in (380, 400) and b in (380, 400))


def fold(scores, least, group=lambda a: 0):
    taken, out = {}, {}
    for a in sorted({a for a, _ in scores}):
        used = taken.setdefault(group(a), set())
        for score, b in sorted(((s, b) for (x, b), s in scores.items() if x == a), key=lambda c: (-c[0], c[1])):
            if least(score) and b not in used:
                used.add(b)
                out[a] = (b, score)
                break
    return out


def same(rows, expected):
    got = {r["a_id"]: (r["b_id"], r["score"]) for r in rows}
    assert {a: b for a, (b, _) in got.items()} == {a: b for a, (b, _) in expected.items()}
    assert all(abs(got[a][1] - s) < 1e-5 for a, (_, s) in expected.items())


@pytest.fixture(scope="module")
def sides(spark):
    refs, models = queries._sides(spark, SF)
    return lines(refs, "a_id"), lines(models, "b_id")


def test_visual_pass(spark, sides):
    scores = {}
    for a, (kv, p, _) in sides[0].items():
        for b, (kv2, q, _) in sides[1].items():
            share = kernels.covered_share(q, p, T.overlap_buffer) if strict(kv, kv2) else 0
            if share > 0:
                ends = sum(0.5 for i in (0, -1) if math.hypot(*(p[i] - q[i])) < 2 * T.overlap_buffer)
                scores[a, b] = 0.5 * share + 0.3 * ends + 0.2 * abs(unit(p) @ unit(q))
    same(queries.visual_pass(spark, SF).collect(), fold(scores, lambda s: s > T.visual_least))


def test_simple_pass(spark, sides):
    scores = {}
    for a, (kv, p, km) in sides[0].items():
        n = len(p)
        if n > 5:
            continue
        steps = np.linalg.norm(np.diff(p, axis=0), axis=1)
        lat = (steps * (p[:-1, 1] + p[1:, 1]) / 2).sum() / steps.sum()
        reach = T.late_buffer_m * 6 / max(n, 2) / (111_111 * math.cos(math.radians(abs(lat))))
        for b, (kv2, q, km2) in sides[1].items():
            if not (strict(kv, kv2) or kv == kv2 or (kv == 220 and kv2 in (220, 380, 400))):
                continue
            share = kernels.covered_share(q, p, reach)
            if share > 0:
                ratio, cosine = min(km, km2) / max(km, km2), abs(unit(p) @ unit(q))
                if n <= 3:
                    scores[a, b] = 0.6 * cosine + 0.35 * ratio + 0.05 * share + 0.1 * (ratio >= 0.9) + 0.1 * (km2 < 0.7 * km and cosine > 0.9)
                else:
                    scores[a, b] = 0.45 * cosine + 0.3 * ratio + 0.25 * share
    same(queries.simple_pass(spark, SF).collect(), fold(scores, lambda s: s > T.late_least))


def test_parallel_pass(spark, sides):
    scores = {}
    used = {(int(a) % 50, f"m{a}") for a in sides[0] if int(a) % 4 == 0}
    for a, (kv, p, km) in sides[0].items():
        for b, (kv2, q, km2) in sides[1].items():
            if strict(kv, kv2) and (int(a) % 50, b) not in used:
                share = kernels.covered_share(q, p, T.overlap_buffer)
                if share > 0:
                    scores[a, b] = 0.7 * share + 0.3 * min(km, km2) / max(km, km2)
    same(queries.parallel_pass(spark, SF).collect(), fold(scores, lambda s: s >= T.parallel_least, lambda a: int(a) % 50))


def test_bus_paths(spark):
    point = "array<struct<x:double,y:double>>"
    edges = [("A", "B", "e1", 1.0, 380.0, [(0.0, 0.0), (0.01, 0.0)]), ("B", "C", "e2", 1.0, 400.0, [(0.01, 0.0), (0.02, 0.0)]), ("C", "D", "e3", 1.0, 220.0, [(0.02, 0.0), (0.03, 0.0)])]
    edge = spark.createDataFrame(edges, f"u string, v string, id string, weight double, kv double, points {point}")
    whole = [(0.02, 0.0), (0.0, 0.0)]
    refs = [("1", "C", "A", 380.0, 2.0, whole), ("2", "A", "D", 380.0, 3.0, whole), ("3", "A", "Z", 380.0, 3.0, whole), ("4", "A", "A", 380.0, 1.0, whole), ("5", "A", "C", None, 2.0, whole), ("6", "A", "C", 400.0, 90.0, whole)]
    got = passes.bus_paths(spark.createDataFrame(refs, f"a_id string, source string, target string, kv double, km double, points {point}"), edge).collect()
    assert [(r["a_id"], r["b_ids"], round(r["ratio"], 6), round(r["score"], 6)) for r in got] == [("1", ["e2", "e1"], 1.0, 1.0)]
    assert queries.bus_paths(spark, SF).count() > 0


def test_parts_of_a_long_chain(spark):
    chain = [(f"a{i:03}", f"b{i + d:03}") for i in range(60) for d in (0, 1)] + [("z", "zz")]
    parts = {r["a_id"]: r["part"] for r in matching.candidate_parts(spark.createDataFrame(chain, "a_id string, b_id string")).collect()}
    assert parts == {f"a{i:03}": "a000" for i in range(60)} | {"z": "z"}
    assert matching.candidate_parts(spark.createDataFrame([], "a_id string, b_id string")).isEmpty()


def test_shortest_paths_by_joins(spark):
    edge = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(6)] + [("n0", "n4", 10.0)], "u string, v string, weight double")
    wanted = spark.createDataFrame([("n0", "n4"), ("n6", "n0"), ("n0", "x")], "source string, target string")
    key = lambda df: sorted((r["source"], r["target"], r["distance"], r["path"]) for r in df.collect())
    assert key(graph.shortest_paths(edge, wanted, most=0)) == key(graph.shortest_paths(edge, wanted))


def test_passes_on_empty_tables(spark):
    refs, models = queries._sides(spark, SF)
    assert passes.visual(refs.limit(0), models).isEmpty() and passes.simple(refs, models.where(F.lit(False))).isEmpty()


def test_cut_keeps_rows(spark):
    assert lineage.cut(spark.range(5)).count() == 5


def test_greedy_assign_tries_all_candidates(spark):
    best = {}
    for r in queries.model_lines(spark, SF).select("a_id", "partkey", "suppkey", "length_m").collect():
        key = r["a_id"], f"P{r['partkey'] * 1000 + r['suppkey']}"
        best[key] = max(best.get(key, 0), r["length_m"])
    rows = queries.greedy_assign(spark, SF).collect()
    assert len(rows) == len({r["a_id"] for r in rows})
    same(rows, fold(best, lambda s: True))


def test_all_sources(spark):
    best = {}
    for r in queries.graph_edges(spark, SF).collect():
        best[r["u"], r["v"]] = best[r["v"], r["u"]] = r["weight"]
    nodes = {u for u, _ in best}
    for k in nodes:
        for i in nodes:
            for j in nodes:
                if i != j and (i, k) in best and (k, j) in best:
                    best[i, j] = min(best.get((i, j), math.inf), best[i, k] + best[k, j])
    got = {(r["source"], r["target"]): r["distance"] for r in queries.sssp_all(spark, SF).collect()}
    assert got.keys() == best.keys() and {s for s, _ in got} == nodes and all(abs(got[k] - d) < 1e-5 for k, d in best.items())


def test_nearest_of_all_nodes(spark):
    at = {r["vec_id"]: (r["points"][0]["x"], r["points"][0]["y"]) for r in queries.polylines(spark, SF).collect()}
    exp = set()
    for i, p in at.items():
        near = sorted((math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), j) for j, q in at.items() if j != i)
        exp |= {(i, j, n + 1) for n, (d, j) in enumerate(near[: T.nearest_kept]) if d < 0.045}
    assert {tuple(r) for r in queries.nearest_nodes_all(spark, SF).select("vec_id", "node", "rank").collect()} == exp


def test_late_signatures_of_all_lines(spark):
    sig = lambda r: [r["s"][e][c] for e in "ab" for c in "xy"]
    p = queries.polylines(spark, SF)
    left = p.select("vec_id", queries.G.signature(F.col("points")).alias("s")).collect()
    models = p.select("vec_id", queries.G.signature(queries._shifted(0.003, 10)).alias("s")).where("vec_id % 3 < 1 + vec_id % 2").collect()
    exp = {}
    for r in left:
        for m in models:
            n, k = r["s"]["length"], m["s"]["length"]
            if all(abs(x - y) < T.signature_late for x, y in zip(sig(r), sig(m), strict=True)) and abs(n - k) / max(n, k) < T.signature_length:
                exp[r["vec_id"]] = min(exp.get(r["vec_id"], "z"), f"m{m['vec_id']}")
    assert {r["vec_id"]: r["b_id"] for r in queries.late_signatures_all(spark, SF).collect()} == exp and any(i % 2 for i in exp)


def test_passes_take_all_lines_and_whole_ones(spark):
    ids = {str(r["vec_id"]) for r in queries.polylines(spark, SF).collect()}
    for whole in (False, True):
        refs = lines(queries._sides(spark, SF, whole)[0], "a_id")
        assert refs.keys() == ids
    assert {len(p) for _, p, _ in refs.values()} == {8}
