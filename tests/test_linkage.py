"""The linkage from end to end: paths of several lines, later passes, chain extension, missed parallels."""

from dataclasses import replace

import pytest

from lineweave.operators import graph, matching, paths
from lineweave.plans import pipeline
from lineweave.plans.thresholds import Thresholds
from lineweave.sources import readers

REF = "id;name;v_nom;length;r;geometry;bus0;bus1"
MODEL = "line_id;v_nom;length;circuits;r;geometry;bus0;bus1"


def line(*points):
    return "'LINESTRING (" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in points) + ")'"


def read(spark, folder, name, head, rows, **how):
    path = folder / f"{name}.csv"
    path.write_text(head + "\n" + "\n".join(";".join(map(str, r)) for r in rows) + "\n")
    return readers.read_lines(spark, str(path), **how)


def km(a, b):
    return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 * 111


@pytest.fixture
def grid(spark, tmp_path):
    refs, models = [], []

    def ref(i, points, kv=380, length=None):
        refs.append((i, i, kv, round(length or km(points[0], points[-1]), 3), 1, line(*points), f"{i}s", f"{i}e"))

    def model(i, points, kv=380, circuits=1, length=None):
        models.append((i, kv, round((length or km(points[0], points[-1])) * 1000, 1), circuits, 1, line(*points), "", ""))

    # 1: three segments end to end, none long enough alone.
    ref("1", [(7, 50), (7.3, 50), (7.6, 50), (7.9, 50)])
    for n, x in enumerate((7, 7.3, 7.6)):
        model(f"way/10{n}-380", [(x, 50.001), (x + 0.3, 50.001)])
    # 2: one line whose length and direction are right, but which is listed with far too short a length: no path, seen by its place only.
    ref("2", [(9, 48), (9.4, 48)])
    model("way/200-380", [(9, 48.001), (9.4, 48.001)], length=3.0)
    # 3: less than half of it is one line, which two more follow; none ends near its end.
    ref("3", [(7, 52), (7.2, 52), (7.48, 52)], 220)
    model("way/300-220", [(7, 52.001), (7.2, 52.001)], 220)
    model("way/301-220", [(7.2, 52.001), (7.3, 52.001)], 220, length=3.0)
    model("way/302-220", [(7.3, 52.001), (7.4, 52.001)], 220, length=1.0)
    # 4: alike, but of another voltage.
    ref("4", [(16, 48), (16.3, 48)], 220)
    model("way/400-380", [(16, 48.001), (16.3, 48.001)])
    # 7 and 8: one shape; the first has a line, the second a piece beside it that bends away.
    for i in "78":
        ref(i, [(10 + x / 6, 50) for x in range(7)])
    model("way/700-380", [(10, 50.001), (11, 50.001)])
    model("way/701-380", [(10.3, 50.001), (10.54, 50.001), (10.6, 50.02)])
    # 21 and 22: one shape; the second's line has the first's id but for its number, and lies nowhere near.
    for i in ("21", "22"):
        ref(i, [(4, 45), (4.4, 45)])
    model("relation/11-380-a", [(4, 45.001), (4.4, 45.001)])
    model("relation/12-380-a", [(24, 40), (24.4, 40)])
    # 31 and 32: one shape, one line.
    for i in ("31", "32"):
        ref(i, [(1, 43), (1.4, 43)])
    model("way/900-380", [(1, 43.001), (1.4, 43.001)])
    # 5 and 6: nothing near.
    ref("5", [(14, 54), (14.5, 54)])
    ref("6", [(12, 53), (12.5, 53)], 110)
    return read(spark, tmp_path, "refs", REF, refs), read(spark, tmp_path, "models", MODEL, models, metres=True)


def test_link_runs_every_pass(spark, grid):
    refs, models = grid
    got = {r["a_id"]: r for r in pipeline.link(refs, models).links.collect()}
    assert got["1"]["b_ids"] == ["way/100-380", "way/101-380", "way/102-380"] and got["1"]["how"] == "path" and got["1"]["quality"].startswith("3-Segment")
    assert got["2"]["b_ids"] == ["way/200-380"] and got["2"]["how"] == "visual"
    assert got["3"]["b_ids"][0] == "way/300-220" and set(got["3"]["b_ids"]) == {"way/300-220", "way/301-220", "way/302-220"} and got["3"]["how"] == "visual+extended"
    assert got["4"]["b_ids"] == ["way/400-380"] and got["4"]["how"] == "coarse"
    assert got["7"]["b_ids"] == ["way/700-380"] and got["8"]["b_ids"] == ["way/701-380"] and got["8"]["how"].startswith("parallel")
    assert got["21"]["b_ids"] == ["relation/11-380-a"] and got["22"]["b_ids"] == ["relation/12-380-a"] and got["22"]["how"] == "pattern"
    assert got["31"]["b_ids"] == got["32"]["b_ids"] == ["way/900-380"] and got["32"]["how"] == "copy" and got["32"]["is_copy"]
    assert not got["5"]["matched"] and not got["6"]["matched"] and got["5"]["b_ids"] == []


def test_target_ratio_stops_the_extension(spark, grid):
    refs, models = grid
    got = {r["a_id"]: r for r in pipeline.link(refs, models, t=replace(Thresholds(), extend_ratio=0.4)).links.collect()}
    assert got["3"]["b_ids"] == ["way/300-220"] and got["3"]["how"] == "visual"


def test_paths_of_one_group_share_no_line(spark):
    rows = [("1", ["a", "b"], [1, 2], 1.0, 0.9), ("1", ["c"], [1], 1.0, 0.5), ("2", ["a", "b"], [1, 2], 1.0, 0.9), ("2", ["b"], [2], 1.0, 0.8), ("3", ["b"], [2], 1.0, 0.7), ("4", ["b"], [2], 1.0, 0.7)]
    found = spark.createDataFrame(rows, "a_id string, b_ids array<string>, circuits array<int>, ratio double, score double")
    alone = spark.createDataFrame([], "a_id string, parallel_group string")
    got = {r["a_id"]: r["b_ids"] for r in paths.assign(found, alone).collect()}
    assert got == {"1": ["a", "b"], "2": ["b"]}
    grouped = spark.createDataFrame([("1", "g"), ("2", "g")], "a_id string, parallel_group string")
    got = {r["a_id"]: r["b_ids"] for r in paths.assign(found, grouped).collect()}
    assert got == {"1": ["a", "b"], "3": ["b"]}


def test_paths_leave_out_lines_of_another_voltage(spark):
    struct = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    schema = "kv double, points array<struct<x:double,y:double>>, km double, r double, x double, b double"
    refs = spark.createDataFrame([("a", 380.0, struct((0, 0), (0.3, 0)), 33.0, 2.0, 4.0, None)], f"a_id string, {schema}")
    legs = [("p", 380.0, struct((0.1, 0.001), (0, 0.001)), 11.0, 1.0, 4.0, None, 1), ("q", 220.0, struct((0.1, 0.001), (0.2, 0.001)), 11.0, 9.0, 9.0, None, 1), ("s", 400.0, struct((0.2, 0.001), (0.3, 0.001)), 11.0, 3.0, 4.0, None, 2)]
    models = spark.createDataFrame(legs, f"b_id string, {schema}, circuits int")
    got = {tuple(r["b_ids"]): r for r in paths.candidates(refs, models).collect()}
    r = got[("p", "s")]
    assert r["circuits"] == [1, 2] and abs(r["ratio"] - 2 / 3) < 1e-9 and r["segments"] == 2
    # Mean r is 2 and mean x 4: equal to the line's.  Covered in large part, one third too short, straight along it.
    assert 0.25 + 0.35 * 0.5 + 0.25 * 2 / 3 + 0.15 <= r["score"] + 1e-9 <= 0.25 + 0.35 * 0.75 + 0.25 * 2 / 3 + 0.15


def test_contained_suffixes(spark):
    linked = spark.createDataFrame([("g", "relation/11-380-a", 380.0)], "parallel_group string, id string, kv double")
    rows = [("relation/12-380-a", 380.0), ("relation/13-380-ab", 400.0), ("relation/11-380-ab", 380.0), ("relation/14-380-a", 220.0), ("relation/13-380-a+2", 380.0), ("way/9-380-b", 380.0)]
    models = spark.createDataFrame(rows, "b_id string, kv double")
    got = sorted((r["b_id"], r["pattern"]) for r in matching.by_contained_suffix(linked, models).collect())
    assert got == [("relation/12-380-a", "12"), ("relation/13-380-a+2", "13"), ("relation/13-380-ab", "13")]
    found = spark.createDataFrame([("x", b, p) for b, p in got], "a_id string, b_id string, pattern string")
    assert [(r["a_id"], r["b_ids"]) for r in matching.largest_pattern(found).collect()] == [("x", ["relation/13-380-a+2", "relation/13-380-ab"])]


def test_paths_by_length(spark):
    rows = [("a", f"s{i}", "t", d, 10.0) for i, d in enumerate((9.0, 15.0, 10.5, 30.0))]
    df = spark.createDataFrame(rows, "a_id string, source string, target string, distance double, wanted double")
    assert [r["source"] for r in graph.paths_by_length(df, "wanted", 2).orderBy("rank").collect()] == ["s2", "s0"]


def test_free_ends_and_twins(spark):
    edge = spark.createDataFrame([("a", "b", "1"), ("b", "c", "2")], "u string, v string, id string")
    assert sorted(r["node"] for r in graph.free_ends(edge).collect()) == ["a", "c"]
    measured = spark.createDataFrame([(0.0001, 1.0), (0.0001, 1.2), (0.01, 1.0)], "hausdorff double, length_ratio double")
    assert matching.twins(measured).count() == 1
