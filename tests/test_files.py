"""Further readers and writers, boundaries, and assignment in rounds."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import kernels
from lineweave.operators import analytics, joins, matching
from lineweave.sources import readers, writers


def collection(*geometries):
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": str(i), "kv": 380}, "geometry": g} for i, g in enumerate(geometries)]}


def test_geojson_lines(spark, tmp_path):
    whole = collection({"type": "LineString", "coordinates": [[1, 2], [3, 4.5]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}, {"type": "Point", "coordinates": [1, 2]})
    path = tmp_path / "whole.json"
    path.write_text(json.dumps(whole, indent=1))
    got = {r["id"]: [[(p["x"], p["y"]) for p in part] for part in r["parts"]] for r in readers.read_geojson_lines(spark, str(path)).collect()}
    assert got == {"0": [[(1.0, 2.0), (3.0, 4.5)]], "1": [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]}
    lines = spark.createDataFrame([("a", [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}])], "id string, points array<struct<x:double,y:double>>")
    writers.write_geojson_lines(lines, "points", ["id"], str(tmp_path / "rows"))
    back = readers.read_geojson_lines(spark, str(tmp_path / "rows")).collect()
    assert [(r["id"], [(p["x"], p["y"]) for p in r["parts"][0]]) for r in back] == [("a", [(1.0, 2.0), (3.0, 4.0)])]


def test_geometry_cut_at_commas_is_glued(spark):
    df = spark.createDataFrame([("1", "x", "'LINESTRING (1 2", " 3 4", " 5 6)'", None), ("2", "y", "none", None, None, None)], "id string, name string, geometry string, a string, b string, c string")
    got = {r["id"]: r["geometry"] for r in readers.glue_geometry(df).collect()}
    assert got == {"1": "LINESTRING (1 2, 3 4, 5 6)", "2": None}


def test_manual_links_come_back(spark, tmp_path):
    links = spark.createDataFrame([("1", ["a", "b"], "why"), ("2", ["c"], None)], readers.MANUAL_SCHEMA)
    writers.write_manual_links(links, str(tmp_path / "manual"))
    assert sorted(map(tuple, readers.read_manual_links(spark, str(tmp_path / "manual")).collect())) == sorted(map(tuple, links.collect()))


def test_changes_and_their_text(spark, tmp_path):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 5.0)], "id long, r double, x double")
    new = spark.createDataFrame([(1, 1.5, 2.0), (2, 3.0, None)], "id long, r double, x double")
    log = analytics.change_log(old, new, "id", ("r", "x"))
    assert sorted(map(tuple, log.collect()), key=str) == [(1, "r", 1.0, 1.5), (2, "r", None, 3.0), (2, "x", 5.0, None)]
    text = writers.write_changes(log, str(tmp_path / "log"), 2).split("\n")
    assert text[0] == "3 values changed" and len(text) == 3 and text[1] == "id: 1, column: r, old: 1.0, new: 1.5"


def test_matching_rows(spark):
    links = spark.createDataFrame([("1", ["p", "q"], True), ("2", [], False)], "a_id string, b_ids array<string>, matched boolean")
    refs = spark.createDataFrame([("1", "one", 380.0, 10.0), ("2", "two", 220.0, 5.0)], "id string, name string, kv double, length_km double")
    models = spark.createDataFrame([("p", 4.0), ("q", 5.0)], "id string, length_km double")
    got = {r["a_id"]: (r["model_km"], r["segments"], r["ratio"]) for r in writers.matching_rows(links, refs, models).collect()}
    assert got == {"1": (9.0, 2, 0.9), "2": (None, 0, None)}


@pytest.mark.parametrize("reach", [0.0, 0.4])
def test_lines_meet_a_ring_as_by_sampling(spark, reach):
    rng = np.random.default_rng(3)
    ring = [(0.0, 0.0), (2.0, 0.3), (1.5, 2.0), (0.2, 1.4)]
    lines = rng.uniform(-3, 4, (300, 3, 2))
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in line]) for i, line in enumerate(lines)], "id long, points array<struct<x:double,y:double>>")
    got = {r["id"] for r in df.where(G.meets(F.col("points"), ring, reach)).collect()}
    steps = np.linspace(0, 1, 400)[:, None]
    closed = np.array([*ring, ring[0]])
    for i, line in enumerate(lines):
        dense = np.concatenate([a + (b - a) * steps for a, b in zip(line[:-1], line[1:], strict=True)])
        inside = np.zeros(len(dense), dtype=bool)
        for (x1, y1), (x2, y2) in zip(closed[:-1], closed[1:], strict=True):
            inside ^= ((y1 > dense[:, 1]) != (y2 > dense[:, 1])) & (dense[:, 0] < (x2 - x1) * (dense[:, 1] - y1) / (y2 - y1) + x1)
        apart = 0.0 if inside.any() else float(kernels.distance_to(dense, closed).min())
        if abs(apart - reach) > 0.02:  # samples lie this near to each other
            assert (i in got) == (apart <= reach)


def test_lines_that_meet_a_boundary(spark):
    rows = [("in", [[{"x": 0.5, "y": 0.5}, {"x": 9.0, "y": 9.0}]]), ("near", [[{"x": 1.05, "y": 0.5}, {"x": 2.0, "y": 0.5}]]), ("second", [[{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 6.0}], [{"x": -1.0, "y": 0.5}, {"x": 2.0, "y": 0.5}]])]
    lines = spark.createDataFrame(rows, "id string, parts array<array<struct<x:double,y:double>>>")
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    assert {r["id"] for r in readers.lines_meeting(lines, ring).collect()} == {"in", "second"}
    assert {r["id"] for r in readers.lines_meeting(lines, ring, 0.1 * 111).collect()} == {"in", "near", "second"}
    assert [(r["id"], r["part"]) for r in readers.explode_parts(lines).orderBy("id", "part").collect()] == [("in", 0), ("near", 0), ("second", 0), ("second", 1)]


def test_assignment_in_rounds_is_that_in_order(spark):
    random.seed(21)
    rows = [(f"a{random.randrange(60)}", f"b{random.randrange(40)}", random.choice([0.5, 0.6, 0.7, 0.9]), 0) for _ in range(300)]
    rows = list({(a, b): (a, b, s, 1 + int(b[1:]) % 3) for a, b, s, _ in rows}.values())
    df = spark.createDataFrame(rows, "a_id string, b_id string, score double, circuits int")
    parts = matching.candidate_parts(df)
    left, exp = {b: c for _, b, _, c in rows}, set()
    for a in sorted({r[0] for r in rows}):
        for _, b, s, _ in sorted((r for r in rows if r[0] == a), key=lambda r: (-r[2], r[1])):
            if left[b]:
                left[b] -= 1
                exp.add((a, b, s))
                break
    for most in (matching.FOLD_MOST, 20, 0):
        assert {tuple(r) for r in matching.assign(df, parts, most=most).collect()} == exp


def test_names_within_names(spark):
    a = spark.createDataFrame([("ab", 1), ("b", 2), ("zz", 3), ("", 4)], "part string, n int")
    b = spark.createDataFrame([("xabx",), ("b",), ("b",), (None,)], "whole string")
    got = sorted((r["part"], r["whole"]) for r in joins.containing(a, b, "part", "whole").collect())
    assert got == [("ab", "xabx"), ("b", "b"), ("b", "b"), ("b", "xabx")]
