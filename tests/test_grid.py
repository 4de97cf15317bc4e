"""Unit cases with closed answers, properties of the kernels, and all queries against their SQL."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineweave import queries
from lineweave.functions import geometry as G
from lineweave.functions import kernels
from lineweave.functions import scalars as S
from lineweave.operators import graph, joins, matching
from lineweave.plans import cli, pipeline
from lineweave.sources import readers, writers

SF = "/root/testdata/sf0.001"


def one(spark, column, *values):
    """The column over a one-column frame `v`."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_voltages(spark):
    assert one(spark, S.kv_max, "380/220 kV", "225,0", "220000", "unknown", None) == [380.0, 225.0, 220.0, None, None]
    assert one(spark, lambda c: S.kv_bucket(S.kv_max(c)), "200", "260", "420", "360", "x") == ["220-225", "other", "380-400", "380-400", "unknown"]


def test_numbers(spark):
    assert one(spark, S.locale_num, "1.234", "1,5", "1,234.5", "a", "NaN", None) == [1.234, 1.5, 1234.5, None, None, None]
    assert one(spark, S.safe_int, "3.9", "-3.9", "x", None, "NaN") == [3, -3, 0, 0, 0]
    assert one(spark, lambda c: S.to_km(c.cast("double")), "999.9", "1000", "-2000") == [999.9, 1.0, -2.0]
    assert one(spark, lambda c: S.to_km(c.cast("double"), inclusive=False), "1000", "1001") == [1000.0, 1.001]


def test_percentages(spark):
    base = lambda v: lambda c: S.pct_of_base(c.cast("double"), F.lit(v))
    assert one(spark, base(0.0), "0") == [0.0] and one(spark, base(5.0), "0", "4") == [100.0, 25.0]
    assert one(spark, lambda c: S.pct_or_null(F.lit(1.0), c.cast("double")), "1e-10", "-2") == [None, 150.0]


def test_ids(spark):
    assert one(spark, S.id_pattern, "relation/1641463-380-a", "merged_way/30970013-1-380+3", "way/7_x", "none") == ["1641463", "30970013", "7", None]
    assert one(spark, S.id_suffix, "relation/1641463-380-a") == ["-380-a"]
    assert one(spark, S.id_list, "a; b,,c ;", "", "abcdefghij0,10;11") == [["a", "b", "c"], [], ["abcdefghij0", "10", "11"]]


def test_quality_bands(spark):
    label = lambda c: S.quality_label(c.cast("double"), F.lit(2), F.lit(True))
    assert one(spark, label, "0.8", "0.79", "0.6", "0.39") == [f"Parallel Circuit - 2-Segment {q} Match" for q in ("Excellent", "Good", "Good", "Poor")]


def test_electrical_similarity(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.5), (None, 1.0), (1.0, 9.0)], "a double, b double")
    got = [r[0] for r in df.select(S.electrical_similarity([F.col("a")], [F.col("b")])).collect()]
    assert got == [1.0, 0.5, 0.5, 0.0]


def test_wkt(spark):
    got = one(spark, lambda c: G.parse_wkt(c), "USUALLY ... POINT(1 2)", "'MULTILINESTRING ((0 0, 1 1), (2 2, 3 -3.5))'", "x", None)
    assert [[(p.x, p.y) for p in part] for part in got[1]] == [[(0, 0), (1, 1)], [(2, 2), (3, -3.5)]] and got[0][0][0].y == 2 and got[2:] == [None, None]


def test_synthetic_ids(spark):
    df = spark.createDataFrame([(None, f"n{i}") for i in range(5)], "id string, name string")
    assert {r["id"] for r in S.with_id(df).collect()} == {f"n{i}" for i in range(5)}
    assert sorted(r["id"] for r in S.with_id(df.select("id").repartition(3), "line_").collect()) == [f"line_{i}" for i in range(5)]


def test_kernels_on_known_shapes():
    a, b = np.array([[0.0, 0], [10, 0]]), np.array([[0.0, 1], [10, 1]])
    assert kernels.hausdorff(a, b) == 1 and kernels.covered_share(a, b, 1.0) == 1 and kernels.covered_share(a, b, 0.99) == 0
    half = np.array([[0.0, 0], [5, 0]])
    assert math.isclose(kernels.covered_share(a, half, 1.0), 0.6) and math.isclose(kernels.covered_share(half, a, 0.1), 1.0)
    iou, share = kernels.buffer_areas(a, a + [0, 1], 1.0)
    assert 0.25 < iou < 0.45 and iou < share < 0.65 and kernels.buffer_areas(a, a, 1.0) == (1.0, 1.0) and kernels.buffer_areas(a, a + 50, 1.0) == (0.0, 0.0)
    zigzag = np.array([[0.0, 0], [1, 0.01], [2, 0], [3, 1]])
    assert len(kernels.simplify(zigzag, 0.1)) == 3 and len(kernels.simplify(zigzag, 0)) == 4
    assert kernels.farthest_pair(np.array([[0.0, 0], [9, 0], [1, 0], [3, 0]]), np.array([1, 2, 1, 1])) == (0, 3)


def test_kernels_against_sampling():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 1, (60, 6, 2)), rng.uniform(0, 1, (60, 4, 2))
    a[0, 2], b[1, 1] = a[0, 1], b[1, 0]  # steps without length
    got = kernels.covered_many(a, b, 0.15)
    t = (np.arange(4000) + 0.5) / 4000
    for i in range(60):
        step = np.diff(a[i], axis=0)
        p = a[i][:-1, None] + t[:, None] * step[:, None]
        near = np.array([kernels.distance_to(x, b[i]) <= 0.15 for x in p])
        size = np.linalg.norm(step, axis=1)
        assert abs(got[i] - (near.mean(axis=1) * size).sum() / size.sum()) < 2e-3
        assert math.isclose(kernels.hausdorff_many(a[i : i + 1], b[i : i + 1])[0], kernels.hausdorff(a[i], b[i]))
        assert math.isclose(kernels.hausdorff(a[i], b[i]), kernels.hausdorff(b[i], a[i]))


def test_nearest_within_is_brute_force(spark):
    rng = np.random.default_rng(3)
    a = [(i, *p) for i, p in enumerate(rng.uniform([6, 47], [8, 49], (150, 2)).tolist())]
    b = [(i, *p) for i, p in enumerate(rng.uniform([6, 47], [8, 49], (150, 2)).tolist())]

    def km(p, q):
        dlat, dlon = math.radians(q[2] - p[2]), math.radians(q[1] - p[1])
        h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(dlon / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    got = joins.nearest_within(spark.createDataFrame(a, "a_id int, x double, y double"), spark.createDataFrame(b, "b_id int, bx double, by double"), "a_id", "b_id", ("x", "y"), ("bx", "by"), 9.0)
    exp = {p[0]: min((km(p, q), q[0]) for q in b) for p in a}
    assert {r["a_id"]: r["b_id"] for r in got.collect()} == {k: i for k, (d, i) in exp.items() if d < 9}


def test_box_pairs_gives_each_near_pair_once(spark):
    rng = np.random.default_rng(5)
    lines = [(i, "k", [(float(x), float(y)) for x, y in rng.uniform(0, 1, 2) * 6 + rng.uniform(0, 1.5, (3, 2))]) for i in range(60)]
    df = spark.createDataFrame(lines, "a int, k string, points array<struct<x:double,y:double>>")
    got = joins.box_pairs(df, df.selectExpr("a as b", "k", "points as other"), ["k"], "points", "other", 0.2, 0.5).select("a", "b").collect()
    box = {i: (np.array(p).min(0), np.array(p).max(0)) for i, _, p in lines}
    exp = {(i, j) for i in box for j in box if (box[i][0] - 0.2 <= box[j][1]).all() and (box[j][0] <= box[i][1] + 0.2).all()}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == exp


def test_assignment_keeps_capacity_and_order(spark):
    cand = [("1", "x", 0.9, 1), ("2", "x", 0.95, 1), ("2", "y", 0.5, 2), ("3", "y", 0.4, 2), ("4", "y", 0.6, 2), ("5", "y", 0.7, 2), ("6", "z", 0.1, 1)]
    df = spark.createDataFrame(cand, "a_id string, b_id string, score double, circuits int")
    parts = matching.candidate_parts(df)
    assert {r["a_id"]: r["part"] for r in parts.collect()} == {**{str(i): "1" for i in range(1, 6)}, "6": "6"}
    got = {(r["a_id"], r["b_id"]) for r in matching.assign(df, parts).collect()}
    assert got == {("1", "x"), ("2", "y"), ("3", "y"), ("6", "z")}


def test_assignment_reaches_the_last_candidate(spark):
    cand = [(a, f"b{i:02}", 1.0 - i / 100, 1) for a in [f"a{i:02}" for i in range(12)] for i in range(12)]
    df = spark.createDataFrame(cand, "a_id string, b_id string, score double, circuits int")
    got = {r["a_id"]: r["b_id"] for r in matching.assign(df, matching.candidate_parts(df)).collect()}
    assert got == {f"a{i:02}": f"b{i:02}" for i in range(12)}


def test_corridor_capacity(spark):
    ids = [f"relation/{n}-380-{c}" for n in (1641463, 1641474) for c in "abce"]
    refs, models = spark.createDataFrame([("244",), ("245",)], "id string"), spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r["a_id"]: (r["matched"], r["forced_unmatched"], len(r["b_ids"])) for r in matching.corridors(spark, refs, models).collect()}
    assert got == {"244": (True, False, 4), "245": (False, True, 0)}


def test_shortest_paths_either_way(spark):
    spark.sparkContext.setCheckpointDir("/tmp/test-checkpoints")
    edges = spark.createDataFrame([("a", "b", "1", 1.0), ("b", "c", "2", 1.0), ("a", "c", "3", 5.0), ("d", "e", "4", 1.0)], "u string, v string, id string, weight double")
    want = spark.createDataFrame([("a", "c"), ("a", "e"), ("b", "a")], "source string, target string")
    for most in (graph.BROADCAST_EDGES, 0):
        got = {(r["source"], r["target"]): (r["distance"], list(r["path"])) for r in graph.shortest_paths(edges, want, most).collect()}
        assert got == {("a", "c"): (2.0, ["a", "b", "c"]), ("b", "a"): (1.0, ["b", "a"])}


def test_chains_grow_to_the_ratio(spark):
    line = lambda *xs: [(float(x), 0.0) for x in xs]
    seeds = spark.createDataFrame([("A", line(0, 10), 10.0, ["p"])], "a_id string, points array<struct<x:double,y:double>>, length double, chain array<string>")
    parts = [("A", "p", line(0, 3), 3.0, "0", "3"), ("A", "q", line(3, 6), 3.0, "3", "6"), ("A", "far", [(3.0, 0.0), (3.0, 9.0)], 9.0, "3", "x"), ("A", "r", line(6, 9), 3.0, "6", "9"), ("A", "s", line(9, 10), 1.0, "9", "10")]
    df = spark.createDataFrame(parts, "a_id string, b_id string, points array<struct<x:double,y:double>>, length double, u string, v string")
    got = graph.grow_chains(seeds, df, 0.1).first()
    assert got["chain"] == ["p", "q", "r"] and got["added"] == 2 and math.isclose(got["ratio"], 0.9)
    log = graph.grow_chains(seeds, df, 0.1, explain=True).collect()
    assert {r["decision"] for r in log if r["b_id"] == "far"} == {"too far"}


def test_files_to_links(spark, tmp_path):
    refs = tmp_path / "refs.csv"
    refs.write_text("id;name;v_nom;length;r;geometry;bus0;bus1;EIC_Code\n1;one;380;10;1;'LINESTRING (7 50, 7.1 50, 7.2 50)';a;b;E1\n2;two;220;8;2;'LINESTRING (9 50, 9.1 50)';c;d;E2\n3;two;220;8;2;'LINESTRING (9 50, 9.1 50)';c;d;E3\n")
    models = tmp_path / "models.csv"
    models.write_text("line_id;v_nom;length;circuits;r;geometry;bus0;bus1\nway/1-380;400;10200;1;3;'LINESTRING (7 50.001, 7.2 50.001)';a;b\nway/2-220;220;8100;1;4;'LINESTRING (9 50.001, 9.1 50.001)';c;d\nway/3-220;220;8100;1;4;'LINESTRING (20 50, 20.1 50)';c;d\n")
    a, b = readers.read_lines(spark, str(refs)), readers.read_lines(spark, str(models), metres=True)
    manual = spark.createDataFrame([("3", ["way/3-220"]), ("1", ["missing"]), ("9", ["way/1-380"])], "a_id string, b_ids array<string>")
    got = {r["a_id"]: (r["matched"], r["b_ids"]) for r in pipeline.link(a, b, manual).links.collect()}
    assert got == {"1": (True, ["way/1-380"]), "2": (True, ["way/2-220"]), "3": (True, ["way/3-220"])}
    out = tmp_path / "out"
    cli.run(spark, cli.parser().parse_args(["match", str(refs), str(models), "-o", str(out), "--no-manual"]))
    links = {r["a_id"]: r["b_ids"] for r in readers.read_links(str(out / "links"), spark).collect()}
    assert links == {"1": ["way/1-380"], "2": ["way/2-220"], "3": ["way/2-220"]}
    assert sorted(os.listdir(out)) == ["features", "length_by_voltage", "links", "models", "parameters", "unmatched"]
    assert "<td>one</td>" in writers.html_table(a.select("id", "name"), "lines")


def test_streamed_imports(spark, tmp_path):
    from lineweave.streaming.links import import_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for i, body in enumerate(["id,v_nom,length\n1,380,5000\n2,220,100\n", "id,v_nom,length\n2,220,100\n3,110,7\n"]):
        (folder / f"{i}.csv").write_text(body)
        import_stream(spark, str(folder), "id string, v_nom string, length string", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["1", "2", "3"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    exp = duck.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(exp.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, exp))
    pd.testing.assert_frame_equal(a.where(a.notna(), None), b.where(b.notna(), None), check_dtype=False, check_exact=True)
