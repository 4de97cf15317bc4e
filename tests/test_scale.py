"""Rows that joins make on crowded tables, and results at such places against plain loops."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from lineweave import queries
from lineweave.functions import kernels
from lineweave.operators import joins, matching, passes

SF = "/root/testdata/sf0.001"


def made(df):
    """The rows of df and the most rows that one of its joins made."""
    rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name == "ReusedExchange":
            todo.append(node.child())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_nearest_in_a_crowd(spark):
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.normal(0, 0.05, (1500, 2)), rng.uniform(-3, 3, (300, 2)), np.full((200, 2), 0.25), rng.normal(2, 0.001, (1000, 2))]).round(4)
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "a long, x double, y double")
    right = left.selectExpr("concat('n', a) as b", "x as u", "y as v").where("a % 3 > 0 or a < 1000")
    rows, most = made(joins.nearest_k(left, right, "a", "b", ("x", "y"), ("u", "v"), 0.5, 4))
    ids = np.array([int(r["b"][1:]) for r in right.collect()])
    ids = ids[np.argsort([f"n{i}" for i in ids])]
    expected = set()
    for i, p in enumerate(at):
        dx, dy = p[0] - at[ids, 0], p[1] - at[ids, 1]
        d = np.sqrt(dx * dx + dy * dy)
        expected |= {(i, f"n{ids[j]}", n + 1) for n, j in enumerate(np.argsort(d, kind="stable")[:4]) if d[j] < 0.5}
    assert {(r["a"], r["b"], r["rank"]) for r in rows} == expected and len(rows) == len(expected)
    assert most < 100 * len(at)


def test_raster_by_rows_of_the_grid():
    rng = np.random.default_rng(3)
    for n in range(20):
        line = rng.normal(0, 0.1, (1 + n % 4, 2)).round(1 if n % 3 == 0 else 6)
        expected = set()
        for a, b in zip(line[:-1], line[1:], strict=True) if len(line) > 1 else [(line[0], line[0])]:
            low, high = np.floor((np.minimum(a, b) - 0.02) / 0.0025).astype(int), np.ceil((np.maximum(a, b) + 0.02) / 0.0025).astype(int)
            gx, gy = np.meshgrid(np.arange(low[0], high[0] + 1), np.arange(low[1], high[1] + 1))
            p = np.column_stack([gx.ravel(), gy.ravel()])
            near = kernels.distance_to((p + 0.5) * 0.0025, np.array([a, b])) <= 0.02
            expected |= {(int(x) << 31) + int(y) for x, y in p[near]}
            # No more than the buffer's own cells and two of either end of a row are tried.
            assert len(kernels._cells_near(a, b, 0.02, 0.0025)) <= near.sum() + 6 * (high[1] - low[1] + 1)
        assert kernels.buffer_cells(line, 0.02, 0.0025).tolist() == sorted(expected)


def pairs_alike(spark, monkeypatch, query, measures, count):
    """Joins make no pairs, and small blocks give what plain loops give."""
    p = queries.polylines(spark, SF)
    assert made(query(spark, SF))[1] <= 5 * p.count()  # a line is in up to four cells
    monkeypatch.setattr(joins, "LINES_MOST", 15)
    lines = {r["vec_id"]: (r["label"], np.array([[q["x"], q["y"]] for q in r["points"]])) for r in p.collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == len({(r["vec_id"], r["other"]) for r in rows}) == count(lines)
    for r in rows[::97]:
        (label, a), (other, b) = lines[r["vec_id"]], lines[r["other"]]
        assert label == other and r["vec_id"] < r["other"] and np.allclose([r[m] for m in measures], [f(a, b) for f in measures.values()], atol=1e-4 if "iou" in measures else 1e-6)


def all_pairs(lines):
    return sum(lines[a][0] == lines[b][0] for a in lines for b in lines if a < b)


def test_hausdorff_pairs_in_blocks(spark, monkeypatch):
    pairs_alike(spark, monkeypatch, queries.hausdorff_pairs, {"hausdorff": kernels.hausdorff}, all_pairs)


def test_equal_gaps_go_to_the_smaller_id(spark):
    sig = "struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,length:double>"
    ends = ((0.0, 0.0), (1.0, 0.0))
    assert 1.103 - 1.1 != 1.1 - 1.097
    a = spark.createDataFrame([(1, 0, (*ends, 1.1))], f"a_id long, kind int, sig {sig}")
    for near, far in ((1.103, 1.097), (1.097, 1.103)):
        b = spark.createDataFrame([("m1", 0, (*ends, near)), ("m2", 0, (*ends, far))], f"b_id string, kind int, b_sig {sig}")
        assert [r["b_id"] for r in matching.by_signature(a, b, 0.01).collect()] == ["m1"]


def test_contained_suffix_of_many_numbers(spark):
    linked = spark.createDataFrame([("g", f"relation/{i}-1", 380.0) for i in range(100, 1100)] + [("h", "relation/7-2", 380.0), ("h", "relation/71-2", 400.0)], "parallel_group string, id string, kv double")
    models = spark.createDataFrame([(f"relation/{i}-1", 400.0) for i in range(100, 400)] + [("relation/71-2", 380.0), ("relation/8-2", 380.0), ("relation/8-2", 220.0), ("relation/17-2", 380.0)], "b_id string, kv double")
    rows, most = made(matching.by_contained_suffix(linked, models))
    expected = {("g", f"relation/{i}-1", str(i), "-1") for i in range(100, 400)} | {("h", "relation/8-2", "8", "-2"), ("h", "relation/17-2", "17", "-2")}
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    assert most < 1000


def test_passes_make_no_pairs(spark):
    refs, models = queries._sides(spark, SF)
    rows, most = made(passes._scored(refs.withColumn("reach", F.lit(0.005)), models, "strict", lambda covered, **_: (covered, covered > 0.9), 0.5))
    assert len(rows) > 100 and most <= 4 * refs.count()


def test_bounds_of_shares(monkeypatch):
    monkeypatch.setattr(kernels, "PAIRS_FEW", 0)
    rng = np.random.default_rng(5)
    for n in range(12):
        scale, some = 10.0 ** (n % 5 - 2), []
        for count in (60, 70):
            size = rng.integers(1, 9, count)
            at = rng.normal(0, scale, (2, size.sum())).round(n % 4 + 2)
            if n % 3 == 0:
                at[:, rng.integers(0, size.sum(), 3)] = np.nan
            some.append(kernels.Lines(*at, size))
        a, b, reach = *some, rng.uniform(0.001, 0.3, 60) * scale
        if n % 4 == 0:
            reach[7] = np.inf
        bounds = np.full((70, 60), -1.0)
        for rows, bound in kernels.share_bounds(b, a, reach):
            bounds[rows] = bound
        j, i = np.indices(bounds.shape).reshape(2, -1)
        with np.errstate(all="ignore"):
            shares = kernels.of_pairs(kernels.covered_pairs, b, a, j, i, reach[i]).reshape(bounds.shape)
        assert (bounds >= np.nan_to_num(shares)).all() and bounds.mean() < 0.6


def test_bounds_of_few_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    for n in range(12):
        scale, some, grid = 10.0 ** (n % 5 - 2), [], (16, 64, 96)[n % 3]
        for count in (60, 300):
            size = rng.integers(1, 9, count)
            at = rng.normal(0, scale, (2, size.sum())).round(n % 4 + 2)
            if n % 3 == 0:
                at[:, rng.integers(0, size.sum(), 3)] = (np.nan, np.inf, 0.0)
            some.append(kernels.Lines(*at, size))
        a, b, reach = *some, rng.uniform(0.001, 0.3, 60) * scale
        if n % 4 == 0:
            reach[7] = np.inf
        bounds = kernels.ShareBounds(b, a, reach, grid, 10_000)
        rows = rng.permutation(300)[:290]
        j, i = (c.ravel() for c in np.meshgrid(rows, np.arange(60), indexing="ij"))
        with np.errstate(all="ignore"):
            shares = np.nan_to_num(kernels.of_pairs(kernels.covered_pairs, b, a, j, i, reach[i]))
        for least in (0.0, 0.3, 0.9, 1.0):
            missable = bounds.missable(least)
            near = bounds.touched(rows, missable)
            p, q, bound = bounds.reached(*near, missable[near[0]])
            found = dict(zip(zip(p.tolist(), q.tolist(), strict=True), bound, strict=True))
            assert len(found) == len(p) and (least < 0.9 or len(p) < 0.6 * len(j)) and (least < 1 or not found)
            assert all(found[x, y] >= share for x, y, share in zip(j.tolist(), i.tolist(), shares, strict=True) if share > least + 1e-9)


def test_near_places():
    rng = np.random.default_rng(7)
    for scale in (1.0, 30.0, 1e12):
        p, q = (np.concatenate([rng.normal(0, scale, (2, 200)).round(1), [[np.nan, np.inf, 5.0], [0.0, 0.0, 5.0]]], axis=1) for _ in "pq")
        with np.errstate(invalid="ignore"):
            near = (np.abs(p[:, :, None] - q[:, None]) < 0.7).all(axis=0)
        assert sorted(zip(*kernels.Places(q, 0.7).near(p), strict=True)) == list(zip(*np.nonzero(near), strict=True))


def searched(spark, monkeypatch, refs, models, rule, score, best=None):
    """The pairs that a pass takes of lines of 220 kV as one block, how many pairs there are and how many of them are measured."""
    calls, measured_pairs = [], []
    monkeypatch.setattr(joins, "line_blocks", lambda left, right, keys, p, q, wanted, measured, *_: calls.append((left.toArrow(), right.toArrow(), wanted, measured)))
    passes._scored(refs.where("kv = 220"), models.where("kv = 220"), rule, score, 0.5, best)
    covered = kernels.covered_pairs
    monkeypatch.setattr(kernels, "covered_pairs", lambda line, other, d: measured_pairs.append(len(d)) or covered(line, other, d))
    ((some, others, wanted, measured),) = calls
    lines, more = joins._lines(some["a_points"]), joins._lines(others["b_points"])
    out = measured(some, others, lines, more, *(np.nonzero(wanted(some, others)) if wanted else ()))
    monkeypatch.undo()
    return sorted(zip(*(out[c].to_pylist() for c in ("a_id", "b_id", "score")), strict=True)), len(lines) * len(more), sum(measured_pairs)


def test_visual_pass_measures_few_pairs(spark, monkeypatch):
    refs, models = queries._sides(spark, SF)
    scores = []
    monkeypatch.setattr(passes, "_scored", lambda refs, models, rule, score, cell: scores.append((refs, rule, score)))
    monkeypatch.setattr(passes, "_once", lambda good: good)
    passes.visual(refs, models)
    monkeypatch.undo()
    ((refs, rule, score),) = scores
    found, pairs, measured = searched(spark, monkeypatch, refs, models, rule, score)
    assert len(found) > 100 and pairs > 40_000 and measured < pairs / 25


def test_visual_pass_scores_few_pairs(spark, monkeypatch):
    refs, models = queries._sides(spark, SF)
    scores, sizes = [], []
    monkeypatch.setattr(passes, "_scored", lambda refs, models, rule, score, cell: scores.append((refs, rule, score)))
    monkeypatch.setattr(passes, "_once", lambda good: good)
    passes.visual(refs, models)
    monkeypatch.undo()
    ((refs, rule, score),) = scores
    plain = lambda **parts: score(**parts)

    def counted(**parts):
        sizes.append(parts["covered"].size * ("b_km" in parts))
        return score(**parts)

    counted.tips = getattr(score, "tips", None)
    every, pairs, _ = searched(spark, monkeypatch, refs, models, rule, plain)
    found, _, _ = searched(spark, monkeypatch, refs, models, rule, counted)
    assert found == every and sum(sizes) < pairs / 5


def test_simple_pass_measures_few_pairs(spark, monkeypatch):
    def score(covered, cosine, a_km, b_km, vertices, **_):
        out = passes.simple_score(vertices, covered, passes.length_ratio(a_km, b_km), cosine, b_km < 0.7 * a_km)
        return out, out > 0.4

    refs, models = queries._sides(spark, SF)
    refs = refs.where(F.size("points") <= 5).withColumns({"reach": F.lit(0.03), "after_score": F.lit(float("inf")), "after_id": F.lit(""), "floor": F.lit(float("-inf"))})
    every, pairs, _ = searched(spark, monkeypatch, refs, models, "lenient", score, 4)
    floor = {}
    for a, _, found in every:
        floor.setdefault(a, []).append(found)
    last = spark.createDataFrame([(a, min(f)) for a, f in floor.items() if len(f) == 4], "a_id string, floor double")
    some, _, measured = searched(spark, monkeypatch, refs.drop("floor").join(last, "a_id", "left").fillna(float("-inf"), ["floor"]), models, "lenient", score, 4)
    assert len(every) > 400 and some == every and measured < pairs / 5


def test_lists_that_go_on(spark):
    # All lines prefer the same candidates: with two at a time most lists are used up and asked for again.
    pairs = spark.createDataFrame([(f"a{i:02}", f"b{j:02}", float(10 - j // 2)) for i in range(12) for j in range(11)], "a_id string, b_id string, score double")
    refs = spark.createDataFrame([(f"a{i:02}",) for i in range(12)], "a_id string")
    found = lambda some, n: pairs.join(some, "a_id").where("score < after_score or (score = after_score and b_id > after_id)").select("a_id", "b_id", "score")
    links = passes._once_of_many(refs, found, 2)
    assert sorted((r["a_id"], r["b_id"]) for r in links.collect()) == [(f"a{i:02}", f"b{i:02}") for i in range(11)]


def test_lines_in_buffer_in_blocks(spark, monkeypatch):
    shares = lambda lines: sum(kernels.covered_share(lines[a][1], lines[b][1], 0.05) > 0 for a in lines for b in lines if a < b and lines[a][0] == lines[b][0])
    pairs_alike(spark, monkeypatch, queries.line_in_buffer, {"covered": lambda a, b: kernels.covered_share(a, b, 0.05)}, shares)


def test_rasters_of_many_lines():
    rng = np.random.default_rng(8)
    for n in range(24):
        size = rng.integers(1, 6, 9)
        at = rng.normal(0, (0.1, 0.02, 3.0)[n % 3], (2, size.sum()))
        at = at.round(n % 3 + 1) if n % 2 else (at / 0.00125).round() * 0.00125 if n % 5 == 0 else at  # also on middles and sides of cells
        if n % 4 == 0:
            at[:, rng.integers(0, size.sum(), 2)] = np.nan
        if n % 7 == 0:
            at[1] = at[1, 0]
        lines, rows = kernels.Lines(*at, size), rng.permutation(9)[:8]
        cells = [kernels.buffer_cells(lines[r], 0.02, 0.0025) for r in rows]
        tiles = kernels.Tiles(lines, rows, 0.02, 0.0025)
        assert tiles.count.tolist() == [len(c) for c in cells]
        i, j = np.nonzero(rng.random((8, 8)) < 0.7)
        assert tiles.shared(tiles, i, j).tolist() == [len(np.intersect1d(cells[p], cells[q])) for p, q in zip(i, j, strict=True)]
        bits = np.unpackbits(tiles.word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        x = ((tiles.key + (1 << 30)) & ((1 << 31) - 1)) - (1 << 30)
        y = (tiles.key - x) >> 31
        drawn = ((x[k] * 8 + bit % 8) << 31) + y[k] * 8 + bit // 8
        assert all(sorted(drawn[tiles.own[k] == m].tolist()) == c.tolist() for m, c in enumerate(cells))


def test_rasters_in_rounds(monkeypatch):
    rng = np.random.default_rng(9)
    lines = kernels.Lines(*rng.normal(0, 0.1, (2, 240)), np.full(60, 4))
    i, j = np.nonzero(rng.random((60, 60)) < np.linspace(0, 1, 60)[:, None])
    whole = kernels.Tiles(lines, np.arange(60), 0.02, 0.0025)
    expected = whole.shared(whole, i, j)
    assert (expected > 0).mean() > 0.5
    for name, most in (("TILES_MOST", 200), ("DRAWN_AT_ONCE", 7), ("TILES_AT_ONCE", 50), ("LINES_AT_ONCE", 8)):
        monkeypatch.setattr(kernels, name, most)
        some = kernels.Tiles(lines, np.arange(60), 0.02, 0.0025)
        assert some.count.tolist() == whole.count.tolist() and some.shared(some, i, j).tolist() == expected.tolist()


def near_boxes(lines):
    apart = lambda p, q: (p.max(axis=0) + 0.02 < q.min(axis=0)).any() or (q.max(axis=0) < p.min(axis=0) - 0.02).any()
    return sum(not apart(lines[a][1], lines[b][1]) for a in lines for b in lines if a < b and lines[a][0] == lines[b][0])


def test_iou_pairs_in_blocks(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(kernels, "buffer_cells", lambda *a, f=kernels.buffer_cells: calls.append(1) or f(*a))
    kernels.Tiles(kernels.Lines(*np.random.default_rng(0).normal(0, 0.1, (2, 80)), np.full(10, 8)), np.arange(10), 0.02, 0.0025)
    assert not calls  # lines are drawn together, not one after the other
    monkeypatch.undo()
    pairs_alike(spark, monkeypatch, queries.iou_pairs, {"iou": lambda a, b: kernels.buffer_areas(a, b, 0.02)[0], "area_share": lambda a, b: kernels.buffer_areas(a, b, 0.02)[1]}, near_boxes)


def test_shares_are_rounded_half_up(spark):
    both, of = np.arange(1, 2000), np.full(1999, 2000)
    expected = [r["v"] for r in spark.createDataFrame([(float(v),) for v in both / of], "v double").select(F.round("v", 3).alias("v")).collect()]
    assert matching.share(both, of, 3).tolist() == expected and matching.share(both, of).tolist() == (both / of).tolist()


def test_counted_bounds():
    rng = np.random.default_rng(10)
    for n in range(12):
        scale, some = 10.0 ** (n % 5 - 2), []
        for count in (130, 90):
            size = rng.integers(1, 9, count)
            at = rng.normal(0, scale, (2, size.sum())).round(n % 4 + 2)
            if n % 3 == 0:
                at[:, rng.integers(0, size.sum(), 3)] = (np.nan, np.inf, 0.0)
            some.append(kernels.Lines(*at, size))
        a, b, reach = *some, rng.uniform(0.001, 0.3, 130) * scale
        if n % 4 == 0:
            reach[7] = np.inf
        j, i = np.indices((90, 130)).reshape(2, -1)
        with np.errstate(all="ignore"):
            shares = np.nan_to_num(kernels.of_pairs(kernels.covered_pairs, b, a, j, i, reach[i])).reshape(90, 130)
        bounds = kernels.ShareCounts(b, a, reach)
        for least in (0.0, 0.3, 0.9, 1.0):
            p, q, bound = (np.concatenate(c) for c in zip(*bounds.over(least), strict=True))
            found = np.zeros((90, 130))
            found[p, q] = bound
            assert len(p) == np.count_nonzero(found) or least == 0
            assert (found >= shares)[shares > least + 1e-9].all() and (least < 1 or not len(p)) and (least < 0.3 or n % 4 == 0 or len(p) < (shares > least).sum() + 0.4 * shares.size)


@pytest.mark.parametrize("whole", [True, False])
def test_parallel_pass_measures_few_pairs(spark, monkeypatch, whole):
    refs, models = queries._sides(spark, SF, whole)
    scores = []
    monkeypatch.setattr(passes, "_scored", lambda refs, models, rule, score, cell: scores.append((refs, rule, score)) or refs.select("a_id", F.col("a_id").alias("b_id"), F.lit(1.0).alias("score")))
    passes.parallel(refs, models, refs.select("parallel_group", F.col("a_id").alias("b_id")))
    monkeypatch.undo()
    ((refs, rule, score),) = scores
    every, pairs, all_measured = searched(spark, monkeypatch, refs, models, rule, lambda **parts: score(**parts))
    found, _, measured = searched(spark, monkeypatch, refs, models, rule, score)
    assert found == every and len(found) > 100 and pairs > 40_000 and measured < pairs / 50 and measured < all_measured / 5
