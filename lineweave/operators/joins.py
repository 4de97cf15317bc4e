"""Joins that a plain equality can't say: nearest within a radius, range by cells, ordered dedupes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import kernels


def _cells(df: DataFrame, x: str, y: str, size_x: float, size_y: float, spread: bool) -> DataFrame:
    cx, cy = F.floor(F.col(x) / size_x), F.floor(F.col(y) / size_y)
    if not spread:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    near = [F.struct((cx + i).alias("_cx"), (cy + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return df.withColumn("_cell", F.explode(F.array(*near))).select("*", "_cell._cx", "_cell._cy").drop("_cell")


def cell_join(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], size: tuple[float, float]) -> DataFrame:
    """Pairs of points in the same or neighbouring cells: an equality join in place of all pairs.

    Column names must differ between the sides.  The right side is the one that is
    spread over nine cells; a filter on the true distance follows.
    """
    a = _cells(left, *left_xy, *size, spread=False)
    b = _cells(right, *right_xy, *size, spread=True).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
    return a.join(b, (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))).drop("_cx", "_cy", "_rx", "_ry")


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], km: float, latitude: float = 60.0) -> DataFrame:
    """The nearest right point of each left one, great-circle, strictly within km; ties to the smaller id.

    Cells are km high and, at the given latitude, km wide: valid up to that latitude.
    """
    high = km / 111.0 * 1.01
    wide = high / math.cos(math.radians(latitude))
    pairs = cell_join(left, right, left_xy, right_xy, (wide, high))
    d = G.haversine_km(F.col(left_xy[0]), F.col(left_xy[1]), F.col(right_xy[0]), F.col(right_xy[1]))
    pairs = pairs.withColumn("distance_km", d).where(F.col("distance_km") < km)
    first = Window.partitionBy(left_id).orderBy("distance_km", right_id)
    return pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


#: Cells are halved so often at most, and as long as they hold so many points.
HALVINGS, CELL_LEAST = 8, 256
#: Points of either side that one task compares at most, about.
LEFT_MOST, RIGHT_MOST = 4096, 65_536


def nearest_k(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float, k: int) -> DataFrame:
    """The k nearest right points, planar, strictly within the radius, with `distance` and `rank`; ties to the smaller id.

    Cells are as wide as the radius and are halved where right points crowd.  A left point takes the smallest cell around it that
    holds enough of them: its k nearest lie within that cell's diagonal, so within two cells each way.  Points of
    one cell are searched together, in blocks, and no pairs are made.  Of right points of one place the k first by id are enough.
    """
    fewest, cell = max(k, CELL_LEAST), ["_level", "_cx", "_cy"]
    place = Window.partitionBy(*right_xy).orderBy(right_id)
    places = right.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).drop("_n")
    levels = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("_level")

    def on_grid(df: DataFrame, xy: tuple[str, str]) -> DataFrame:
        wide = F.lit(radius) / F.pow(F.lit(2.0), F.col("_level"))
        return df.withColumns({c: F.floor(F.col(v) / wide) for c, v in zip(cell[1:], xy, strict=True)})

    points = on_grid(places.select("*", levels), right_xy)
    counts = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("_count"))
    crowded = counts.where((F.col("_level") > 0) & (F.col("_count") >= fewest)).select(*cell)
    own = on_grid(left.select(*left_xy).distinct().select("*", levels), left_xy).join(crowded, cell, "left_semi").groupBy(*left_xy).agg(F.max("_level").alias("_level"))
    asking = on_grid(left.join(own, list(left_xy), "left").withColumn("_level", F.coalesce("_level", F.lit(0))), left_xy)

    homes = asking.groupBy(*cell).agg(F.count(F.lit(1)).alias("_left"))
    reach = F.when(F.col("_level") == 0, 1).otherwise(2)
    around = homes.select("_level", F.col("_cx").alias("_hx"), F.col("_cy").alias("_hy"), "_left", F.explode(F.sequence(-reach, reach)).alias("_dx"), reach.alias("_reach"))
    around = around.select("*", F.explode(F.sequence(-F.col("_reach"), F.col("_reach"))).alias("_dy"))
    around = around.select("_level", "_hx", "_hy", "_left", (F.col("_hx") + F.col("_dx")).alias("_cx"), (F.col("_hy") + F.col("_dy")).alias("_cy")).join(counts, cell)
    dealt = around.groupBy("_level", "_hx", "_hy").agg(F.ceil(F.first("_left") / LEFT_MOST).alias("_blocks"), F.ceil(F.sum("_count") / RIGHT_MOST).alias("_parts"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = ["_level", "_hx", "_hy"]
    asking = asking.withColumnsRenamed({"_cx": "_hx", "_cy": "_hy"}).join(dealt, home).withColumn("_block", deal(left_id, "_blocks")).withColumn("_part", every("_parts"))
    near = points.join(around.select(*cell, *home[1:]), cell).join(dealt, home).withColumn("_part", deal(right_id, "_parts")).withColumn("_block", every("_blocks"))
    groups = [*home, "_block", "_part"]
    own_names, other_names = left.columns, right.columns
    near = near.select(*[F.col(c).alias(c) for c in (*groups, *other_names)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (*left.schema, *right.schema)), "distance double"])

    def search(some: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by(right_id)
        px, py = (some[c].to_numpy() for c in left_xy)
        qx, qy = (others[c].to_numpy() for c in right_xy)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        rows = max(1, (1 << 21) // max(1, len(qx)))
        for low in range(0, len(px) if len(qx) else 0, rows):
            dx, dy = px[low : low + rows, None] - qx, py[low : low + rows, None] - qy
            d = np.sqrt(dx * dx + dy * dy)
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(qx) > k else np.inf
            i, j = np.nonzero((d <= last) & (d < radius))  # with ties for the last place
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[keep] + low, j[keep], d[i[keep], j[keep]]))
        i, j, far = (np.concatenate(c) for c in zip(*found, strict=True))
        columns = [*(some[c].take(i) for c in own_names), *(others[c].take(j) for c in other_names), pa.array(far)]
        return pa.Table.from_arrays(columns, names=[*own_names, *other_names, "distance"])

    nearest = asking.select(*groups, *own_names).groupBy(*groups).cogroup(near.groupBy(*groups)).applyInArrow(search, schema)
    return nearest.withColumn("rank", F.row_number().over(Window.partitionBy(left_id).orderBy("distance", right_id))).where(F.col("rank") <= k)


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], points: str, other: str, reach: float | Column, cell: float) -> DataFrame:
    """Pairs of lines of equal keys whose boxes come within reach (a number or a column of the left side): cells of the boxes are joined, each pair stays once (in the cell of its common corner)."""

    def spread(df: DataFrame, c: str, grow: float | Column, tag: str) -> DataFrame:
        b = G.bounds(F.col(c))
        df = df.withColumn(f"_{tag}", F.struct((b["x0"] - grow).alias("x0"), (b["y0"] - grow).alias("y0"), (b["x1"] + grow).alias("x1"), (b["y1"] + grow).alias("y1")))
        xs = F.sequence(F.floor(F.col(f"_{tag}.x0") / cell), F.floor(F.col(f"_{tag}.x1") / cell))
        ys = F.sequence(F.floor(F.col(f"_{tag}.y0") / cell), F.floor(F.col(f"_{tag}.y1") / cell))
        return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))

    pairs = spread(left, points, reach, "a").join(spread(right, other, 0.0, "b"), [*keys, "_cx", "_cy"])
    corner_x, corner_y = F.floor(F.greatest("_a.x0", "_b.x0") / cell), F.floor(F.greatest("_a.y0", "_b.y0") / cell)
    apart = (F.col("_a.x1") < F.col("_b.x0")) | (F.col("_b.x1") < F.col("_a.x0")) | (F.col("_a.y1") < F.col("_b.y0")) | (F.col("_b.y1") < F.col("_a.y0"))
    return pairs.where(~apart & (F.col("_cx") == corner_x) & (F.col("_cy") == corner_y)).drop("_a", "_b", "_cx", "_cy")


#: Lines of either side that one task pairs, about.
LINES_MOST = 1024


def _lines(points: pa.ChunkedArray) -> kernels.Lines:
    points = points.combine_chunks()
    flat = pc.list_flatten(points)
    x, y = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    return kernels.Lines(x, y, pc.list_value_length(points).to_numpy(zero_copy_only=False).astype(np.int64))


def line_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], points: str, other: str, wanted, measured, schema: str, reach: str | None = None, cell: float = 0.5, most: int | tuple[int, int] | None = None, home: bool = False, corner: float = 0.0) -> DataFrame:
    """What `measured` gives for pairs of lines of equal keys, without a row for each pair before that.

    Either side is dealt into blocks, of about `most` lines (one number, or one a side), and each block meets each of the other side in one task, so rows are copied once
    a block, not once a pair.  With the column `reach` of the left side only lines whose boxes come within it meet, block by block of each
    cell; each pair stays once (in the cell of its common corner: in either direction one of the two has its own corner there, and only kinds of lines
    of which that holds meet).  `home`: only pairs that have their corners in one cell.  `corner`: where, in x and y, cells begin.  Column names but keys must differ between the sides.
    wanted(left, right) gives the pairs as a matrix of booleans, or None for all; measured(left, right, lines, other_lines, i, j) a table of `schema`.
    Without `wanted`, measured(left, right, lines, other_lines) chooses among all pairs itself, also by their boxes.
    """
    most = most if isinstance(most, tuple) else (most or LINES_MOST,) * 2

    def spread(df: DataFrame, c: str, grow: Column) -> DataFrame:
        df = df.where(F.size(c) > 0)
        if reach is None:
            return df.select("*", F.lit(0).cast("long").alias("_cx"), F.lit(0).cast("long").alias("_cy"), F.lit(3).alias("_own"))
        b = G.bounds(F.col(c))
        xs, ys = (F.sequence(F.floor((b[f"{v}0"] - grow - corner) / cell), F.floor((b[f"{v}{0 if home else 1}"] + (-grow if home else grow) - corner) / cell)) for v in "xy")
        df = df.select("*", xs.alias("_xs"), ys.alias("_ys")).select("*", F.explode("_xs").alias("_cx")).select("*", F.explode("_ys").alias("_cy"))
        own = F.when(F.col("_cx") == F.col("_xs")[0], 2).otherwise(0) + F.when(F.col("_cy") == F.col("_ys")[0], 1).otherwise(0)
        return df.withColumn("_own", own).drop("_xs", "_ys")

    def every(n: str) -> Column:
        """The blocks of the other side that a row meets: (kind, block)."""
        of = lambda k: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n)[k] - 1), lambda i: F.struct(F.lit(k).alias("kind"), i.alias("block")))
        none = F.array().cast("array<struct<kind:int,block:bigint>>")
        return F.explode(F.concat(*[F.when((F.col("_own").bitwiseOR(F.lit(k)) == 3) & (F.col(n)[k] > 0), of(k)).otherwise(none) for k in range(4)]))

    group = [*keys, "_cx", "_cy"]
    a, b = spread(left, points, F.col(reach) if reach else F.lit(0.0)), spread(right, other, F.lit(0.0))
    blocks = lambda df, name, most: df.groupBy(*group).agg(F.array(*[F.ceil(F.sum((F.col("_own") == k).cast("long")) / most) for k in range(4)]).alias(name))
    dealt = blocks(a, "_m", most[0]).join(blocks(b, "_n", most[1]), group)
    block = lambda names, n: F.pmod(F.xxhash64(*names), F.col(n)[F.col("_own")])
    a = a.join(dealt, group).withColumn("_i", block(left.columns, "_m")).withColumn("_to", every("_n"))
    a = a.withColumns({"_a": F.col("_own"), "_b": F.col("_to.kind"), "_j": F.col("_to.block")})
    b = b.join(dealt, group).withColumn("_j", block(right.columns, "_n")).withColumn("_to", every("_m"))
    b = b.withColumns({"_b": F.col("_own"), "_a": F.col("_to.kind"), "_i": F.col("_to.block")})
    group = [*group, "_a", "_b", "_i", "_j"]
    b = b.select([F.col(c).alias(c) for c in dict.fromkeys([*group, *right.columns])])

    def run(some: pa.Table, others: pa.Table) -> pa.Table:
        lines, other_lines = _lines(some[points]), _lines(others[other])
        if wanted is None:
            return measured(some, others, lines, other_lines)
        pairs = wanted(some, others)
        if pairs is None:
            pairs = np.ones((len(lines), len(other_lines)), dtype=bool)
        if reach is not None:
            grow = some[reach].to_numpy()
            p, q = lines.box + np.stack([-grow, -grow, grow, grow]), other_lines.box
            for v in (0, 1):
                pairs &= ~((p[2 + v][:, None] < q[v]) | (q[2 + v] < p[v][:, None]))
        return measured(some, others, lines, other_lines, *np.nonzero(pairs))

    return a.select(*group, *(c for c in left.columns if c not in keys)).groupBy(*group).cogroup(b.groupBy(*group)).applyInArrow(run, schema)


def last_by(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def with_fallback_key(left: DataFrame, right: DataFrame, key: str, first: str, second: str, value: str) -> DataFrame:
    """value of the right row whose `first` equals the key, else of that whose `second` does."""
    a = right.select(F.col(first).alias("_first"), F.col(value).alias("_v1"))
    b = right.select(F.col(second).alias("_second"), F.col(value).alias("_v2"))
    out = left.join(a, F.col(key) == F.col("_first"), "left").join(b, F.col("_first").isNull() & (F.col(key) == F.col("_second")), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_first", "_second", "_v1", "_v2")


def rank_pairs(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str) -> DataFrame:
    """The i-th left row of a group with its i-th right row, by string id."""
    n = F.row_number()
    a = left.withColumn("rank", n.over(Window.partitionBy(group).orderBy(left_id)))
    b = right.withColumn("rank", n.over(Window.partitionBy(group).orderBy(right_id)))
    return a.join(b, [group, "rank"])


def containing(left: DataFrame, right: DataFrame, part: str, whole: str) -> DataFrame:
    """Pairs whose left text is part of the right one: an equality join with all pieces of the distinct right texts, which are short names.

    Column names must differ between the sides.
    """
    n = F.length(whole)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col(whole), i, k))))
    names = right.select(whole).where(n > 0).distinct().select(F.col(whole).alias("_whole"), F.explode(F.array_distinct(pieces)).alias("_piece"))
    return left.join(names, F.col(part) == F.col("_piece")).join(right, F.col("_whole") == F.col(whole)).drop("_whole", "_piece")
