"""Planar line geometry over arrays of (x, y) structs, as column functions.

A line is an array of points; a multi-part line an array of those.  Distances are in
degrees and are scaled by fixed factors where kilometres or metres are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres and kilometres of a degree, radii of the sphere.
METRES_PER_DEGREE, KM_PER_DEGREE, EARTH_KM, MERCATOR_M = 111_111.0, 111.0, 6371.0, 6_378_137.0
POINTS = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def parse_wkt(text: Column) -> Column:
    """The parts of a POINT, (MULTI)LINESTRING or POLYGON text, whatever stands before it; null if there is none."""
    body = F.regexp_extract(F.upper(F.regexp_replace(text, "['\"]", "")), r"(?:MULTILINESTRING|LINESTRING|POLYGON|POINT)\s*(\(.*\))", 1)
    rings = F.regexp_extract_all(body, F.lit(r"([^()]+)"), F.lit(1))
    rings = F.filter(rings, lambda r: r.rlike("[0-9]"))

    def pair(p: Column) -> Column:
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.when(body != "", F.transform(rings, lambda r: F.transform(F.split(r, ","), pair)))


def truncated_pairs(text: Column) -> Column:
    """Coordinates of a text that broke off."""
    found = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+\.?[0-9]*\s+-?[0-9]+\.?[0-9]*)"), F.lit(1))
    return F.transform(found, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def number_text(c: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", c)


def to_wkt(points: Column, digits: int = 6) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", number_text(p["x"], digits), number_text(p["y"], digits))), ", "), F.lit(")"))


def start(points: Column) -> Column:
    return points[0]


def end(points: Column) -> Column:
    return F.element_at(points, -1)


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def segments(points: Column) -> Column:
    """(a, b, length) of each step between neighbouring points."""
    steps = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.transform(steps, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), _distance(s["a"], s["b"]).alias("length")))


def length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda total, s: total + s["length"])


def centroid(points: Column) -> Column:
    """Mean of the steps' midpoints by length; of a point or a line without length, its first point."""
    zero = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(
        segments(points),
        zero,
        lambda t, s: F.struct(
            (t["l"] + s["length"]).alias("l"),
            (t["x"] + s["length"] * (s["a"]["x"] + s["b"]["x"]) / 2).alias("x"),
            (t["y"] + s["length"] * (s["a"]["y"] + s["b"]["y"]) / 2).alias("y"),
        ),
    )
    return F.when(sums["l"] > 0, point(sums["x"] / sums["l"], sums["y"] / sums["l"])).otherwise(start(points))


def length_m(points: Column) -> Column:
    return length(points) * METRES_PER_DEGREE * F.cos(F.radians(F.abs(centroid(points)["y"])))


def direction(points: Column) -> Column:
    """Unit vector from start to end; of a closed line, the zero vector."""
    dx, dy = end(points)["x"] - start(points)["x"], end(points)["y"] - start(points)["y"]
    norm = F.sqrt(dx * dx + dy * dy)
    return point(F.when(norm > 0, dx / norm).otherwise(dx), F.when(norm > 0, dy / norm).otherwise(dy))


def abs_cos(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a["x"] * b["x"] + a["y"] * b["y"]), F.lit(0.5))


def snap(p: Column, grid: float) -> Column:
    return point(F.rint(p["x"] / grid) * grid, F.rint(p["y"] / grid) * grid)


def node_id(p: Column) -> Column:
    return F.concat(F.lit("node_"), number_text(p["x"]), F.lit("_"), number_text(p["y"]))


def signature(points: Column, digits: int = 3) -> Column:
    """Rounded ends, in a fixed order, and length."""
    r = lambda c: F.round(c, digits) + 0.0
    a, b = point(r(start(points)["x"]), r(start(points)["y"])), point(r(end(points)["x"]), r(end(points)["y"]))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), r(length(points)).alias("length"))


def mercator(p: Column) -> Column:
    return point(F.radians(p["x"]) * MERCATOR_M, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)) * MERCATOR_M)


def inverse_mercator(p: Column) -> Column:
    return point(F.degrees(p["x"] / MERCATOR_M), F.degrees(2 * F.atan(F.exp(p["y"] / MERCATOR_M)) - math.pi / 2))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a ring of fixed points."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + F.when(hit, 1).otherwise(0)
    return crossings % 2 == 1


def _side(a: tuple[float, float], b: tuple[float, float], p: Column) -> Column:
    """On which side of the line from a to b a point lies: the sign tells."""
    return F.lit(b[0] - a[0]) * (p["y"] - F.lit(a[1])) - F.lit(b[1] - a[1]) * (p["x"] - F.lit(a[0]))


def _turn(a: Column, b: Column, x: float, y: float) -> Column:
    return (b["x"] - a["x"]) * (F.lit(y) - a["y"]) - (b["y"] - a["y"]) * (F.lit(x) - a["x"])


def _to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
    ex, ey = x - ax - t * dx, y - ay - t * dy
    return F.sqrt(ex * ex + ey * ey)


def meets(points: Column, ring: list[tuple[float, float]], reach: float = 0.0) -> Column:
    """Whether a line has a point in a ring of fixed points, crosses its edge or, with a reach, comes that near to it."""

    def cut_by(a: tuple[float, float], b: tuple[float, float]):
        return lambda s: (_side(a, b, s["a"]) * _side(a, b, s["b"]) < 0) & (_turn(s["a"], s["b"], *a) * _turn(s["a"], s["b"], *b) < 0)

    def near_edge(a: tuple[float, float], b: tuple[float, float]):
        return lambda p: _to_segment(p["x"], p["y"], *[F.lit(float(c)) for c in (*a, *b)]) <= reach

    def near_corner(a: tuple[float, float]):
        return lambda s: _to_segment(F.lit(float(a[0])), F.lit(float(a[1])), s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) <= reach

    hit = F.exists(points, lambda p: inside(p["x"], p["y"], ring))
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        hit = hit | F.exists(segments(points), cut_by(a, b))
        if reach > 0:
            hit = hit | F.exists(points, near_edge(a, b)) | F.exists(segments(points), near_corner(a))
    return hit


def longest_part(parts: Column) -> Column:
    return F.element_at(F.array_sort(F.transform(parts, lambda p: F.struct(length(p).alias("l"), p.alias("p")))), -1)["p"]


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
