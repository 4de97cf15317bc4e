"""Transformer linkage: by code, then by place, then refined by voltage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.operators import joins


def drop_dummies(points: DataFrame) -> DataFrame:
    name, comment = F.coalesce("name", F.lit("")), F.lower(F.coalesce("comment", F.lit("")))
    return points.where(~name.startswith("T_") & ~comment.contains("added for coherence"))


def by_code(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs with an equal, non-empty code, with full confidence."""
    right = b.where("ext_code is not null and ext_code <> ''").select(F.col("b_id"), "ext_code", F.col("kv0").alias("b_kv0"), F.col("kv1").alias("b_kv1"))
    return a.where("ext_code is not null and ext_code <> ''").join(right, "ext_code").select("a_id", "b_id", "kv0", "kv1", "b_kv0", "b_kv1", F.lit("ext_code").alias("match_type"), F.lit(1.0).alias("confidence"))


def _close(x: Column, y: Column, kv: float) -> Column:
    return F.coalesce(F.abs(x - y) < kv, F.lit(False))


def by_place(a: DataFrame, b: DataFrame, km: float = 5.0, kv: float = 10.0) -> DataFrame:
    """The nearest model point within km: confidence falls with distance and with each voltage that differs; others stay unmatched."""
    right = b.select("b_id", F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"), F.col("kv0").alias("b_kv0"), F.col("kv1").alias("b_kv1"))
    near = joins.nearest_within(a.select("a_id", "lon", "lat"), right, "a_id", "b_id", ("lon", "lat"), ("b_lon", "b_lat"), km).drop("lon", "lat", "b_lon", "b_lat")
    out = a.select("a_id", "kv0", "kv1").join(near, "a_id", "left")
    same = _close(F.col("kv0"), F.col("b_kv0"), kv).cast("int") + _close(F.col("kv1"), F.col("b_kv1"), kv).cast("int")
    confidence = F.greatest(F.lit(0.0), 1 - F.col("distance_km") / km) * (0.5 + 0.5 * (same / 2))
    found = F.col("b_id").isNotNull()
    return out.select("a_id", "b_id", "kv0", "kv1", "b_kv0", "b_kv1", F.when(found, "location").otherwise("none").alias("match_type"), F.when(found, confidence).otherwise(0.0).alias("confidence"))


def refine(matches: DataFrame, kv: float = 10.0) -> DataFrame:
    """Raise or halve the confidence by how windings agree, in either order."""
    c = {f"{i}{j}": _close(F.col(f"kv{i}"), F.col(f"b_kv{j}"), kv) for i in "01" for j in "01"}
    score = F.when((c["00"] & c["11"]) | (c["01"] & c["10"]), 1.0).when(c["00"] | c["11"] | c["01"] | c["10"], 0.5).otherwise(0.0)
    found = F.col("b_id").isNotNull()
    raised = F.greatest(F.col("confidence"), F.least(F.col("confidence") * 1.2, F.lit(1.0)) * (0.5 + 0.5 * score))
    out = matches.withColumn("_s", score)
    return out.withColumn("confidence", F.when(found, F.when(F.col("_s") == 0, raised * 0.5).otherwise(raised)).otherwise(F.col("confidence"))).withColumn(
        "match_type", F.when(found & (F.col("_s") == 0), "location_voltage_mismatch").otherwise(F.col("match_type"))
    ).drop("_s")


def link(a: DataFrame, b: DataFrame, km: float = 5.0) -> DataFrame:
    """The whole linkage: dummies go, codes first, places for the rest, then voltages."""
    a = drop_dummies(a)
    coded = by_code(a, b)
    rest = a.join(coded.select("a_id").distinct(), "a_id", "left_anti")
    return refine(coded.unionByName(by_place(rest, b, km)))


def take_parameters(b: DataFrame, matches: DataFrame, a: DataFrame) -> DataFrame:
    """Reference parameters on the model transformers; the last match of a transformer, by reference id, wins."""
    last = joins.last_by(matches.where("b_id is not null").select("a_id", "b_id", "match_type"), "b_id", ["a_id"])
    values = last.join(a.select("a_id", F.col("r").alias("ref_r"), F.col("ext_code").alias("ref_code")), "a_id")
    return b.join(values.select("b_id", "a_id", "ref_r", "ref_code"), "b_id", "left").withColumn("r_updated", F.coalesce("ref_r", "r"))


def take_by_code_then_name(b: DataFrame, a: DataFrame, code: str, name: str, value: str) -> DataFrame:
    """value by code, else by name."""
    by_code_ = joins.first_by(a.where(F.col(code).isNotNull()).select(F.col(code).alias("_code"), F.col(value).alias("_v1")), "_code", ["_v1"])
    by_name = joins.first_by(a.select(F.col(name).alias("_name"), F.col(value).alias("_v2")), "_name", ["_v2"])
    out = b.join(by_code_, F.col(code) == F.col("_code"), "left").join(by_name, F.col(name) == F.col("_name"), "left")
    return out.withColumn(f"ref_{value}", F.coalesce("_v1", "_v2")).drop("_code", "_name", "_v1", "_v2")
