"""Grid-shaped views over the test tables: the same arithmetic in Spark and, as CTEs, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KV_TEXTS = ("380/220 kV", "220000", "225,0 kV", "320-DC", "400", "unknown", "110")
OPERATORS = ("TransnetBW", "RTE", "50Hertz Transmission", "TenneT TSO", None)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def ref_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Reference lines from orders: one row an order."""
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.cast("string").alias("id"),
        k.alias("seq"),
        F.concat(F.lit("E"), (k % 997).cast("string")).alias("ext_code"),
        F.concat(F.lit("Line "), c.cast("string")).alias("name"),
        F.concat(F.lit("N"), (c % 25).cast("string")).alias("bus0"),
        F.when(k % 11 != 0, F.concat(F.lit("N"), ((c * 7 + k) % 25).cast("string"))).alias("bus1"),
        _pick(KV_TEXTS, k % 7).alias("kv_text"),
        _pick((220, 380, 400, 225, 110), k % 5).cast("double").alias("kv"),
        (F.col("o_totalprice") / 1000).alias("length_km"),
        ((c % 50) / 10.0).alias("r"),
        ((k % 70) / 10.0).alias("x"),
        ((c % 90) / 1000.0).alias("b"),
        _pick(OPERATORS, k % 5).alias("operator"),
        (k % 4 == 0).alias("is_parallel"),
    )


def model_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Model lines from lineitem: one row a line item; a_id names the order it belongs to."""
    p, s, n, o = (F.col(f"l_{c}") for c in ("partkey", "suppkey", "linenumber", "orderkey"))
    ident = F.concat(F.lit("relation/"), p.cast("string"), F.lit("-380-"), n.cast("string"), F.lit("-"), s.cast("string"), F.lit("-"), o.cast("string"))
    return table(spark, sf, "lineitem").select(
        ident.alias("id"),
        o.cast("string").alias("a_id"),
        p.alias("partkey"),
        s.alias("suppkey"),
        n.alias("number"),
        F.concat(F.lit("N"), (s % 25).cast("string")).alias("bus0"),
        F.when(p % 13 != 0, F.concat(F.lit("N"), (p % 25).cast("string"))).alias("bus1"),
        _pick((110, 220, 225, 380, 400), p % 5).cast("double").alias("kv"),
        F.col("l_extendedprice").alias("length_m"),
        (1 + n % 3).cast("int").alias("circuits"),
        (F.col("l_discount") * 10).alias("r"),
        (F.col("l_tax") * 100).alias("x"),
        (F.col("l_quantity") / 1000).alias("b"),
    )


def ref_points(spark: SparkSession, sf: str) -> DataFrame:
    """Reference transformers from customers."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("a_id"),
        F.concat(F.when(k % 17 == 0, "T_").otherwise(""), F.col("c_name")).alias("name"),
        F.when(k % 6 == 0, F.concat(F.lit("X"), (k % 400).cast("string"))).alias("ext_code"),
        (6 + (k * 7919 % 9000) / 1000.0).alias("lon"),
        (47 + (k * 104729 % 8000) / 1000.0).alias("lat"),
        _pick((380, 400, 220), k % 3).cast("double").alias("kv0"),
        _pick((220, 110), k % 2).cast("double").alias("kv1"),
        (k % 30 / 10.0).alias("r"),
        F.when(k % 19 == 0, "Added for Coherence").otherwise(F.col("c_mktsegment")).alias("comment"),
    )


def model_points(spark: SparkSession, sf: str) -> DataFrame:
    """Model transformers from suppliers."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("b_id"),
        F.when(k % 2 == 0, F.concat(F.lit("X"), (k * 6 % 400).cast("string"))).alias("ext_code"),
        (6 + (k * 6007 % 9000) / 1000.0).alias("lon"),
        (47 + (k * 91193 % 8000) / 1000.0).alias("lat"),
        _pick((220, 380, 400), k % 3).cast("double").alias("kv0"),
        _pick((110, 220), k % 2).cast("double").alias("kv1"),
        (k % 40 / 10.0).alias("r"),
    )


def polylines(spark: SparkSession, sf: str, vertices: int = 8) -> DataFrame:
    """Lines of eight points from the first components of embeddings."""
    point = lambda i: F.struct(F.col("embedding")[2 * i].cast("double").alias("x"), F.col("embedding")[2 * i + 1].cast("double").alias("y"))
    return table(spark, sf, "embeddings").select("vec_id", "label", F.array(*[point(i) for i in range(vertices)]).alias("points"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


SQL = f"""WITH RECURSIVE ref_lines AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, 'E' || (o_orderkey % 997) AS ext_code, 'Line ' || o_custkey AS name,
    'N' || (o_custkey % 25) AS bus0, CASE WHEN o_orderkey % 11 <> 0 THEN 'N' || ((o_custkey * 7 + o_orderkey) % 25) END AS bus1,
    ({_list(KV_TEXTS)})[o_orderkey % 7 + 1] AS kv_text, CAST(([220, 380, 400, 225, 110])[o_orderkey % 5 + 1] AS DOUBLE) AS kv,
    o_totalprice / 1000 AS length_km, (o_custkey % 50) / CAST(10.0 AS DOUBLE) AS r, (o_orderkey % 70) / CAST(10.0 AS DOUBLE) AS x, (o_custkey % 90) / CAST(1000.0 AS DOUBLE) AS b,
    ({_list(OPERATORS)})[o_orderkey % 5 + 1] AS operator, o_orderkey % 4 = 0 AS is_parallel FROM orders),
model_lines AS (
  SELECT 'relation/' || l_partkey || '-380-' || l_linenumber || '-' || l_suppkey || '-' || l_orderkey AS id, CAST(l_orderkey AS VARCHAR) AS a_id,
    l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS number, 'N' || (l_suppkey % 25) AS bus0,
    CASE WHEN l_partkey % 13 <> 0 THEN 'N' || (l_partkey % 25) END AS bus1, CAST(([110, 220, 225, 380, 400])[l_partkey % 5 + 1] AS DOUBLE) AS kv,
    l_extendedprice AS length_m, CAST(1 + l_linenumber % 3 AS INTEGER) AS circuits, l_discount * 10 AS r, l_tax * 100 AS x, l_quantity / 1000 AS b FROM lineitem),
ref_points AS (
  SELECT c_custkey AS a_id, CASE WHEN c_custkey % 17 = 0 THEN 'T_' ELSE '' END || c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'X' || (c_custkey % 400) END AS ext_code,
    6 + (c_custkey * 7919 % 9000) / CAST(1000.0 AS DOUBLE) AS lon, 47 + (c_custkey * 104729 % 8000) / CAST(1000.0 AS DOUBLE) AS lat,
    CAST(([380, 400, 220])[c_custkey % 3 + 1] AS DOUBLE) AS kv0, CAST(([220, 110])[c_custkey % 2 + 1] AS DOUBLE) AS kv1, (c_custkey % 30) / CAST(10.0 AS DOUBLE) AS r,
    CASE WHEN c_custkey % 19 = 0 THEN 'Added for Coherence' ELSE c_mktsegment END AS comment FROM customer),
model_points AS (
  SELECT s_suppkey AS b_id, CASE WHEN s_suppkey % 2 = 0 THEN 'X' || (s_suppkey * 6 % 400) END AS ext_code,
    6 + (s_suppkey * 6007 % 9000) / CAST(1000.0 AS DOUBLE) AS lon, 47 + (s_suppkey * 91193 % 8000) / CAST(1000.0 AS DOUBLE) AS lat,
    CAST(([220, 380, 400])[s_suppkey % 3 + 1] AS DOUBLE) AS kv0, CAST(([110, 220])[s_suppkey % 2 + 1] AS DOUBLE) AS kv1, (s_suppkey % 40) / CAST(10.0 AS DOUBLE) AS r FROM supplier),
polylines AS (
  SELECT vec_id, label, list_transform(range(0, 8), lambda i: {{'x': CAST(embedding[2 * i + 1] AS DOUBLE), 'y': CAST(embedding[2 * i + 2] AS DOUBLE)}}) AS points FROM embeddings),
steps AS (
  SELECT vec_id, label, i, points[i + 1] AS a, points[i + 2] AS b,
    sqrt((points[i + 2].x - points[i + 1].x) * (points[i + 2].x - points[i + 1].x) + (points[i + 2].y - points[i + 1].y) * (points[i + 2].y - points[i + 1].y)) AS len
  FROM polylines, range(0, 7) t(i))
"""
