"""The registered queries over the bridge views, each with the DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import scalars as S
from lineweave.operators import analytics as A
from lineweave.operators import graph, joins, matching, passes, paths, points
from lineweave.plans import bridge
from lineweave.plans.bridge import model_lines, model_points, polylines, ref_lines, ref_points, table
from lineweave.plans.thresholds import Thresholds

T = Thresholds()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = bridge.SQL + (", " + body[1:] if body.startswith(",") else body)
        return f

    return add


R = lambda c, digits=6: F.round(c, digits)
BIG = lambda c: c.cast("long")
KM = "CASE WHEN abs(length_m) >= 1000 THEN length_m / 1000 ELSE length_m END"

# --- voltages and other scalars

KV_MAX = r"list_max(list_transform(regexp_extract_all(replace(lower(kv_text), ',', '.'), '[0-9]+(?:\.[0-9]+)?'), lambda s: CASE WHEN CAST(s AS DOUBLE) >= 1000 AND CAST(s AS DOUBLE) % 1000 = 0 THEN CAST(s AS DOUBLE) / 1000 ELSE CAST(s AS DOUBLE) END))"


@query(f"SELECT id, {KV_MAX} AS kv_max FROM ref_lines")
def kv_text_max(spark, sf):
    return ref_lines(spark, sf).select("id", S.kv_max(F.col("kv_text")).alias("kv_max"))


@query(f"""
, t AS (SELECT id, kv_text, {KV_MAX} AS k FROM ref_lines)
SELECT id, CASE WHEN k IS NULL THEN 'unknown' WHEN k >= 200 AND k < 260 THEN '220-225' WHEN k >= 360 AND k <= 420 THEN '380-400' ELSE 'other' END AS bucket,
  CASE WHEN k >= 300 THEN '380' WHEN k >= 200 AND k < 300 THEN '220' ELSE 'other' END AS wide,
  CASE WHEN kv_text LIKE '%DC%' THEN 'DC' WHEN k >= 100 AND k < 200 THEN '110kV' WHEN k >= 200 AND k < 300 THEN '220kV' WHEN k >= 300 THEN '400kV' ELSE 'other' END AS class,
  CAST(CASE WHEN k IN (380, 400) THEN 400 WHEN k IN (220, 225) THEN 220 ELSE k END AS INTEGER) AS canonical,
  coalesce((k >= 200 AND k < 260) OR (k >= 360 AND k <= 420), false) AS eligible,
  CASE WHEN kv_text NOT LIKE '%DC%' THEN TRY_CAST(split_part(kv_text, '-', 1) AS DOUBLE) END AS plain FROM t""")
def kv_classes(spark, sf):
    k, text = S.kv_max(F.col("kv_text")), F.col("kv_text")
    return ref_lines(spark, sf).select(
        "id", S.kv_bucket(k).alias("bucket"), S.kv_bucket_wide(k).alias("wide"), S.kv_class(k, text.contains("DC")).alias("class"),
        S.canonical_kv(k).alias("canonical"), S.eligible_kv(k).alias("eligible"), S.kv_number(text).alias("plain"),
    )


@query("""
SELECT a.id, m.id AS b_id,
  (a.kv = 220 AND m.kv = 220) OR (a.kv IN (380, 400) AND m.kv IN (380, 400)) AS strict,
  a.kv = m.kv OR (a.kv IN (380, 400) AND m.kv IN (380, 400)) AS equal,
  a.kv = m.kv OR (a.kv IN (380, 400) AND m.kv IN (380, 400)) OR (a.kv = 220 AND m.kv IN (220, 380, 400)) AS lenient
FROM ref_lines a JOIN model_lines m ON m.a_id = a.id""")
def kv_compatible(spark, sf):
    a, m = ref_lines(spark, sf).select("id", "kv"), model_lines(spark, sf).select(F.col("id").alias("b_id"), "a_id", F.col("kv").alias("b_kv"))
    pairs = m.join(a, F.col("a_id") == F.col("id"))
    return pairs.select("id", "b_id", *[S.compatible(F.col("kv"), F.col("b_kv"), r).alias(r) for r in ("strict", "equal", "lenient")])


DIRTY = "CASE o_orderkey % 6 WHEN 0 THEN '1.234' WHEN 1 THEN '1,5' WHEN 2 THEN '1,234.5' WHEN 3 THEN 'n/a' WHEN 4 THEN ' 12 345 ' ELSE CAST(o_custkey AS VARCHAR) || '.7' END"


@query(rf"""
, t AS (SELECT o_orderkey AS id, {DIRTY} AS s FROM orders),
u AS (SELECT *, regexp_replace(s, '\s', '', 'g') AS c FROM t)
SELECT id, TRY_CAST(CASE WHEN contains(c, ',') AND NOT contains(c, '.') THEN replace(c, ',', '.') ELSE replace(c, ',', '') END AS DOUBLE) AS locale,
  TRY_CAST(s AS DOUBLE) AS plain, CAST(coalesce(trunc(TRY_CAST(s AS DOUBLE)), 0) AS INTEGER) AS whole,
  CAST(round_even(TRY_CAST(s AS DOUBLE), 0) AS INTEGER) AS nearest FROM u""")
def numbers_from_text(spark, sf):
    k = F.col("o_orderkey")
    s = F.when(k % 6 == 0, "1.234").when(k % 6 == 1, "1,5").when(k % 6 == 2, "1,234.5").when(k % 6 == 3, "n/a").when(k % 6 == 4, " 12 345 ").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".7")))
    return table(spark, sf, "orders").select(k.alias("id"), S.locale_num(s).alias("locale"), S.num(s).alias("plain"), S.safe_int(s).alias("whole"), S.whole_or_null(s).alias("nearest"))


@query(f"SELECT id, {KM} AS km, CASE WHEN length_m > 1000 THEN length_m / 1000 ELSE length_m END AS km_above, round(r / nullif({KM}, 0), 9) AS r_per_km FROM model_lines")
def unit_km(spark, sf):
    km = S.to_km(F.col("length_m"))
    return model_lines(spark, sf).select("id", km.alias("km"), S.to_km(F.col("length_m"), inclusive=False).alias("km_above"), R(S.safe_div(F.col("r"), km), 9).alias("r_per_km"))


@query("""
SELECT m.id, CASE WHEN a.r = 0 THEN CASE WHEN m.r = 0 THEN 0.0 ELSE 100.0 END ELSE round((m.r - a.r) / a.r * 100, 6) + 0.0 END AS of_base,
  CASE WHEN abs(a.r) >= 1e-9 THEN round(100 * (m.r - a.r) / abs(a.r), 6) + 0.0 END AS or_null,
  CASE WHEN a.r <> 0 THEN round(m.r / a.r * 100, 6) ELSE 0 END AS share,
  CASE WHEN abs(a.r) >= 1e-12 THEN round(100 * (m.r - a.r) / abs(a.r), 6) + 0.0 END AS residual
FROM model_lines m JOIN ref_lines a ON m.a_id = a.id""")
def pct_differences(spark, sf):
    a = ref_lines(spark, sf).select(F.col("id").alias("a_id"), F.col("r").alias("base"))
    m = model_lines(spark, sf).select("id", "a_id", "r").join(a, "a_id")
    b, v = F.col("base"), F.col("r")
    return m.select("id", R(S.pct_of_base(b, v)).alias("of_base"), R(S.pct_or_null(v, b)).alias("or_null"), R(S.pct_share(v, b)).alias("share"), R(S.residual_pct(b, v)).alias("residual"))


@query(r"""
, t AS (SELECT id, CASE WHEN number % 2 = 0 THEN id ELSE 'merged_way/' || partkey || '_380+' || number END AS ident FROM model_lines),
p AS (SELECT id, ident, coalesce(nullif(regexp_extract(ident, '/(\d+)-', 1), ''), nullif(regexp_extract(ident, 'relation/(\d+)', 1), ''), nullif(regexp_extract(ident, 'way/(\d+)', 1), '')) AS pattern FROM t)
SELECT id, pattern, substr(ident, strpos(ident, pattern) + length(pattern)) AS suffix FROM p""")
def id_patterns(spark, sf):
    ident = F.when(F.col("number") % 2 == 0, F.col("id")).otherwise(F.concat(F.lit("merged_way/"), F.col("partkey").cast("string"), F.lit("_380+"), F.col("number").cast("string")))
    return model_lines(spark, sf).select("id", ident.alias("ident")).select("id", S.id_pattern(F.col("ident")).alias("pattern"), S.id_suffix(F.col("ident")).alias("suffix"))


@query("""
, t AS (SELECT a_id, CASE WHEN CAST(a_id AS BIGINT) % 2 = 0 THEN string_agg(id, '; ' ORDER BY id) ELSE string_agg(id, ',' ORDER BY id) END AS ids FROM model_lines GROUP BY a_id)
SELECT a_id, array_to_string(list_filter(list_transform(regexp_split_to_array(ids, '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS ids, CAST(len(regexp_split_to_array(ids, '[;,]')) AS INTEGER) AS n FROM t""")
def id_lists(spark, sf):
    t = model_lines(spark, sf).groupBy("a_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    text = F.when(F.col("a_id").cast("long") % 2 == 0, F.array_join("ids", "; ")).otherwise(F.array_join("ids", ","))
    return t.select("a_id", S.id_list(text).alias("ids")).select("a_id", F.array_join("ids", "|").alias("ids"), F.size("ids").alias("n"))


@query("""
SELECT id, regexp_matches(lower(coalesce(operator, '')), '50hertz|amprion|tennet|transnetbw') AS national,
  coalesce(ext_code, name, 'line_' || seq) AS ident FROM ref_lines""")
def national_lines(spark, sf):
    t = ref_lines(spark, sf)
    return t.select("id", S.national(F.col("operator")).alias("national"), F.coalesce(S.first_of(t, "ext_code", "name"), F.concat(F.lit("line_"), F.col("seq").cast("string"))).alias("ident"))


@query("""
, s AS (SELECT id, (seq % 101) / CAST(100.0 AS DOUBLE) AS score, 1 + seq % 3 AS n, is_parallel FROM ref_lines),
l AS (SELECT id, score, CASE WHEN is_parallel THEN 'Parallel Circuit - ' ELSE '' END || CASE WHEN n > 1 THEN n || '-Segment ' ELSE '' END ||
  CASE WHEN score >= 0.8 THEN 'Excellent' WHEN score >= 0.6 THEN 'Good' WHEN score >= 0.4 THEN 'Fair' ELSE 'Poor' END || ' Match' AS label FROM s)
SELECT id, label, CASE WHEN score >= 0.85 THEN 'Excellent' WHEN score >= 0.7 THEN 'Good' WHEN score >= 0.5 THEN 'Fair' ELSE 'Poor' END AS rating,
  CASE WHEN contains(label, 'Excellent') THEN 'Excellent' WHEN contains(label, 'Good') THEN 'Good' WHEN contains(label, 'Fair') THEN 'Fair' ELSE 'Poor' END AS category FROM l""")
def quality_labels(spark, sf):
    score = (F.col("seq") % 101) / 100.0
    label = S.quality_label(score, 1 + F.col("seq") % 3, F.col("is_parallel"))
    return ref_lines(spark, sf).select("id", label.alias("label"), S.quality_rating(score).alias("rating"), S.quality_category(label).alias("category"))


# --- sources and formats

WKT = "CASE WHEN s_suppkey % 3 = 0 THEN 'junk ''LINESTRING (' ELSE 'LINESTRING(' END || s_suppkey || ' ' || (s_suppkey + 1) || '.5, ' || (s_suppkey * 2) || ' ' || s_nationkey || ')'"


@query(f"""
, w AS (SELECT s_suppkey AS id, {WKT} AS t, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT id, 'LINESTRING (' || printf('%.6f %.6f', CAST(k AS DOUBLE), k + 1.5::DOUBLE) || ', ' || printf('%.6f %.6f', CAST(k * 2 AS DOUBLE), CAST(n AS DOUBLE)) || ')' AS wkt, 2 AS vertices FROM w""")
def wkt_roundtrip(spark, sf):
    k = F.col("s_suppkey")
    text = F.concat(F.when(k % 3 == 0, "junk 'LINESTRING (").otherwise("LINESTRING("), F.concat_ws(" ", k.cast("string"), F.concat((k + 1).cast("string"), F.lit(".5,")), (k * 2).cast("string"), F.col("s_nationkey").cast("string")), F.lit(")"))
    line = G.parse_wkt(text)[0]
    return table(spark, sf, "supplier").select(k.alias("id"), G.to_wkt(line).alias("wkt"), F.size(line).alias("vertices"))


RAW = "CASE l_linenumber % 3 WHEN 0 THEN 'way/' WHEN 1 THEN 'relation/' ELSE 'node/' END || l_partkey || '-' || (100 + l_partkey % 5 * 70) || CASE WHEN l_suppkey % 2 = 0 THEN '-DC' ELSE '' END || ',' || l_suppkey || ',' || l_linenumber || ',LINESTRING (' || l_partkey || ' ' || l_suppkey || ')'"


@query(rf"""
, t AS (SELECT {RAW} AS row FROM lineitem)
SELECT split_part(row, ',', 1) AS id, CAST(nullif(regexp_extract(row, '([0-9]+)-?DC', 1), '') AS INTEGER) AS dc_kv, TRY_CAST(split_part(row, ',', 2) AS DOUBLE) AS i_nom,
  greatest(1, TRY_CAST(split_part(row, ',', 3) AS INTEGER)) AS circuits, regexp_extract(row, '(LINESTRING.*)', 1) AS geometry, count(*) AS n
FROM t WHERE row LIKE 'way/%' OR row LIKE 'relation/%' OR row LIKE 'merged%' GROUP BY ALL""")
def raw_rows(spark, sf):
    from lineweave.sources.readers import parse_raw_lines

    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    text = F.concat(F.when(n % 3 == 0, "way/").when(n % 3 == 1, "relation/").otherwise("node/"), p.cast("string"), F.lit("-"), (100 + p % 5 * 70).cast("string"), F.when(s % 2 == 0, "-DC").otherwise(""),
                    F.lit(","), s.cast("string"), F.lit(","), n.cast("string"), F.lit(",LINESTRING ("), p.cast("string"), F.lit(" "), s.cast("string"), F.lit(")"))
    rows = parse_raw_lines(table(spark, sf, "lineitem").select(text.alias("value")))
    return rows.groupBy("id", "dc_kv", "i_nom", "circuits", "geometry").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT a_id, string_agg(id, ';' ORDER BY id) AS b_ids FROM model_lines GROUP BY a_id""")
def matches_as_csv_rows(spark, sf):
    return model_lines(spark, sf).groupBy("a_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("b_ids"))


@query("""
SELECT a.id, a.ext_code, count(m.id) > 0 AS has_match, coalesce(string_agg(m.id, ';' ORDER BY m.id), '') AS b_ids FROM ref_lines a LEFT JOIN model_lines m ON m.a_id = a.id GROUP BY ALL""")
def ref_with_model_ids(spark, sf):
    ids = model_lines(spark, sf).groupBy("a_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("ids"))
    out = ref_lines(spark, sf).select("id", "ext_code").join(ids, F.col("id") == F.col("a_id"), "left")
    return out.select("id", "ext_code", F.col("a_id").isNotNull().alias("has_match"), F.coalesce("ids", F.lit("")).alias("b_ids"))


@query("""
SELECT id, kv, 'base' AS tag, r FROM ref_lines UNION ALL SELECT id, 110.0, '110kV', NULL FROM model_lines WHERE kv = 110
UNION ALL SELECT 'X' || b_id, 0.0, 'DC', r FROM model_points""")
def export_union(spark, sf):
    base = ref_lines(spark, sf).select("id", "kv", F.lit("base").alias("tag"), "r")
    low = model_lines(spark, sf).where("kv = 110").select("id", F.lit(110.0).alias("kv"), F.lit("110kV").alias("tag"))
    dc = model_points(spark, sf).select(F.concat(F.lit("X"), F.col("b_id").cast("string")).alias("id"), F.lit(0.0).alias("kv"), F.lit("DC").alias("tag"), "r")
    return base.unionByName(low, allowMissingColumns=True).unionByName(dc)


@query("""
SELECT id, kv, 'old' AS tag FROM ref_lines WHERE seq % 3 <> 0 UNION ALL
SELECT id, kv, 'new' FROM ref_lines WHERE seq % 2 = 0 AND id NOT IN (SELECT id FROM ref_lines WHERE seq % 3 <> 0)""")
def import_new(spark, sf):
    from lineweave.sources.readers import import_lines

    t = ref_lines(spark, sf).select("id", "kv", "seq")
    old, new = t.where("seq % 3 <> 0").select("id", "kv", F.lit("old").alias("tag")), t.where("seq % 2 = 0").select("id", "kv", F.lit("new").alias("tag"))
    return import_lines(old, new)


# --- filters


@query("SELECT a_id, name FROM ref_points WHERE coalesce(name, '') NOT LIKE 'T\\_%' ESCAPE '\\' AND NOT contains(lower(coalesce(comment, '')), 'added for coherence')")
def dummy_drop(spark, sf):
    return points.drop_dummies(ref_points(spark, sf)).select("a_id", "name")


RING = [(7.0, 48.0), (13.0, 48.5), (14.0, 54.0), (10.0, 52.0), (8.0, 54.5)]


def _ring_sql() -> str:
    parts = [
        f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < ({x2 - x1}) * (lat - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True)
        if y1 != y2
    ]
    return " + ".join(parts)


@query(f"SELECT a_id FROM ref_points WHERE ({_ring_sql()}) % 2 = 1")
def points_in_boundary(spark, sf):
    return ref_points(spark, sf).where(G.inside(F.col("lon"), F.col("lat"), RING)).select("a_id")


@query("SELECT id, kv FROM model_lines WHERE abs(kv - 220) <= 5 OR abs(kv - 225) <= 5 OR abs(kv - 380) <= 5 OR abs(kv - 400) <= 5")
def allowed_kv(spark, sf):
    near = F.exists(F.array(*[F.lit(float(k)) for k in T.allowed_kv]), lambda k: F.abs(F.col("kv") - k) <= T.allowed_kv_slack)
    return model_lines(spark, sf).where(near).select("id", "kv")


@query("SELECT id FROM ref_lines a WHERE NOT EXISTS (SELECT 1 FROM model_lines m WHERE m.a_id = a.id)")
def unmatched_refs(spark, sf):
    m = model_lines(spark, sf).select(F.col("a_id").alias("id"))
    return ref_lines(spark, sf).select("id").join(m, "id", "left_anti")


@query("SELECT a_id, name FROM ref_points WHERE contains(lower(name), '07') OR contains(lower(coalesce(ext_code, '')), '07') OR contains(CAST(a_id AS VARCHAR), '07')")
def search_points(spark, sf):
    q = "07"
    hit = F.lower("name").contains(q) | F.lower(F.coalesce("ext_code", F.lit(""))).contains(q) | F.col("a_id").cast("string").contains(q)
    return ref_points(spark, sf).where(hit).select("a_id", "name")


# --- comparisons by voltage

CANON = "CASE WHEN kv IN (380, 400) THEN '400' WHEN kv IN (220, 225) THEN '220' ELSE CAST(CAST(kv AS INTEGER) AS VARCHAR) END"


def _compare_sql(a: str, b: str, names: tuple[str, str], kind: str) -> str:
    x, y = names
    return f"""
, a AS ({a}), b AS ({b}),
u AS (SELECT coalesce(a.kv, b.kv) AS kv, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y FROM a FULL JOIN b ON a.kv = b.kv),
v AS (SELECT kv, x, y FROM u UNION ALL SELECT 'Total', sum(x), sum(y) FROM u)
SELECT kv, {kind.format('x')} AS {x}, {kind.format('y')} AS {y}, {kind.format('(x - y)')} AS difference, CASE WHEN y <> 0 THEN round((x - y) / y * 100, 4) END AS difference_pct FROM v"""


@query(_compare_sql(f"SELECT {CANON} AS kv, sum({KM}) AS v FROM model_lines GROUP BY 1", f"SELECT {CANON} AS kv, sum(length_km) AS v FROM ref_lines GROUP BY 1", ("model_km", "ref_km"), "round({}, 3)"))
def length_by_voltage(spark, sf):
    kv = S.canonical_kv(F.col("kv")).cast("string")
    a = model_lines(spark, sf).select(kv.alias("kv"), S.to_km(F.col("length_m")).alias("km"))
    b = ref_lines(spark, sf).select(kv.alias("kv"), "length_km")
    out = A.compare_by(a, b, "kv", F.sum("km"), F.sum("length_km"), ("model_km", "ref_km"))
    return out.select("kv", *[R(F.col(c), 3).alias(c) for c in ("model_km", "ref_km", "difference")], R(F.col("difference_pct"), 4).alias("difference_pct"))


@query(_compare_sql(f"SELECT {CANON} AS kv, count(*) AS v FROM model_lines GROUP BY 1", f"SELECT {CANON} AS kv, count(*) AS v FROM ref_lines GROUP BY 1", ("model_circuits", "ref_circuits"), "CAST({} AS BIGINT)"))
def circuits_by_voltage(spark, sf):
    kv = S.canonical_kv(F.col("kv")).cast("string").alias("kv")
    n = F.count(F.lit(1))
    out = A.compare_by(model_lines(spark, sf).select(kv), ref_lines(spark, sf).select(kv), "kv", n, n, ("model_circuits", "ref_circuits"))
    return out.withColumn("difference_pct", R(F.col("difference_pct"), 4))


def _bus_sql(t: str) -> str:
    return f"""SELECT {CANON} AS kv, count(*) AS v FROM (
  SELECT bus, kv, row_number() OVER (PARTITION BY bus ORDER BY count(*) DESC, kv) AS n FROM (SELECT bus0 AS bus, kv FROM {t} UNION ALL SELECT bus1, kv FROM {t}) e WHERE bus IS NOT NULL GROUP BY bus, kv) q
  WHERE n = 1 AND kv IN (220, 225, 380, 400) GROUP BY 1"""


@query(_compare_sql(_bus_sql("model_lines"), _bus_sql("ref_lines"), ("model_buses", "ref_buses"), "CAST({} AS BIGINT)"))
def substations_by_voltage(spark, sf):
    def count(lines):
        return A.buses(lines.select("bus0", "bus1", "kv")).where(F.col("kv").isin(220, 225, 380, 400)).select(S.canonical_kv(F.col("kv")).cast("string").alias("kv"))

    n = F.count(F.lit(1))
    out = A.compare_by(count(model_lines(spark, sf)), count(ref_lines(spark, sf)), "kv", n, n, ("model_buses", "ref_buses"))
    out = out.select("kv", *[BIG(F.col(c)).alias(c) for c in ("model_buses", "ref_buses", "difference")], "difference_pct")
    return out.withColumn("difference_pct", R(F.col("difference_pct"), 4))


@query(f"SELECT {CANON} AS kv, round(sum({KM}), 3) AS km, round(sum({KM}) / sum(sum({KM})) OVER () * 100, 6) AS share FROM model_lines WHERE kv IN (220, 225, 380, 400) GROUP BY 1")
def length_share(spark, sf):
    kv = S.canonical_kv(F.col("kv")).cast("string").alias("kv")
    t = model_lines(spark, sf).where(F.col("kv").isin(220, 225, 380, 400)).groupBy(kv).agg(F.sum(S.to_km(F.col("length_m"))).alias("km"))
    return t.select("kv", R(F.col("km"), 3).alias("km"), R(F.col("km") / F.sum("km").over(Window.partitionBy()) * 100).alias("share"))


BUCKET = "CASE WHEN kv >= 200 AND kv < 260 THEN '220-225' WHEN kv >= 360 AND kv <= 420 THEN '380-400' WHEN kv IS NULL THEN 'unknown' ELSE 'other' END"


@query(f"SELECT {BUCKET} AS bucket, count(*) AS routes, round(sum({KM}), 3) AS route_km, round(sum({KM} * circuits), 3) AS circuit_km, round(avg(circuits), 6) AS mean_circuits FROM model_lines GROUP BY 1")
def bucket_circuit_km(spark, sf):
    t = A.bucket_lengths(model_lines(spark, sf), S.kv_bucket(F.col("kv")))
    return t.select("bucket", "routes", R(F.col("route_km"), 3).alias("route_km"), R(F.col("circuit_km"), 3).alias("circuit_km"), R(F.col("mean_circuits")).alias("mean_circuits"))


@query(f"""
, t AS (SELECT kv, sum({KM} * circuits) AS km FROM model_lines GROUP BY kv),
r AS (SELECT *, row_number() OVER (PARTITION BY kv IN (220, 225, 380, 400) ORDER BY km DESC, kv) AS n FROM t)
SELECT kv, round(km, 3) AS circuit_km FROM r WHERE kv IN (220, 225, 380, 400) OR n <= 8""")
def exact_kv_top8(spark, sf):
    t = model_lines(spark, sf).groupBy("kv").agg(F.sum(S.to_km(F.col("length_m")) * F.col("circuits")).alias("km"))
    fixed = F.col("kv").isin(220, 225, 380, 400)
    n = F.row_number().over(Window.partitionBy(fixed).orderBy(F.desc("km"), "kv"))
    return t.withColumn("n", n).where(fixed | (F.col("n") <= 8)).select("kv", R(F.col("km"), 3).alias("circuit_km"))


@query(f"SELECT round(sum({KM} * circuits), 3) AS circuit_km, 36002.0::DOUBLE AS published_km, round((sum({KM} * circuits) - 36002) / 36002 * 100, 6) AS delta_pct FROM model_lines WHERE kv >= 220")
def national_delta(spark, sf):
    km = F.sum(S.to_km(F.col("length_m")) * F.col("circuits"))
    t = model_lines(spark, sf).where("kv >= 220").agg(km.alias("km"))
    return t.select(R(F.col("km"), 3).alias("circuit_km"), F.lit(T.national_circuit_km).alias("published_km"), R((F.col("km") - T.national_circuit_km) / T.national_circuit_km * 100).alias("delta_pct"))


@query(f"""
, t AS (SELECT {KV_MAX} AS k FROM ref_lines)
SELECT CASE WHEN k IS NULL THEN 'none' WHEN k <= 110 THEN '000-110' WHEN k <= 150 THEN '110-150' WHEN k <= 220 THEN '150-220' WHEN k <= 300 THEN '220-300' WHEN k <= 400 THEN '300-400' WHEN k <= 800 THEN '400-800' ELSE 'above' END AS bin, count(*) AS n FROM t GROUP BY 1""")
def kv_histogram(spark, sf):
    k, label = F.col("k"), F.when(F.col("k").isNull(), "none")
    edges = (0, 110, 150, 220, 300, 400, 800)
    for low, high in zip(edges, edges[1:], strict=False):
        label = label.when(k <= high, f"{low:03d}-{high}")
    return ref_lines(spark, sf).select(S.kv_max(F.col("kv_text")).alias("k")).groupBy(label.otherwise("above").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT CASE WHEN kv IS NULL THEN 'unparsed' WHEN kv < 220 THEN 'lv' ELSE 'mvhv' END AS part, count(*) AS n, round(sum({KM}), 3) AS km,
  round(sum({KM}) / sum(sum({KM})) OVER (), 6) AS share FROM model_lines GROUP BY 1""")
def lv_mv_split(spark, sf):
    part = F.when(F.col("kv").isNull(), "unparsed").when(F.col("kv") < T.split_kv, "lv").otherwise("mvhv")
    t = model_lines(spark, sf).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(S.to_km(F.col("length_m"))).alias("km"))
    return t.select("part", "n", R(F.col("km"), 3).alias("km"), R(F.col("km") / F.sum("km").over(Window.partitionBy())).alias("share"))


# --- groups, statistics, allocation


@query("""
SELECT string_agg(id, '_' ORDER BY id) AS group_id, count(*) AS members FROM model_lines GROUP BY partkey, suppkey HAVING count(*) > 1""")
def parallel_groups(spark, sf):
    t = model_lines(spark, sf).groupBy("partkey", "suppkey").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    return t.select(F.array_join("ids", "_").alias("group_id"), F.size("ids").cast("long").alias("members"))


MATCH_SQL = f""", links AS (
  SELECT a.id AS a_id, a.kv, a.is_parallel, a.seq, a.length_km AS ref_km, count(m.id) AS n, sum({KM.replace('length_m', 'm.length_m')}) AS km
  FROM ref_lines a LEFT JOIN model_lines m ON m.a_id = a.id GROUP BY ALL)
"""


def _links(spark, sf):
    m = model_lines(spark, sf).groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.sum(S.to_km(F.col("length_m"))).alias("km"), F.array_sort(F.collect_list("id")).alias("b_ids"))
    a = ref_lines(spark, sf).select(F.col("id").alias("a_id"), "kv", "is_parallel", "seq", F.col("length_km").alias("ref_km"))
    return a.join(m, "a_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""{MATCH_SQL}
, s AS (SELECT *, CASE WHEN n = 0 THEN 'unmatched' WHEN km / ref_km >= 0.8 THEN 'Excellent' WHEN km / ref_km >= 0.6 THEN 'Good' WHEN km / ref_km >= 0.4 THEN 'Fair' ELSE 'Poor' END AS quality FROM links)
SELECT 'voltage' AS statistic, CAST(CAST(kv AS INTEGER) AS VARCHAR) AS category, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT 'quality', quality, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'matched', CAST(n > 0 AS VARCHAR), count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'parallel', CAST(is_parallel AS VARCHAR), count(*) FROM s GROUP BY ALL""")
def match_stats(spark, sf):
    ratio = F.col("km") / F.col("ref_km")
    quality = F.when(F.col("n") == 0, "unmatched").otherwise(S.quality_category(S.quality_label(ratio, F.lit(1), F.lit(False))))
    return A.statistics(_links(spark, sf), {"voltage": F.col("kv").cast("int"), "quality": quality, "matched": F.col("n") > 0, "parallel": F.col("is_parallel")})


@query("""
, t AS (SELECT number, suppkey, kv, length_m / 1000 AS km, bus0, bus1, suppkey IN (SELECT b_id FROM model_points WHERE lat < 52) AS near FROM model_lines),
r AS (SELECT concat_ws('; ', CASE WHEN kv NOT IN (220, 380, 400) THEN 'Non-standard voltage class' END, CASE WHEN km < 1 THEN 'Very short line (<1km)' END,
  CASE WHEN coalesce(bus0, '') = '' OR coalesce(bus1, '') = '' THEN 'Missing bus connections' END, CASE WHEN NOT near THEN 'No nearby reference lines' END) AS reasons, km FROM t),
f AS (SELECT CASE WHEN reasons <> '' THEN reasons WHEN km > 20 THEN 'Long line, possible cross-border or in area not covered by the reference' ELSE 'Unknown (may be duplicate path or parallel circuit)' END AS reasons FROM r)
SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM f) GROUP BY 1""")
def unmatched_reasons(spark, sf):
    near = model_points(spark, sf).where("lat < 52").select(F.col("b_id").alias("suppkey"), F.lit(True).alias("near"))
    t = model_lines(spark, sf).join(near, "suppkey", "left")
    reasons = S.unmatched_reasons(F.col("kv"), F.col("length_m") / 1000, F.col("bus0"), F.col("bus1"), F.coalesce("near", F.lit(False)))
    return t.select(F.explode(F.split(reasons, "; ")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(corr(m.r, a.r), 4) AS r_corr, round(corr(m.x, a.x), 4) AS x_corr, count(*) AS n FROM model_lines m JOIN ref_lines a ON m.a_id = a.id WHERE m.r > 0 AND a.r > 0 AND m.x > 0 AND a.x > 0")
def param_corr(spark, sf):
    a = ref_lines(spark, sf).select(F.col("id").alias("a_id"), F.col("r").alias("ar"), F.col("x").alias("ax"))
    t = model_lines(spark, sf).select("a_id", "r", "x").join(a, "a_id").where("r > 0 and ar > 0 and x > 0 and ax > 0")
    return t.agg(R(F.corr("r", "ar"), 4).alias("r_corr"), R(F.corr("x", "ax"), 4).alias("x_corr"), F.count(F.lit(1)).alias("n"))


ALLOC_SQL = f""", alloc AS (
  SELECT m.a_id, m.id AS b_id, {KM} / sum({KM}) OVER (PARTITION BY m.a_id) AS share, circuits, a.r AS total_r, a.x AS total_x, a.b AS total_b
  FROM model_lines m JOIN ref_lines a ON m.a_id = a.id)
"""


def _allocated(spark, sf):
    seg = model_lines(spark, sf).select("a_id", F.col("id").alias("b_id"), S.to_km(F.col("length_m")).alias("segment_km"), "circuits")
    totals = ref_lines(spark, sf).select(F.col("id").alias("a_id"), *[F.col(c).alias(f"total_{c}") for c in "rxb"])
    return A.allocate(seg, totals), totals


@query(ALLOC_SQL + "SELECT a_id, b_id, round(share, 9) AS share, round(total_r * share / circuits, 9) AS allocated_r, round(total_x * share / circuits, 9) AS allocated_x, round(total_b * share * circuits, 9) AS allocated_b FROM alloc")
def allocate_weighted(spark, sf):
    t, _ = _allocated(spark, sf)
    return t.select("a_id", "b_id", *[R(F.col(c), 9).alias(c) for c in ("share", "allocated_r", "allocated_x", "allocated_b")])


@query(ALLOC_SQL + """
, s AS (SELECT a_id, total_r, sum(total_r * share / circuits) AS got FROM alloc GROUP BY a_id, total_r),
p AS (SELECT a_id, CASE WHEN abs(total_r) >= 1e-12 THEN 100 * (got - total_r) / abs(total_r) END AS residual FROM s)
SELECT a_id, round(residual, 6) + 0.0 AS residual, CASE WHEN residual IS NULL THEN 'none' WHEN abs(round(residual, 6)) <= 10 THEN 'good' WHEN abs(round(residual, 6)) <= 30 THEN 'fair' ELSE 'poor' END AS class FROM p""")
def allocation_residual(spark, sf):
    t, totals = _allocated(spark, sf)
    s = t.groupBy("a_id").agg(F.sum("allocated_r").alias("got")).join(totals, "a_id")
    p = R(S.residual_pct(F.col("total_r"), F.col("got")))
    return s.select("a_id", p.alias("residual"), S.residual_bin(p).alias("class"))


@query(f"""
, e AS (SELECT DISTINCT id, kv, {KM} * circuits AS ckm FROM model_lines WHERE (kv >= 200 AND kv < 260) OR (kv >= 360 AND kv <= 420))
SELECT count(*) AS lines, round(sum(ckm), 3) AS matched_ckm, (SELECT count(DISTINCT a_id) FROM model_lines) AS matched_refs, (SELECT count(*) FROM ref_lines) AS refs FROM e""")
def dedup_matched_ckm(spark, sf):
    m = model_lines(spark, sf)
    lines = m.where(S.eligible_kv(F.col("kv"))).select("id", "kv", (S.to_km(F.col("length_m")) * F.col("circuits")).alias("ckm")).distinct()
    refs = ref_lines(spark, sf).agg(F.count(F.lit(1)).alias("refs"))
    used = m.select("a_id").distinct().agg(F.count(F.lit(1)).alias("matched_refs"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), R(F.sum("ckm"), 3).alias("matched_ckm")).crossJoin(used).crossJoin(refs)


USE_SQL = ", uses AS (SELECT l_partkey AS b_id, CAST(l_orderkey AS VARCHAR) AS a_id, 1 + l_partkey % 4 AS circuits, l_linenumber % 2 = 0 AS is_parallel, l_quantity AS score, l_suppkey, l_linenumber FROM lineitem)\n"


def _uses(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("b_id"), F.col("l_orderkey").cast("string").alias("a_id"), (1 + F.col("l_partkey") % 4).alias("circuits"), (F.col("l_linenumber") % 2 == 0).alias("is_parallel"), F.col("l_quantity").alias("score"), "l_suppkey", "l_linenumber")


@query(USE_SQL + "SELECT b_id, count(*) AS used, any_value(circuits) AS circuits FROM uses GROUP BY b_id HAVING count(*) > any_value(circuits)")
def capacity_usage(spark, sf):
    lines = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (1 + F.col("p_partkey") % 4).alias("circuits"))
    return A.over_subscribed(_uses(spark, sf).select("b_id"), lines)


@query(USE_SQL + "SELECT b_id, sum(score) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY is_parallel DESC, score DESC, a_id) AS n FROM uses) WHERE n <= circuits GROUP BY b_id")
def capacity_keep_top(spark, sf):
    return A.keep_within_capacity(_uses(spark, sf)).groupBy("b_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))


# --- joins by order


@query("""
, a AS (SELECT id, bus0, row_number() OVER (PARTITION BY bus0 ORDER BY id) AS rank FROM ref_lines), b AS (SELECT id AS b_id, bus0, row_number() OVER (PARTITION BY bus0 ORDER BY id) AS rank FROM model_lines)
SELECT a.bus0, CAST(a.rank AS INTEGER) AS rank, a.id, b.b_id FROM a JOIN b ON a.bus0 = b.bus0 AND a.rank = b.rank""")
def rank_pairing(spark, sf):
    a, b = ref_lines(spark, sf).select("id", "bus0"), model_lines(spark, sf).select(F.col("id").alias("b_id"), "bus0")
    return joins.rank_pairs(a, b, "bus0", "id", "b_id").select("bus0", "rank", "id", "b_id")


@query("""
SELECT p.p_partkey AS b_id, arg_max('E' || (l_orderkey % 997), l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber) AS ext_code FROM part p LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def last_writer_code(spark, sf):
    order = F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    code = F.concat(F.lit("E"), (F.col("l_orderkey") % 997).cast("string"))
    last = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("b_id")).agg(F.max_by(code, order).alias("ext_code"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("b_id")).join(last, "b_id", "left")


@query("SELECT a.id, arg_min(m.id, m.id) AS b_id FROM ref_lines a LEFT JOIN model_lines m ON m.a_id = a.id GROUP BY 1")
def first_match_join(spark, sf):
    first = joins.first_by(model_lines(spark, sf).select("a_id", F.col("id").alias("b_id")), "a_id", ["b_id"])
    return ref_lines(spark, sf).select("id").join(first, F.col("id") == F.col("a_id"), "left").select("id", "b_id")


@query("""
, m AS (SELECT p_partkey AS id, p_size / CAST(10.0 AS DOUBLE) AS r FROM part),
one AS (SELECT l_partkey AS b_id, max(l_orderkey) AS a FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) = 1)
SELECT m.id, CASE WHEN a.r IS NOT NULL AND abs(m.r - a.r) > 1e-6 THEN a.r ELSE m.r END AS r, CASE WHEN a.r IS NOT NULL AND abs(m.r - a.r) > 1e-6 THEN 1 ELSE 0 END AS changed
FROM m LEFT JOIN one ON one.b_id = m.id LEFT JOIN ref_lines a ON a.seq = one.a""")
def param_transfer(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("r"))
    links = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("b_id"), F.col("l_orderkey").alias("a_id"))
    refs = ref_lines(spark, sf).select(F.col("seq").alias("id"), "r")
    return matching.transfer(models, links, refs, ("r",))


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS key, CASE WHEN o.o_orderkey IS NOT NULL THEN o.o_orderpriority ELSE c.c_mktsegment END AS value, count(*) AS n
FROM lineitem LEFT JOIN orders o ON o.o_orderkey = l_orderkey * 3 LEFT JOIN customer c ON o.o_orderkey IS NULL AND c.c_custkey = l_orderkey GROUP BY ALL""")
def fallback_key(spark, sf):
    left = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 3).alias("k"), "l_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key1"), F.lit(None).cast("long").alias("key2"), F.col("o_orderpriority").alias("value"))
    c = table(spark, sf, "customer").select(F.lit(None).cast("long").alias("key1"), (F.col("c_custkey") * 3).alias("key2"), F.col("c_mktsegment").alias("value"))
    out = joins.with_fallback_key(left, o.unionByName(c), "k", "key1", "key2", "value")
    return out.groupBy(F.col("l_orderkey").cast("string").alias("key"), "value").agg(F.count(F.lit(1)).alias("n"))


# --- transformers

HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
POINT_SQL = f""", clean AS (SELECT * FROM ref_points WHERE name NOT LIKE 'T\\_%' ESCAPE '\\' AND NOT contains(lower(comment), 'added for coherence')),
coded AS (SELECT a.a_id, b.b_id, a.kv0, a.kv1, b.kv0 AS b_kv0, b.kv1 AS b_kv1, 'ext_code' AS match_type, 1.0::DOUBLE AS confidence FROM clean a JOIN model_points b USING (ext_code)),
rest AS (SELECT * FROM clean WHERE a_id NOT IN (SELECT a_id FROM coded)),
d AS (SELECT a.a_id, b.b_id, b.kv0 AS b_kv0, b.kv1 AS b_kv1, {HAVERSINE} AS km FROM rest a, model_points b),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) AS n FROM d WHERE km < 5.0) WHERE n = 1),
placed AS (SELECT a.a_id, n.b_id, a.kv0, a.kv1, n.b_kv0, n.b_kv1, CASE WHEN n.b_id IS NULL THEN 'none' ELSE 'location' END AS match_type,
  CASE WHEN n.b_id IS NULL THEN 0.0 ELSE greatest(0.0, 1 - km / 5.0) * (0.5 + 0.5 * ((CASE WHEN abs(a.kv0 - n.b_kv0) < 10 THEN 1 ELSE 0 END + CASE WHEN abs(a.kv1 - n.b_kv1) < 10 THEN 1 ELSE 0 END) / 2)) END AS confidence
  FROM rest a LEFT JOIN near n USING (a_id)),
both_ways AS (SELECT * FROM coded UNION ALL SELECT * FROM placed),
scored AS (SELECT *, CASE WHEN (abs(kv0 - b_kv0) < 10 AND abs(kv1 - b_kv1) < 10) OR (abs(kv0 - b_kv1) < 10 AND abs(kv1 - b_kv0) < 10) THEN 1.0
  WHEN abs(kv0 - b_kv0) < 10 OR abs(kv1 - b_kv1) < 10 OR abs(kv0 - b_kv1) < 10 OR abs(kv1 - b_kv0) < 10 THEN 0.5 ELSE 0.0 END AS s FROM both_ways),
refined AS (SELECT a_id, b_id, CASE WHEN b_id IS NOT NULL AND s = 0 THEN 'location_voltage_mismatch' ELSE match_type END AS match_type,
  CASE WHEN b_id IS NULL THEN confidence ELSE greatest(confidence, least(confidence * 1.2, 1.0) * (0.5 + 0.5 * s)) * (CASE WHEN s = 0 THEN 0.5 ELSE 1 END) END AS confidence FROM scored)
"""


@query(POINT_SQL + "SELECT a_id, b_id, match_type, confidence FROM coded")
def tx_ext_code(spark, sf):
    return points.by_code(points.drop_dummies(ref_points(spark, sf)), model_points(spark, sf)).select("a_id", "b_id", "match_type", "confidence")


@query(POINT_SQL + "SELECT a_id, b_id, match_type, round(confidence, 6) AS confidence FROM placed")
def tx_nearest(spark, sf):
    a, b = points.drop_dummies(ref_points(spark, sf)), model_points(spark, sf)
    rest = a.join(points.by_code(a, b).select("a_id"), "a_id", "left_anti")
    return points.by_place(rest, b).select("a_id", "b_id", "match_type", R(F.col("confidence")).alias("confidence"))


@query(POINT_SQL + "SELECT a_id, b_id, match_type, round(confidence, 6) AS confidence FROM refined")
def tx_pipeline(spark, sf):
    return points.link(ref_points(spark, sf), model_points(spark, sf)).select("a_id", "b_id", "match_type", R(F.col("confidence")).alias("confidence"))


@query(POINT_SQL + "SELECT match_type, count(*) AS n, count(DISTINCT b_id) AS used FROM refined GROUP BY 1")
def tx_stats(spark, sf):
    return points.link(ref_points(spark, sf), model_points(spark, sf)).groupBy("match_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b_id").alias("used"))


@query(POINT_SQL + """
, last AS (SELECT b_id, max(a_id) AS a_id FROM refined WHERE b_id IS NOT NULL GROUP BY 1)
SELECT b.b_id, l.a_id, a.r AS ref_r, a.ext_code AS ref_code, coalesce(a.r, b.r) AS r_updated FROM model_points b LEFT JOIN last l USING (b_id) LEFT JOIN ref_points a ON a.a_id = l.a_id""")
def tx_parameters(spark, sf):
    a, b = ref_points(spark, sf), model_points(spark, sf)
    return points.take_parameters(b, points.link(a, b), a).select("b_id", "a_id", "ref_r", "ref_code", "r_updated")


@query("""
, c AS (SELECT ext_code, min(r) AS r FROM ref_points WHERE ext_code IS NOT NULL GROUP BY 1), n AS (SELECT name, min(r) AS r FROM ref_points GROUP BY 1),
b AS (SELECT b_id, ext_code, printf('Customer#%09d', b_id) AS name FROM model_points)
SELECT b_id, coalesce(c.r, n.r) AS ref_r FROM b LEFT JOIN c USING (ext_code) LEFT JOIN n USING (name)""")
def tx_code_then_name(spark, sf):
    b = model_points(spark, sf).select("b_id", "ext_code", F.format_string("Customer#%09d", "b_id").alias("name"))
    return points.take_by_code_then_name(b, ref_points(spark, sf).select("ext_code", "name", "r"), "ext_code", "name", "r").select("b_id", "ref_r")


# --- geometry


@query("SELECT vec_id, round(sum(len), 6) AS degrees, round(sum(len) * 111111.0 * cos(radians(abs(sum(len * (a.y + b.y) / 2) / sum(len)))), 3) AS metres FROM steps GROUP BY 1")
def polyline_length(spark, sf):
    p = F.col("points")
    return polylines(spark, sf).select("vec_id", R(G.length(p)).alias("degrees"), R(G.length_m(p), 3).alias("metres"))


@query("SELECT vec_id, round(sum(len * (a.x + b.x) / 2) / sum(len), 6) AS cx, round(sum(len * (a.y + b.y) / 2) / sum(len), 6) AS cy FROM steps GROUP BY 1")
def centroids(spark, sf):
    c = G.centroid(F.col("points"))
    return polylines(spark, sf).select("vec_id", R(c["x"]).alias("cx"), R(c["y"]).alias("cy"))


@query("""
, e AS (SELECT vec_id, label, points[1] AS s, points[8] AS t FROM polylines),
u AS (SELECT vec_id, label, (t.x - s.x) / sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) AS ux, (t.y - s.y) / sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) AS uy FROM e)
SELECT a.vec_id, b.vec_id AS other, round(abs(a.ux * b.ux + a.uy * b.uy), 6) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id""")
def direction_cos(spark, sf):
    u = polylines(spark, sf).select("vec_id", "label", G.direction(F.col("points")).alias("u"))
    v = u.select(F.col("vec_id").alias("other"), "label", F.col("u").alias("v"))
    return u.join(v, "label").where("vec_id < other").select("vec_id", "other", R(G.abs_cos(F.col("u"), F.col("v"))).alias("cosine"))


@query("""
SELECT vec_id, round(points[1].x, 6) AS x0, round(points[8].y, 6) AS y1, round(round_even(points[1].x / 0.05, 0) * 0.05, 6) + 0.0 AS sx, 'node_' || printf('%.6f', points[1].x) || '_' || printf('%.6f', points[1].y) AS node,
  round(radians(points[1].x) * 6378137.0, 3) AS mx, round(ln(tan(pi() / 4 + radians(points[1].y) / 2)) * 6378137.0, 3) AS my FROM polylines""")
def endpoints(spark, sf):
    s, e = G.start(F.col("points")), G.end(F.col("points"))
    m = G.mercator(s)
    return polylines(spark, sf).select("vec_id", R(s["x"]).alias("x0"), R(e["y"]).alias("y1"), R(G.snap(s, 0.05)["x"]).alias("sx"), G.node_id(s).alias("node"), R(m["x"], 3).alias("mx"), R(m["y"], 3).alias("my"))


HALF = """, seg AS (SELECT vec_id, label, i, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM steps),
vert AS (SELECT vec_id, label, j, points[j + 1].x AS px, points[j + 1].y AS py FROM polylines, range(0, 8) r(j)),
t AS (SELECT v.vec_id, s.vec_id AS other, v.j, px, py, ax, ay, dx, dy, least(1.0, greatest(0.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) AS t
  FROM vert v JOIN seg s ON v.label = s.label AND v.vec_id <> s.vec_id),
m AS (SELECT vec_id, other, j, min(sqrt((px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy))) AS d FROM t GROUP BY ALL),
half AS (SELECT vec_id, other, max(d) AS far, min(d) AS near FROM m GROUP BY ALL)
"""


def _pair_measures(spark, sf, buffer: float, measures: tuple[str, ...], near: bool = True, digits: int | None = None) -> DataFrame:
    p = polylines(spark, sf)
    other = p.select(F.col("vec_id").alias("other"), "label", F.col("points").alias("other_points"))
    return matching.pair_measures(p, other, ["label"], ("vec_id", "other"), ("points", "other_points"), buffer, measures, near, digits)


@query(HALF + "SELECT p.vec_id, p.other, round(greatest(p.far, q.far), 6) AS hausdorff FROM half p JOIN half q ON p.vec_id = q.other AND p.other = q.vec_id WHERE p.vec_id < p.other")
def hausdorff_pairs(spark, sf):
    return _pair_measures(spark, sf, 0.05, ("hausdorff",), near=False).select("vec_id", "other", R(F.col("hausdorff")).alias("hausdorff"))


@query()
def line_in_buffer(spark, sf):
    """Pairs of lines with a share within the buffer; those whose boxes lie farther apart have none."""
    return _pair_measures(spark, sf, 0.05, ("covered",)).select("vec_id", "other", R(F.col("covered")).alias("covered"))


@query()
def iou_pairs(spark, sf):
    return _pair_measures(spark, sf, 0.02, ("iou", "area_share"), digits=4)


@query("""
, s AS (SELECT vec_id, label, points[1].x AS x, points[1].y AS y FROM polylines)
SELECT DISTINCT a.vec_id FROM s a JOIN s b ON a.label <> b.label AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01""")
def near_exists(spark, sf):
    s = G.start(F.col("points"))
    a = polylines(spark, sf).select("vec_id", "label", s["x"].alias("x"), s["y"].alias("y"))
    b = a.select(F.col("label").alias("b_label"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    return joins.cell_join(a, b, ("x", "y"), ("bx", "by"), (0.01, 0.01)).where((F.col("label") != F.col("b_label")) & (d <= 0.01)).select("vec_id").distinct()


@query("""
, s AS (SELECT vec_id, label, points[1].x AS x, points[1].y AS y FROM polylines),
d AS (SELECT a.vec_id, b.vec_id AS node, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM s a, s b WHERE a.vec_id <> b.vec_id AND b.label < 5)
SELECT vec_id, node, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, node) AS rank FROM d WHERE distance < 0.045) WHERE rank <= 10""")
def nearest_nodes(spark, sf):
    return _nearest_nodes(spark, sf, F.col("label") < 5)


def _nearest_nodes(spark, sf, node: Column):
    s = G.start(F.col("points"))
    a = polylines(spark, sf).select("vec_id", "label", s["x"].alias("x"), s["y"].alias("y"))
    b = a.where(node).select(F.col("vec_id").alias("node"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = joins.cell_join(a.select("vec_id", "x", "y"), b, ("x", "y"), ("bx", "by"), (0.045, 0.045)).where("vec_id <> node")
    d = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    ranked = near.withColumn("d", d).where("d < 0.045").withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "node")))
    return ranked.where(F.col("rank") <= T.nearest_kept).select("vec_id", "node", "rank")


@query()
def nearest_nodes_all(spark, sf):
    """Among the nodes of all labels."""
    return _nearest_nodes(spark, sf, F.lit(True))


@query("""
, g AS (SELECT vec_id, label, round(points[1].x, 1) + 0.0 AS x, round(points[1].y, 1) + 0.0 AS y, round(points[8].x, 1) + 0.0 AS u, round(points[8].y, 1) + 0.0 AS v FROM polylines)
SELECT min(vec_id) AS first, count(*) AS members FROM g GROUP BY least({'x': x, 'y': y}, {'x': u, 'y': v}), greatest({'x': x, 'y': y}, {'x': u, 'y': v})""")
def signature_groups(spark, sf):
    sig = G.signature(F.col("points"), 1)
    return polylines(spark, sf).select("vec_id", sig.alias("s")).groupBy("s.a", "s.b").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("members")).select("first", "members")


# --- network

EDGE_SQL = """, ends AS (SELECT least(bus0, bus1) AS u, greatest(bus0, bus1) AS v, id, length_m FROM ref_edges WHERE bus0 IS NOT NULL AND bus1 IS NOT NULL AND bus0 <> bus1),
edge AS (SELECT u, v, max(id) AS id, arg_max(length_m, id) AS weight, count(*) AS parallel FROM ends GROUP BY 1, 2)
"""
REF_EDGES = ", ref_edges AS (SELECT id, bus0, bus1, length_km AS length_m FROM ref_lines)\n"


def _edges(spark, sf):
    return graph.edges(ref_lines(spark, sf), "length_km")


@query(REF_EDGES + EDGE_SQL + "SELECT u, v, id, CASE WHEN weight > 0 THEN weight ELSE 0.001 END AS weight, parallel FROM edge")
def graph_edges(spark, sf):
    return _edges(spark, sf)


@query(REF_EDGES + EDGE_SQL + "SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1")
def node_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(REF_EDGES + EDGE_SQL + """
, both_ways AS (SELECT u, v, weight FROM edge UNION ALL SELECT v, u, weight FROM edge),
walk AS (SELECT u AS source, u AS node, 0.0::DOUBLE AS d, 0 AS hops FROM (SELECT DISTINCT u FROM both_ways WHERE u IN ('N0', 'N1', 'N2'))
  UNION SELECT source, v, min(d + weight), hops + 1 FROM walk JOIN both_ways ON node = u WHERE hops < 8 GROUP BY source, v, hops)
SELECT source, node AS target, round(min(d), 6) AS distance FROM walk WHERE node <> source GROUP BY 1, 2""")
def sssp(spark, sf):
    return _sssp(spark, sf, F.col("target").isin("N0", "N1", "N2"))


def _sssp(spark, sf, start: Column):
    edge = _edges(spark, sf)
    nodes = graph.degrees(edge).select(F.col("node").alias("target"))
    sources = nodes.where(start).select(F.col("target").alias("source"))
    pairs = sources.join(nodes, F.col("source") != F.col("target"))
    return graph.shortest_paths(edge, pairs).select("source", "target", R(F.col("distance")).alias("distance"))


@query()
def sssp_all(spark, sf):
    """From every bus, over any number of steps."""
    return _sssp(spark, sf, F.lit(True))


@query(REF_EDGES + EDGE_SQL + """
, e AS (SELECT id, u AS node FROM edge UNION ALL SELECT id, v FROM edge)
SELECT DISTINCT p.id AS a, q.id AS b FROM e p JOIN e q ON p.node = q.node AND p.id < q.id""")
def edge_neighbours(spark, sf):
    return graph.neighbours(_edges(spark, sf))


# --- linkage passes


def _err(p: str) -> str:
    return f"CASE WHEN a.{p} > 0 AND m.{p} > 0 THEN least(abs(a.{p} - m.{p}) / a.{p}, 1.0) END"


SIM_SQL = f""", sim AS (
  SELECT m.a_id, m.id AS b_id, m.circuits, {KM} / a.length_km AS ratio, list_filter([{_err('r')}, {_err('x')}, {_err('b')}], lambda e: e IS NOT NULL) AS errs
  FROM model_lines m JOIN ref_lines a ON m.a_id = a.id),
scored AS (SELECT *, CASE WHEN len(errs) = 0 THEN 0.5 ELSE greatest(0.0, 1 - list_reduce(list_prepend(0.0, errs), lambda s, e: s + e) / len(errs)) END AS similarity FROM sim)
"""


def _scored(spark, sf):
    a = ref_lines(spark, sf).select(F.col("id").alias("a_id"), F.col("length_km"), *[F.col(c).alias(f"a{c}") for c in "rxb"])
    m = model_lines(spark, sf).select("a_id", F.col("id").alias("b_id"), "circuits", S.to_km(F.col("length_m")).alias("km"), "r", "x", "b").join(a, "a_id")
    similarity = S.electrical_similarity([F.col(f"a{c}") for c in "rxb"], [F.col(c) for c in "rxb"])
    return m.select("a_id", "b_id", "circuits", (F.col("km") / F.col("length_km")).alias("ratio"), similarity.alias("similarity"))


@query(SIM_SQL + "SELECT a_id, b_id, round(similarity, 6) AS similarity FROM scored")
def elec_similarity(spark, sf):
    return _scored(spark, sf).select("a_id", "b_id", R(F.col("similarity")).alias("similarity"))


CAND_SQL = SIM_SQL + """, cand AS (SELECT a_id, b_id, circuits, round(0.35 * similarity + 0.25 * 0.5 + 0.20 * (1 - least(1.0, abs(ratio - 1))) + 0.20 * 0.5, 6) AS score FROM scored WHERE ratio BETWEEN 0.4 AND 2.5)
"""


def _candidates(spark, sf):
    t = _scored(spark, sf).where(F.col("ratio").between(T.ratio_low, T.ratio_high))
    score = matching.path_score(F.lit(1), F.col("similarity"), F.lit(0.5), F.col("ratio"), F.lit(0.5))
    return t.select("a_id", "b_id", "circuits", R(score).alias("score"))


@query(CAND_SQL + "SELECT a_id, b_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS n FROM cand WHERE score > 0.4) WHERE n = 1")
def candidate_score(spark, sf):
    return matching.best_of(_candidates(spark, sf), "a_id", "score", "b_id", 0.4).select("a_id", "b_id", "score")


@query()
def greedy_assign(spark, sf):
    """Reference lines compete for parts, all candidates of a line in turn: the fold under circuit capacity, a connected part of the candidates at a time."""
    m = model_lines(spark, sf).select("a_id", F.concat(F.lit("P"), (F.col("partkey") * 1000 + F.col("suppkey")).cast("string")).alias("b_id"), F.col("length_m").alias("score"), F.lit(1).alias("circuits"))
    cand = m.groupBy("a_id", "b_id", "circuits").agg(F.max("score").alias("score"))
    return matching.assign(cand, matching.candidate_parts(cand), keep=None)


@query("""
SELECT 'demo' AS corridor, id AS a_id, row_number() OVER (ORDER BY id) <= 2 AS matched, row_number() OVER (ORDER BY id) > 2 AS forced_unmatched FROM ref_lines WHERE id IN ('1', '2', '3', '5')""")
def corridor_lock(spark, sf):
    refs = ref_lines(spark, sf)
    models = refs.where(F.col("id").isin("1", "2", "3", "5")).select(F.concat(F.lit("m"), F.col("id")).alias("id"))
    config = {"demo": (2, {a: [f"m{a}"] for a in ("1", "2", "3", "5")})}
    return matching.corridors(spark, refs, models, config).select("corridor", "a_id", "matched", "forced_unmatched")


GROUP_SQL = MATCH_SQL + """, l AS (SELECT a_id, CAST(seq % 500 AS VARCHAR) AS g, n > 2 AS matched, n, km / ref_km AS ratio, CASE WHEN seq % 3 = 0 THEN 'Excellent Match' WHEN seq % 3 = 1 THEN 'Good Match' ELSE 'Poor Match' END AS q FROM links),
p AS (SELECT *, 10 * n + CASE WHEN ratio BETWEEN 0.9 AND 1.1 THEN 20 WHEN ratio BETWEEN 0.8 AND 1.2 THEN 15 WHEN ratio BETWEEN 0.7 AND 1.3 THEN 10 WHEN ratio BETWEEN 0.5 AND 1.5 THEN 5 ELSE 0 END +
  CASE WHEN q LIKE 'Excellent%' THEN 15 WHEN q LIKE 'Good%' THEN 10 ELSE 0 END AS pts FROM l),
best AS (SELECT g, n AS best_n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pts DESC, a_id) AS k FROM p WHERE matched) WHERE k = 1)
"""


@query(GROUP_SQL + "SELECT a_id, g AS parallel_group, matched OR best_n IS NOT NULL AS matched, NOT matched AND best_n IS NOT NULL AS is_copy, CAST(CASE WHEN NOT matched AND best_n IS NOT NULL THEN best_n ELSE n END AS INTEGER) AS ids FROM p LEFT JOIN best USING (g)")
def parallel_propagate(spark, sf):
    t = _links(spark, sf)
    q = F.when(F.col("seq") % 3 == 0, "Excellent Match").when(F.col("seq") % 3 == 1, "Good Match").otherwise("Poor Match")
    links = t.select("a_id", (F.col("seq") % 500).cast("string").alias("parallel_group"), (F.col("n") > 2).alias("matched"), F.coalesce("b_ids", F.array().cast("array<string>")).alias("b_ids"), (F.col("km") / F.col("ref_km")).alias("ratio"), q.alias("quality"))
    return matching.spread_in_groups(links).select("a_id", "parallel_group", "matched", "is_copy", F.size("b_ids").alias("ids"))


@query("""
, m AS (SELECT id, partkey, kv, regexp_extract(id, 'relation/[0-9]+(.*)', 1) AS suffix FROM model_lines)
SELECT p.id AS own, q.id AS b_id, p.suffix, 0.9::DOUBLE AS score FROM m p JOIN m q ON p.suffix = q.suffix AND p.partkey <> q.partkey AND ((p.kv = 220 AND q.kv = 220) OR (p.kv IN (380, 400) AND q.kv IN (380, 400)))""")
def pattern_parallel(spark, sf):
    m = model_lines(spark, sf)
    return matching.by_pattern(m.select("a_id", "id", "kv"), m.select("id", "kv")).select("own", "b_id", "suffix", R(F.col("score"), 1).alias("score"))


@query(MATCH_SQL + """
, h AS (SELECT CAST(k AS VARCHAR) AS a_id FROM range(1, 60) r(k) WHERE k % 4 = 1)
SELECT coalesce(l.a_id, h.a_id) AS a_id, h.a_id IS NOT NULL OR coalesce(l.n > 0, false) AS matched, h.a_id IS NOT NULL AS manual FROM links l FULL JOIN h ON l.a_id = h.a_id""")
def manual_override(spark, sf):
    manual = spark.range(1, 60).where("id % 4 = 1").select(F.col("id").cast("string").alias("a_id"), F.array(F.lit("by-hand")).alias("b_ids"))
    links = _links(spark, sf).select("a_id", "b_ids", (F.col("n") > 0).alias("matched"))
    return matching.override(links, manual).select("a_id", "matched", "manual")


@query(MATCH_SQL + "SELECT a_id, n > 0 AND seq % 7 <> 0 AS matched FROM links")
def missing_fill(spark, sf):
    links = _links(spark, sf).where("n > 0").select("a_id", "b_ids", F.lit(True).alias("matched"))
    full = matching.fill_missing(links, ref_lines(spark, sf))
    never = ref_lines(spark, sf).where("seq % 7 = 0").select(F.col("id").alias("a_id"))
    return matching.forbid(full, never).select("a_id", "matched")


@query(f"""
, t AS (SELECT m.id, m.a_id, m.r AS original, a.r AS allocated, a.r / nullif(a.length_km, 0) / m.circuits AS ref_per_km, m.r / nullif({KM}, 0) AS own_per_km FROM model_lines m JOIN ref_lines a ON m.a_id = a.id),
d AS (SELECT *, CASE WHEN abs(original) >= 1e-9 THEN round(100 * (allocated - original) / abs(original), 6) + 0.0 END AS diff, CASE WHEN abs(own_per_km) >= 1e-9 THEN round(100 * (ref_per_km - own_per_km) / abs(own_per_km), 6) + 0.0 END AS diff_km FROM t)
SELECT id, a_id, diff, diff_km, CASE WHEN diff IS NULL THEN 'undefined' WHEN abs(diff) <= 20 THEN 'good' WHEN diff > 50 THEN 'above-50' WHEN diff < -50 THEN 'below-50' WHEN diff > 20 THEN 'above-20' ELSE 'below-20' END AS bin FROM d""")
def param_compare(spark, sf):
    a = ref_lines(spark, sf).select(F.col("id").alias("a_id"), F.col("r").alias("ar"), "length_km")
    m = model_lines(spark, sf).select("id", "a_id", "r", "circuits", S.to_km(F.col("length_m")).alias("km")).join(a, "a_id")
    diff = R(S.pct_or_null(F.col("ar"), F.col("r")))
    per_km = R(S.pct_or_null(S.safe_div(F.col("ar"), F.col("length_km")) / F.col("circuits"), S.safe_div(F.col("r"), F.col("km"))))
    return m.select("id", "a_id", diff.alias("diff"), per_km.alias("diff_km"), S.diff_bin(diff).alias("bin"))


@query(MATCH_SQL + """
, f AS (SELECT a_id, seq % 10 = 0 AS dup, is_parallel AS par, seq % 9 = 0 AS geo, n > 0 AS ok, kv FROM links)
SELECT CASE WHEN dup THEN 'duplicate' WHEN par THEN 'parallel' WHEN geo THEN 'geometric' WHEN ok THEN 'matched' ELSE 'unmatched' END AS status,
  CASE WHEN kv >= 100 AND kv < 200 THEN '110kV' WHEN kv >= 200 AND kv < 300 THEN '220kV' WHEN kv >= 300 THEN '400kV' ELSE 'other' END AS class, count(*) AS n FROM f GROUP BY ALL""")
def feature_status(spark, sf):
    t = _links(spark, sf)
    status = S.first_true((F.col("seq") % 10 == 0, "duplicate"), (F.col("is_parallel"), "parallel"), (F.col("seq") % 9 == 0, "geometric"), (F.col("n") > 0, "matched"), default="unmatched")
    return t.groupBy(status.alias("status"), S.kv_class(F.col("kv"), F.lit(False)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(MATCH_SQL + "SELECT a_id, n, round(km / ref_km, 6) AS ratio FROM links WHERE seq % 13 = 0 AND n > 0")
def sample_check(spark, sf):
    return _links(spark, sf).where("seq % 13 = 0 and n > 0").select("a_id", "n", R(F.col("km") / F.col("ref_km")).alias("ratio"))


@query("SELECT a.id, count(DISTINCT b.id) AS nodes FROM ref_lines a JOIN (SELECT DISTINCT bus0 AS id FROM model_lines) b ON contains(b.id, a.bus0) GROUP BY 1")
def bus_name_join(spark, sf):
    nodes = model_lines(spark, sf).select(F.col("bus0").alias("node")).distinct()
    # Names meet the pieces of names, the lines join by equality.
    names = ref_lines(spark, sf).select("bus0").distinct()
    hits = joins.containing(names, nodes, "bus0", "node").groupBy("bus0").agg(F.count(F.lit(1)).alias("nodes"))
    return ref_lines(spark, sf).select("id", "bus0").join(hits, "bus0").select("id", "nodes")


# --- later passes


PASS_SQL = f""", t AS (
  SELECT m.id, (m.partkey % 8) / CAST(8.0 AS DOUBLE) AS overlap, (m.number % 3) / CAST(2.0 AS DOUBLE) AS ends, (m.suppkey % 16) / CAST(16.0 AS DOUBLE) AS cosine, 1 + m.number AS vertices, m.suppkey * 90.0 AS apart,
    CASE WHEN a.length_km > 0 AND {KM} > 0 THEN least(a.length_km, {KM}) / greatest(a.length_km, {KM}) ELSE 0.0 END AS ratio, {KM} < 0.7 * a.length_km AS piece
  FROM model_lines m JOIN ref_lines a ON m.a_id = a.id)
"""


@query(PASS_SQL + """
SELECT id, round(0.5 * overlap + 0.3 * ends + 0.2 * cosine, 6) AS visual, round(0.7 * overlap + 0.3 * ratio, 6) AS parallel,
  round(CASE WHEN vertices <= 3 THEN 0.60 * cosine + 0.35 * ratio + 0.05 * overlap + CASE WHEN ratio >= 0.9 THEN 0.1 ELSE 0 END + CASE WHEN piece AND cosine > 0.9 THEN 0.1 ELSE 0 END
    ELSE 0.45 * cosine + 0.30 * ratio + 0.25 * overlap END, 6) AS coarse,
  round(0.6 * (1 - least(1.0, abs(ratio - 1))) + 0.4 * greatest(0.0, 1 - CAST(apart AS DOUBLE) / 5000), 6) AS bus FROM t""")
def pass_scores(spark, sf):
    a = ref_lines(spark, sf).select(F.col("id").alias("a_id"), "length_km")
    m = model_lines(spark, sf).select("id", "a_id", "partkey", "suppkey", "number", S.to_km(F.col("length_m")).alias("km")).join(a, "a_id")
    overlap, ends, cosine = (F.col("partkey") % 8) / 8.0, (F.col("number") % 3) / 2.0, (F.col("suppkey") % 16) / 16.0
    ratio = passes.length_ratio(F.col("length_km"), F.col("km"))
    coarse = passes.simple_score(1 + F.col("number"), overlap, ratio, cosine, F.col("km") < 0.7 * F.col("length_km"))
    bus = passes.bus_score(ratio, F.col("suppkey") * 90.0, T.bus_tolerance_m)
    return m.select("id", R(passes.visual_score(overlap, ends, cosine)).alias("visual"), R(passes.parallel_score(overlap, ratio)).alias("parallel"), R(coarse).alias("coarse"), R(bus).alias("bus"))


@query("""
, g AS (SELECT a_id, 'p' || (partkey % 5) AS pattern, avg((partkey % 8) / CAST(8.0 AS DOUBLE)) * (1 + 0.5 * sum(CASE WHEN number % 2 = 0 THEN 1 ELSE 0 END) / count(*)) AS score, string_agg(DISTINCT id, ';' ORDER BY id) AS b_ids
  FROM model_lines GROUP BY 1, 2)
SELECT a_id, pattern, round(score, 6) AS score, b_ids FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, pattern) AS n FROM g WHERE score > 0.6) WHERE n = 1""")
def pattern_groups(spark, sf):
    pattern = F.concat(F.lit("p"), (F.col("partkey") % 5).cast("string"))
    found = model_lines(spark, sf).select("a_id", F.col("id").alias("b_id"), pattern.alias("pattern"), ((F.col("partkey") % 8) / 8.0).alias("similarity"), (F.col("number") % 2 == 0).alias("same_circuit"))
    return passes.pattern_groups(found).select("a_id", "pattern", R(F.col("score")).alias("score"), F.array_join("b_ids", ";").alias("b_ids"))


def _shifted(by: float, every: int) -> Column:
    return F.transform("points", lambda p: F.struct((p["x"] + by * (F.col("vec_id") % every)).alias("x"), p["y"].alias("y")))


@query("""
, s AS (SELECT vec_id, 'm' || vec_id AS b_id, points[1].x AS x, points[1].y AS y, points[8].x AS u, points[8].y AS v, points[1].x + CAST(0.003 AS DOUBLE) * (vec_id % 10) AS sx, points[8].x + CAST(0.003 AS DOUBLE) * (vec_id % 10) AS su FROM polylines),
len AS (SELECT vec_id, round(sum(len), 3) AS length FROM steps GROUP BY 1),
ends AS (SELECT s.*, length, {'x': round(x, 3) + 0.0, 'y': round(y, 3) + 0.0} AS p, {'x': round(u, 3) + 0.0, 'y': round(v, 3) + 0.0} AS q, {'x': round(sx, 3) + 0.0, 'y': round(y, 3) + 0.0} AS sp, {'x': round(su, 3) + 0.0, 'y': round(v, 3) + 0.0} AS sq FROM s JOIN len USING (vec_id)),
a AS (SELECT vec_id, least(p, q) AS a, greatest(p, q) AS b, length FROM ends WHERE vec_id % 2 = 0),
m AS (SELECT b_id, least(sp, sq) AS a, greatest(sp, sq) AS b, length FROM ends WHERE vec_id % 3 < 1 + vec_id % 2)
SELECT a.vec_id, min(b_id) AS b_id FROM a JOIN m ON abs(a.a.x - m.a.x) < 0.02 AND abs(a.a.y - m.a.y) < 0.02 AND abs(a.b.x - m.b.x) < 0.02 AND abs(a.b.y - m.b.y) < 0.02
  AND greatest(a.length, m.length) > 0 AND abs(a.length - m.length) / greatest(a.length, m.length) < 0.1 GROUP BY 1""")
def late_signatures(spark, sf):
    return _late_signatures(spark, sf, F.col("vec_id") % 2 == 0)


def _late_signatures(spark, sf, chosen: Column):
    p = polylines(spark, sf)
    left = p.where(chosen).select(F.col("vec_id").alias("a_id"), G.signature(F.col("points")).alias("sig"))
    models = p.select(F.concat(F.lit("m"), F.col("vec_id")).alias("b_id"), G.signature(_shifted(0.003, 10)).alias("b_sig"), (1 + F.col("vec_id") % 2).alias("circuits"))
    used = p.where("vec_id % 3 > 0").select(F.concat(F.lit("m"), F.col("vec_id")).alias("b_id"), (F.col("vec_id") % 3).alias("used"))
    return passes.late_signatures(left, models, used).select(F.col("a_id").alias("vec_id"), "b_id")


@query()
def late_signatures_all(spark, sf):
    """For all reference lines."""
    return _late_signatures(spark, sf, F.lit(True))


def _sides(spark, sf, whole: bool = False):
    """Reference lines, of two to eight points or whole, and shifted copies of them as the model."""
    p = polylines(spark, sf).withColumn("kv", F.when(F.col("label") % 2 == 0, 380.0).otherwise(220.0))
    p = p if whole else p.withColumn("points", F.slice("points", 1, 2 + F.col("vec_id").cast("int") % 7))
    km = G.length(F.col("points")) * G.KM_PER_DEGREE
    refs = p.select(F.col("vec_id").cast("string").alias("a_id"), "kv", "points", km.alias("km"), (F.col("vec_id") % 50).cast("string").alias("parallel_group"))
    models = p.select(F.concat(F.lit("m"), F.col("vec_id")).alias("b_id"), "kv", _shifted(0.002, 4).alias("points"), km.alias("km"))
    return refs, models


def _rounded(links: DataFrame) -> DataFrame:
    return links.select("a_id", "b_id", R(F.col("score")).alias("score"))


@query()
def visual_pass(spark, sf):
    return _rounded(passes.visual(*_sides(spark, sf)))


@query()
def simple_pass(spark, sf):
    return _rounded(passes.simple(*_sides(spark, sf)))


@query()
def parallel_pass(spark, sf):
    return _parallel(*_sides(spark, sf))


def _parallel(refs: DataFrame, models: DataFrame) -> DataFrame:
    used = refs.select("parallel_group", F.concat(F.lit("m"), F.col("a_id")).alias("b_id")).where(F.col("a_id").cast("long") % 4 == 0)
    return _rounded(passes.parallel(refs, models, used))


@query()
def visual_pass_whole(spark, sf):
    """Over whole lines; the simple pass takes none of these, which have eight points."""
    return _rounded(passes.visual(*_sides(spark, sf, whole=True)))


@query()
def parallel_pass_whole(spark, sf):
    return _parallel(*_sides(spark, sf, whole=True))


@query()
def bus_paths(spark, sf):
    """Paths between the buses of reference lines over their own network; an edge is drawn as one step between its buses' places."""
    place = lambda c: F.struct((F.substring(c, 2, 9).cast("double") / 10).alias("x"), (F.substring(c, 2, 9).cast("double") % 7).alias("y"))
    lines = ref_lines(spark, sf).where("bus0 <> bus1").withColumn("points", F.array(place("bus0"), place("bus1")))
    kv = lines.select(F.col("id"), "kv")
    edge = graph.edges(lines, "length_km").join(kv, "id").withColumn("points", F.array(place("u"), place("v")))
    refs = lines.select(F.col("id").alias("a_id"), F.col("bus0").alias("source"), F.col("bus1").alias("target"), "kv", F.col("length_km").alias("km"), "points")
    return passes.bus_paths(refs, edge).select("a_id", F.array_join("b_ids", ";").alias("b_ids"), R(F.col("ratio")).alias("ratio"), R(F.col("score")).alias("score"))


# --- paths between ends, allocation, samples and logs

NEAR_ENDS = """, nodes AS (SELECT 'node_' || printf('%.6f', p.x) || '_' || printf('%.6f', p.y) AS node, min(p.x) AS x, min(p.y) AS y FROM (SELECT unnest([points[1], points[8]]) AS p FROM polylines) GROUP BY 1),
ends AS (SELECT vec_id, 0 AS side, points[1].x AS x, points[1].y AS y FROM polylines UNION ALL SELECT vec_id, 1, points[8].x, points[8].y FROM polylines),
near AS (SELECT vec_id, side, node, sqrt((e.x - n.x) * (e.x - n.x) + (e.y - n.y) * (e.y - n.y)) AS d FROM ends e, nodes n),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, side ORDER BY d, node) AS rank FROM near WHERE d < CAST(5.0 AS DOUBLE) / 111.0) WHERE rank <= 5)
"""


@query(NEAR_ENDS + "SELECT s.vec_id, s.node AS source, t.node AS target FROM first s JOIN first t ON s.vec_id = t.vec_id AND s.side = 0 AND t.side = 1 AND s.node <> t.node")
def path_end_pairs(spark, sf):
    """The nodes between which paths are looked for: five near either end."""
    lines = polylines(spark, sf).select(F.col("vec_id").alias("a_id"), "points")
    return paths.end_pairs(lines, paths.nodes(lines)).select(F.col("a_id").alias("vec_id"), "source", "target")


@query()
def path_candidates(spark, sf):
    """Paths through the network of shifted lines for whole lines; tests/test_linkage.py holds their scores."""
    refs, models = _sides(spark, sf, whole=True)
    none = [F.lit(None).cast("double").alias(c) for c in "rxb"]
    found = paths.candidates(refs.select("a_id", "kv", "points", "km", *none), models.select("b_id", "kv", "points", "km", F.lit(1).alias("circuits"), *none))
    return found.select("a_id", F.array_join("b_ids", ";").alias("b_ids"), "segments", R(F.col("ratio")).alias("ratio"), R(F.col("score")).alias("score"))


@query("""
, p AS (SELECT a.id AS a_id, source, target, d FROM (SELECT a_id AS id, id AS source, 'T' || number AS target, length_m / 1000 AS d FROM model_lines) q JOIN ref_lines a USING (id))
SELECT a_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT a_id, source, row_number() OVER (PARTITION BY a_id ORDER BY abs(d - length_km), source, target) AS rank FROM p JOIN ref_lines r ON r.id = p.a_id) WHERE rank <= 5""")
def closest_paths(spark, sf):
    """Of the paths of a line the five whose length is closest to its own."""
    p = model_lines(spark, sf).select("a_id", F.col("id").alias("source"), F.concat(F.lit("T"), F.col("number").cast("string")).alias("target"), (F.col("length_m") / 1000).alias("distance"))
    wanted = ref_lines(spark, sf).select(F.col("id").alias("a_id"), "length_km")
    return graph.paths_by_length(p.join(wanted, "a_id"), "length_km", T.pairs_tried).select("a_id", "source", "rank")


def _segments(spark, sf):
    status = F.when(F.col("number") % 4 == 0, "Parallel Circuit").when(F.col("number") % 4 == 1, "Not Applied").otherwise("Applied")
    return model_lines(spark, sf).select("a_id", F.col("id").alias("b_id"), status.alias("status"), S.to_km(F.col("length_m")).alias("km"), "r", "x", "number", "partkey", "suppkey", "circuits")


def _totals(spark, sf):
    return ref_lines(spark, sf).select(F.col("id").alias("a_id"), "length_km", "r", "x", "b")


COPIED = ", seg AS (SELECT *, CASE WHEN number % 4 = 0 THEN 'Parallel Circuit' WHEN number % 4 = 1 THEN 'Not Applied' ELSE 'Applied' END AS status FROM model_lines)\n"


@query(COPIED + """SELECT m.a_id, m.id AS b_id, status, a.r AS allocated_r, a.x AS allocated_x, a.b AS allocated_b, round(a.r / nullif(a.length_km, 0), 9) AS r_per_km, round(a.x / nullif(a.length_km, 0), 9) AS x_per_km, round(a.b / nullif(a.length_km, 0), 9) AS b_per_km
FROM seg m JOIN ref_lines a ON m.a_id = a.id WHERE status IN ('Applied', 'Parallel Circuit')""")
def allocate_copied(spark, sf):
    """Totals on every segment unscaled, where they were applied."""
    t = A.applied(A.copy_totals(_segments(spark, sf).select("a_id", "b_id", "status"), _totals(spark, sf)))
    return t.select("a_id", "b_id", "status", *[f"allocated_{c}" for c in "rxb"], *[R(F.col(f"{c}_per_km"), 9).alias(f"{c}_per_km") for c in "rxb"])


@query(f"SELECT a_id, round(sum(r * {KM}) / sum({KM}), 6) AS mean_r, round(sum(x * {KM}) / sum({KM}), 6) AS mean_x, count(*) AS segments FROM model_lines WHERE {KM} > 0 GROUP BY 1")
def path_means(spark, sf):
    t = A.weighted_means(_segments(spark, sf))
    return t.select("a_id", R(F.col("mean_r")).alias("mean_r"), R(F.col("mean_x")).alias("mean_x"), "segments")


def _sample(spark, sf):
    t = _scored(spark, sf).join(_segments(spark, sf).select("b_id", "partkey"), "b_id")
    overlap = (F.col("partkey") % 8) / 8.0
    return t.select("a_id", "b_id", "ratio", overlap.alias("overlap"), "similarity", R(A.sample_score(F.col("ratio"), overlap, F.col("similarity"))).alias("score"))


SAMPLE_SQL = SIM_SQL + """, sample AS (
  SELECT s.a_id, s.b_id, ratio, (partkey % 8) / CAST(8.0 AS DOUBLE) AS overlap, similarity, round(0.4 * (1 - least(1.0, abs(ratio - 1))) + 0.4 * ((partkey % 8) / CAST(8.0 AS DOUBLE)) + 0.2 * similarity, 6) AS score
  FROM scored s JOIN model_lines m ON m.id = s.b_id)
"""


@query(SAMPLE_SQL + "SELECT a_id, b_id, score FROM sample")
def sample_scores(spark, sf):
    return _sample(spark, sf).select("a_id", "b_id", "score")


@query(SAMPLE_SQL + """
SELECT CASE WHEN score >= 0.85 THEN 'Excellent' WHEN score >= 0.7 THEN 'Good' WHEN score >= 0.5 THEN 'Fair' ELSE 'Poor' END AS rating, count(*) AS links,
  round(avg(overlap), 6) AS avg_overlap, round(avg(similarity), 6) AS avg_similarity, round(avg(score), 6) AS avg_score FROM sample GROUP BY 1""")
def sample_report(spark, sf):
    t = A.sample_report(_sample(spark, sf), ("overlap", "similarity"))
    return t.select("rating", "links", *[R(F.col(f"avg_{c}")).alias(f"avg_{c}") for c in ("overlap", "similarity", "score")])


@query("""
, l AS (SELECT l_partkey AS b_id, CAST(l_orderkey AS VARCHAR) AS a_id, CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN 'Good Match' END AS q FROM lineitem),
o AS (SELECT DISTINCT b_id, a_id, max(q) AS quality FROM l GROUP BY b_id, a_id)
SELECT b_id, string_agg(a_id, ';' ORDER BY a_id) AS a_ids, arg_min(quality, a_id) FILTER (coalesce(quality, '') <> '') AS quality FROM o GROUP BY 1""")
def model_users(spark, sf):
    n = F.col("l_linenumber") % 3
    links = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("b_id"), F.col("l_orderkey").cast("string").alias("a_id"), F.when(n == 0, "").when(n == 1, "Good Match").alias("quality"))
    return A.users_of(links.groupBy("b_id", "a_id").agg(F.max("quality").alias("quality"))).select("b_id", F.array_join("a_ids", ";").alias("a_ids"), "quality")


@query(f"""
, m AS (SELECT id AS b_id, a_id, {KM} AS km, number, 'P' || partkey AS part, 1 + partkey % 4 AS circuits FROM model_lines),
l AS (SELECT a_id, part AS b_id, max(km) AS score, sum(km) AS km, min(number) % 2 = 0 AS is_parallel, any_value(circuits) AS circuits FROM m GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY is_parallel DESC, score DESC, a_id) AS rank FROM l),
s AS (SELECT a_id, string_agg(b_id, ';' ORDER BY b_id) AS b_ids, count(*) AS n FROM k WHERE rank <= circuits GROUP BY 1)
SELECT a.id AS a_id, coalesce(b_ids, '') AS b_ids, n IS NOT NULL AS matched, round(n * 2.5 / a.length_km, 6) AS ratio FROM ref_lines a JOIN (SELECT DISTINCT a_id FROM l) q ON q.a_id = a.id LEFT JOIN s ON s.a_id = a.id""")
def capacity_enforced(spark, sf):
    """Links of a line to parts: parts beyond their circuits leave it, its ratio follows."""
    part = F.concat(F.lit("P"), F.col("partkey").cast("string"))
    use = _segments(spark, sf).groupBy("a_id", part.alias("b_id")).agg(F.max("km").alias("score"), (F.min("number") % 2 == 0).alias("is_parallel"))
    models = _segments(spark, sf).select(part.alias("b_id"), F.lit(2.5).alias("b_km"), (1 + F.col("partkey") % 4).alias("circuits")).distinct()
    out = A.enforce_capacity(use, models, _totals(spark, sf).select("a_id", F.col("length_km").alias("km")))
    return out.select("a_id", F.array_join("b_ids", ";").alias("b_ids"), "matched", R(F.col("ratio")).alias("ratio"))


@query("""
, s AS (SELECT vec_id, label, 'm' || vec_id AS b_id, points[1].x AS x, points[1].y AS y, points[8].x AS u, points[8].y AS v, points[1].x + CAST(0.003 AS DOUBLE) * (vec_id % 10) AS sx, points[8].x + CAST(0.003 AS DOUBLE) * (vec_id % 10) AS su FROM polylines),
len AS (SELECT vec_id, round(sum(len), 3) + 0.0 AS length FROM steps GROUP BY 1),
ends AS (SELECT s.*, length, {'x': round(x, 3) + 0.0, 'y': round(y, 3) + 0.0} AS p, {'x': round(u, 3) + 0.0, 'y': round(v, 3) + 0.0} AS q, {'x': round(sx, 3) + 0.0, 'y': round(y, 3) + 0.0} AS sp, {'x': round(su, 3) + 0.0, 'y': round(v, 3) + 0.0} AS sq FROM s JOIN len USING (vec_id)),
a AS (SELECT vec_id, label, least(p, q) AS a, greatest(p, q) AS b, length FROM ends), m AS (SELECT b_id, label, least(sp, sq) AS a, greatest(sp, sq) AS b, length FROM ends),
exact AS (SELECT vec_id, min(b_id) AS b_id, CAST(0.0 AS DOUBLE) AS gap FROM a JOIN m ON a.label = m.label AND a.a = m.a AND a.b = m.b AND a.length = m.length GROUP BY 1),
close AS (SELECT vec_id, b_id, round(abs(a.length - m.length), 9) AS gap FROM a JOIN m ON a.label = m.label AND greatest(abs(a.a.x - m.a.x), abs(a.a.y - m.a.y)) < 0.01 AND greatest(abs(a.b.x - m.b.x), abs(a.b.y - m.b.y)) < 0.01 WHERE vec_id NOT IN (SELECT vec_id FROM exact)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gap, b_id) AS n FROM close) WHERE n = 1)
SELECT vec_id, b_id, gap FROM exact UNION ALL SELECT vec_id, b_id, gap FROM best""")
def signature_join(spark, sf):
    p = polylines(spark, sf)
    a = p.select(F.col("vec_id").alias("a_id"), F.col("label").alias("kind"), G.signature(F.col("points")).alias("sig"))
    b = p.select(F.concat(F.lit("m"), F.col("vec_id")).alias("b_id"), F.col("label").alias("kind"), G.signature(_shifted(0.003, 10)).alias("b_sig"))
    return matching.by_signature(a, b, T.signature_near).select(F.col("a_id").alias("vec_id"), "b_id", R(F.col("gap"), 9).alias("gap"))


@query("""
, m AS (SELECT 'relation/' || p_partkey || '-' || (p_partkey % 9) || (p_size % 3) AS id, CAST(p_partkey AS VARCHAR) AS pattern, '-' || (p_partkey % 9) || (p_size % 3) AS suffix, CAST(([220, 380, 400])[p_partkey % 3 + 1] AS DOUBLE) AS kv, p_partkey FROM part)
SELECT DISTINCT 'g' || (a.p_partkey % 7) AS parallel_group, b.id AS b_id, b.pattern, a.suffix FROM m a JOIN m b ON contains(b.id, a.suffix) AND NOT contains(b.id, a.pattern) AND ((a.kv = 220 AND b.kv = 220) OR (a.kv IN (380, 400) AND b.kv IN (380, 400)))""")
def contained_suffix(spark, sf):
    k = F.col("p_partkey")
    m = table(spark, sf, "part").select(k, F.concat(F.lit("relation/"), k.cast("string"), F.lit("-"), (k % 9).cast("string"), (F.col("p_size") % 3).cast("string")).alias("id"), F.element_at(F.array(F.lit(220.0), F.lit(380.0), F.lit(400.0)), (k % 3 + 1).cast("int")).alias("kv"))
    linked = m.select(F.concat(F.lit("g"), (k % 7).cast("string")).alias("parallel_group"), "id", "kv")
    return matching.by_contained_suffix(linked, m.select(F.col("id").alias("b_id"), "kv"))


EDGE_RING = [(-0.02, -0.02), (0.02, -0.01), (0.024, 0.02), (-0.01, 0.024)]


def _meets_sql() -> str:
    inside = " + ".join(f"CASE WHEN (({y1} > p.y) <> ({y2} > p.y)) AND p.x < ({x2 - x1}) * (p.y - ({y1})) / ({y2 - y1}) + ({x1}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(EDGE_RING, EDGE_RING[1:] + EDGE_RING[:1], strict=True))
    edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(EDGE_RING, EDGE_RING[1:] + EDGE_RING[:1], strict=True))
    return f"""
, e(ax, ay, cx, cy) AS (VALUES {edges}), v AS (SELECT vec_id, unnest(points) AS p FROM polylines),
i AS (SELECT vec_id FROM v WHERE ({inside}) % 2 = 1),
c AS (SELECT vec_id FROM steps s, e WHERE ((cx - ax) * (a.y - ay) - (cy - ay) * (a.x - ax)) * ((cx - ax) * (b.y - ay) - (cy - ay) * (b.x - ax)) < 0
  AND ((b.x - a.x) * (ay - a.y) - (b.y - a.y) * (ax - a.x)) * ((b.x - a.x) * (cy - a.y) - (b.y - a.y) * (cx - a.x)) < 0)
SELECT vec_id FROM i UNION SELECT vec_id FROM c"""


@query(_meets_sql())
def lines_meeting_boundary(spark, sf):
    return polylines(spark, sf).where(G.meets(F.col("points"), EDGE_RING)).select("vec_id")


@query("SELECT s_suppkey AS id, n AS part, CAST(s_suppkey + n AS DOUBLE) AS x0, CAST(2 AS INTEGER) AS vertices FROM supplier, range(0, 3) r(n) WHERE n <= s_suppkey % 3")
def parts_of_lines(spark, sf):
    from lineweave.sources.readers import explode_parts

    k = F.col("s_suppkey")
    part = lambda n: F.concat(F.lit("("), (k + n).cast("string"), F.lit(" 1, 5 "), k.cast("string"), F.lit(")"))
    text = F.concat(F.lit("MULTILINESTRING("), F.concat_ws(", ", part(0), F.when(k % 3 >= 1, part(1)), F.when(k % 3 >= 2, part(2))), F.lit(")"))
    lines = table(spark, sf, "supplier").select(k.alias("id"), G.parse_wkt(text).alias("parts"))
    return explode_parts(lines).select("id", BIG(F.col("part")).alias("part"), F.col("points")[0]["x"].alias("x0"), F.size("points").alias("vertices"))


@query(f"SELECT id, kv, CAST(row_number() OVER (PARTITION BY kv ORDER BY {KM} DESC, id) AS INTEGER) AS place FROM model_lines")
def models_by_size(spark, sf):
    return A.by_size(model_lines(spark, sf).select("id", "kv", S.to_km(F.col("length_m")).alias("km"))).select("id", "kv", "place")


@query("SELECT round(min(p.x), 6) AS x0, round(min(p.y), 6) AS y0, round(max(p.x), 6) AS x1, round(max(p.y), 6) AS y1 FROM (SELECT unnest(points) AS p FROM polylines)")
def total_bounds(spark, sf):
    return A.total_bounds(polylines(spark, sf)).select(*[R(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _transferred(spark, sf):
    each = model_lines(spark, sf).groupBy("id", "a_id").agg(*[F.max(c).alias(c) for c in "rxb"])
    models, links = each.select("id", "r", "x", "b"), each.select(F.col("id").alias("b_id"), "a_id")
    return models, matching.transfer(models, links, _totals(spark, sf).withColumnRenamed("a_id", "id"))


EACH_MODEL = ", each AS (SELECT id, a_id, max(r) AS r, max(x) AS x, max(b) AS b FROM model_lines GROUP BY 1, 2)\n"


@query(EACH_MODEL + """
SELECT m.id, CASE WHEN abs(m.r - a.r) > 1e-6 THEN a.r ELSE m.r END AS r, CASE WHEN abs(m.x - a.x) > 1e-6 THEN a.x ELSE m.x END AS x, CASE WHEN abs(m.b - a.b) > 1e-6 THEN a.b ELSE m.b END AS b,
  CAST(abs(m.r - a.r) > 1e-6 AS INTEGER) + CAST(abs(m.x - a.x) > 1e-6 AS INTEGER) + CAST(abs(m.b - a.b) > 1e-6 AS INTEGER) AS changed FROM each m JOIN ref_lines a ON m.a_id = a.id""")
def param_transfer_all(spark, sf):
    return _transferred(spark, sf)[1]


@query(EACH_MODEL + """
, c AS (SELECT m.id, unnest([{'column': 'r', 'old': m.r, 'new': a.r}, {'column': 'x', 'old': m.x, 'new': a.x}, {'column': 'b', 'old': m.b, 'new': a.b}]) AS v FROM each m JOIN ref_lines a ON m.a_id = a.id)
SELECT id, v['column'] AS "column", v['old'] AS old, v['new'] AS new FROM c WHERE abs(v['old'] - v['new']) > 1e-6""")
def change_log(spark, sf):
    old, new = _transferred(spark, sf)
    return A.change_log(old, new, "id", ("r", "x", "b"))


@query(f"""
, t AS (SELECT m.id, m.circuits AS c, {KM} AS km, m.r, m.x, m.b, a.r AS ar, a.x AS ax, a.b AS ab, a.length_km AS a_km FROM model_lines m JOIN ref_lines a ON m.a_id = a.id),
d AS (SELECT id, r / nullif(km, 0) AS r, x / nullif(km, 0) AS x, b / nullif(km, 0) AS b, ar / nullif(a_km, 0) / c AS ar, ax / nullif(a_km, 0) / c AS ax, ab / nullif(a_km, 0) * c AS ab FROM t)
SELECT id, CASE WHEN abs(r) >= 1e-9 THEN round(100 * (ar - r) / abs(r), 6) + 0.0 END AS r, CASE WHEN abs(x) >= 1e-9 THEN round(100 * (ax - x) / abs(x), 6) + 0.0 END AS x, CASE WHEN abs(b) >= 1e-9 THEN round(100 * (ab - b) / abs(b), 6) + 0.0 END AS b FROM d""")
def param_compare_all(spark, sf):
    """Differences per km of all three values, series ones by circuit, the shunt for all circuits."""
    a = _totals(spark, sf).withColumnsRenamed({c: f"a{c}" for c in "rxb"})
    m = model_lines(spark, sf).select("id", "a_id", "r", "x", "b", "circuits", S.to_km(F.col("length_m")).alias("km")).join(a, "a_id")
    per = {c: S.safe_div(F.col(f"a{c}"), F.col("length_km")) for c in "rxb"}
    of_circuit = {"r": per["r"] / F.col("circuits"), "x": per["x"] / F.col("circuits"), "b": per["b"] * F.col("circuits")}
    return m.select("id", *[R(S.pct_or_null(of_circuit[c], S.safe_div(F.col(c), F.col("km")))).alias(c) for c in "rxb"])


@query("""
, f AS (SELECT id, suppkey % 9 = 0 AS geo, number % 3 = 0 AS par, suppkey % 4 = 0 AS pv, partkey % 5 = 0 AS dup, partkey % 2 = 0 AS ok FROM model_lines)
SELECT CASE WHEN geo THEN 'geometric' WHEN par THEN 'parallel' WHEN pv THEN 'parallel_voltage' WHEN dup THEN 'duplicate' WHEN ok THEN 'matched' ELSE 'unmatched' END AS status, count(*) AS n FROM f GROUP BY 1""")
def model_status(spark, sf):
    """On the model's side geometry comes first and duplicates last."""
    zero = lambda c, n: F.col(c) % n == 0
    status = S.first_true((zero("suppkey", 9), "geometric"), (zero("number", 3), "parallel"), (zero("suppkey", 4), "parallel_voltage"), (zero("partkey", 5), "duplicate"), (zero("partkey", 2), "matched"), default="unmatched")
    return model_lines(spark, sf).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""
, e AS (SELECT 's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '-220' ELSE '' END AS bus, CASE WHEN s_suppkey % 3 = 0 THEN 380.0::DOUBLE END AS kv, s_suppkey % 3 = 0 AS known FROM supplier)
SELECT bus, CASE WHEN known THEN kv WHEN bus LIKE '%-220' THEN 220.0 END AS kv FROM e""")
def bus_voltage_fallback(spark, sf):
    k = F.col("s_suppkey")
    bus = F.concat(F.lit("s"), k.cast("string"), F.when(k % 2 == 0, "-220").otherwise(""))
    return A.buses(table(spark, sf, "supplier").select(bus.alias("bus0"), F.lit(None).cast("string").alias("bus1"), F.when(k % 3 == 0, 380.0).alias("kv")))
