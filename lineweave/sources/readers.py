"""Readers of messy grid files: everything arrives as text and leaves in a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import scalars as S

MANUAL_SCHEMA = "a_id string, b_ids array<string>, note string"
POLYGON_SCHEMA = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_text_csv(spark: SparkSession, path: str, sep: str = ",", quote: str = "'") -> DataFrame:
    """A CSV with a header, all columns text; rows of another width are dropped."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=sep, quote=quote, mode="DROPMALFORMED")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab, semicolon or comma, whichever the first line has most of."""
    first = spark.read.text(path).first()
    line = first["value"] if first else ""
    return max((",", ";", "\t"), key=line.count)


def _geometry(df: DataFrame) -> Column:
    """The parts of a line from whatever the table has: WKT in any text column named for it, broken pairs, or end coordinates."""
    tries = [G.parse_wkt(F.col(c)) for c in df.columns if c.lower() in ("geometry", "wkt", "geom", "the_geom")]
    tries += [F.when(F.size(G.truncated_pairs(F.col(c))) > 1, F.array(G.truncated_pairs(F.col(c)))) for c in df.columns if c.lower() == "geometry"]
    for a in (("x0", "y0", "x1", "y1"), ("lon0", "lat0", "lon1", "lat1"), ("longitude0", "latitude0", "longitude1", "latitude1")):
        if all(c in df.columns for c in a):
            ends = [F.col(c).try_cast("double") for c in a]
            there = ends[0].isNotNull() & ends[1].isNotNull() & ends[2].isNotNull() & ends[3].isNotNull()
            tries.append(F.when(there, F.array(F.array(G.point(ends[0], ends[1]), G.point(ends[2], ends[3])))))
    for a in (("lon", "lat"), ("x", "y")):
        if all(c in df.columns for c in a):
            x, y = (F.col(c).try_cast("double") for c in a)
            tries.append(F.when(x.isNotNull() & y.isNotNull(), F.array(F.array(G.point(x, y)))))
    return F.coalesce(*tries) if tries else F.lit(None).cast(f"array<{G.POINTS}>")


def normalize_lines(df: DataFrame, metres: bool) -> DataFrame:
    """Ids, voltages, lengths, parameters and geometry in the schema that the operators expect."""
    voltage = S.first_of(df, "v_nom", "voltage", "kv").cast("string")
    length = S.num(S.first_of(df, "length", "length_km", "length_m"))
    out = df.withColumn("parts", _geometry(df))
    per_km = {c: S.num(S.first_of(df, f"{c}_per_km", f"{c}_ohm_per_km", f"{c}_S_per_km")) for c in "rxb"}
    return out.select(
        S.first_of(df, "id", "line_id", "link_id").cast("string").alias("id"),
        S.first_of(df, "name", "NE_name").cast("string").alias("name"),
        S.first_of(df, "EIC_Code", "ext_code").cast("string").alias("ext_code"),
        S.first_of(df, "bus0").cast("string").alias("bus0"),
        S.first_of(df, "bus1").cast("string").alias("bus1"),
        voltage.alias("kv_text"),
        S.kv_max(voltage).alias("kv"),
        F.coalesce(F.upper(voltage).contains("DC"), F.lit(False)).alias("is_dc"),
        F.coalesce(length / 1000 if metres else S.to_km(length), G.length(G.longest_part(F.col("parts"))) * G.KM_PER_DEGREE).alias("length_km"),
        F.greatest(F.lit(1), F.coalesce(S.num(S.first_of(df, "circuits", "num_parallel")).cast("int"), F.lit(1))).alias("circuits"),
        *[S.num(S.first_of(df, c)).alias(c) for c in ("r", "x", "b", "i_nom", "s_nom")],
        *[F.coalesce(per_km[c], S.safe_div(S.num(S.first_of(df, c)), S.to_km(length))).alias(f"{c}_per_km") for c in "rxb"],
        "parts",
    )


def read_lines(spark: SparkSession, path: str, metres: bool = False) -> DataFrame:
    return normalize_lines(read_text_csv(spark, path, sniff_separator(spark, path)), metres)


def read_dc_links(spark: SparkSession, path: str) -> DataFrame:
    """Direct-current links: rows with a line geometry only."""
    df = read_lines(spark, path, metres=True)
    return df.where(F.size("parts") > 0).withColumn("is_dc", F.lit(True)).withColumn("kv_text", F.lit("DC"))


def read_110kv(spark: SparkSession, path: str) -> DataFrame:
    df = read_lines(spark, path, metres=True)
    return df.where(F.size("parts") > 0).withColumn("kv", F.lit(110.0))


def parse_raw_lines(text: DataFrame) -> DataFrame:
    """Rows of broken exports, taken apart by patterns: id, direct-current voltage, current, circuits, geometry."""
    v = F.col("value")
    rows = text.where(v.startswith("relation/") | v.startswith("way/") | v.startswith("merged"))
    fields = F.split(v, "[,\t]")
    field = lambda i: F.element_at(fields, i)
    return rows.select(
        field(1).alias("id"),
        F.regexp_extract(v, r"([0-9]+)-?DC", 1).try_cast("int").alias("dc_kv"),
        F.try_element_at(fields, F.lit(2)).try_cast("double").alias("i_nom"),
        F.greatest(F.lit(1), F.try_element_at(fields, F.lit(3)).try_cast("int")).alias("circuits"),
        F.regexp_extract(v, r"((?:MULTI)?LINESTRING.*)", 1).alias("geometry"),
    )


def read_transformers(spark: SparkSession, path: str) -> DataFrame:
    """Points from WKT, lon/lat or x/y; of a line, its centroid."""
    df = read_text_csv(spark, path, sniff_separator(spark, path))
    c = G.centroid(G.longest_part(_geometry(df)))
    side = lambda n, *names: S.num(S.first_of(df, *names)).alias(n)
    return df.select(
        S.first_of(df, "EIC_Code", "transformer_id", "id").cast("string").alias("id"),
        S.first_of(df, "EIC_Code").cast("string").alias("ext_code"),
        S.first_of(df, "name").cast("string").alias("name"),
        S.first_of(df, "Comment", "comment").cast("string").alias("comment"),
        side("kv0", "Voltage_level(kV) Primary", "voltage_bus0"),
        side("kv1", "Voltage_level(kV) Secondary", "voltage_bus1"),
        *[side(p, p) for p in ("r", "x", "b", "g", "s_nom")],
        c["x"].alias("lon"),
        c["y"].alias("lat"),
    )


def read_boundary(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """Outer rings of a GeoJSON boundary; a boundary is a parameter, small enough for the driver."""
    rows = spark.read.schema(POLYGON_SCHEMA).json(path, multiLine=True).select(F.explode("features.geometry").alias("g"))
    one = F.from_json("g.coordinates", "array<array<array<double>>>")
    many = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    rings = rows.select(F.when(F.col("g.type") == "Polygon", F.array(one[0])).otherwise(F.transform(many, lambda p: p[0])).alias("rings"))
    return [[(p[0], p[1]) for p in ring] for r in rings.collect() for ring in r["rings"]]


def read_manual_links(spark: SparkSession, path: str) -> DataFrame:
    """Links set by hand; a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANUAL_SCHEMA).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANUAL_SCHEMA)


def read_links(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """Links as a table, a CSV with joined ids or a JSON file."""
    if isinstance(source, DataFrame):
        return source
    if source.endswith(".json"):
        return spark.read.schema(MANUAL_SCHEMA).json(source, multiLine=True)
    return spark.read.csv(source, header=True).withColumn("b_ids", S.id_list(F.col("b_ids")))


def import_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old lines and those new ones whose id is not there yet."""
    return old.unionByName(new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti"), allowMissingColumns=True)


def select_inside(df: DataFrame, rings: list[list[tuple[float, float]]], x: str = "lon", y: str = "lat") -> DataFrame:
    """Rows whose point lies in any ring; inner edges between rings don't matter, so nothing is dissolved."""
    hit = F.lit(False)
    for ring in rings:
        hit = hit | G.inside(F.col(x), F.col(y), ring)
    return df.where(hit)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, parts) of the line features of a GeoJSON file: a whole collection, or a feature a line."""
    kinds = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = spark.read.schema(f"features array<struct<{', '.join(f.replace(' ', ':', 1) for f in kinds.split(', '))}>>, {kinds}").json(path, multiLine=not _by_lines(spark, path))
    one = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(F.struct("type", "id", "properties", "geometry")))
    each = rows.select(F.explode(one).alias("f")).select("f.*")
    point = lambda p: G.point(p[0], p[1])
    line = F.transform(F.from_json("geometry.coordinates", "array<array<double>>"), point)
    many = F.transform(F.from_json("geometry.coordinates", "array<array<array<double>>>"), lambda l: F.transform(l, point))
    parts = F.when(F.col("geometry.type") == "LineString", F.array(line)).when(F.col("geometry.type").isin("MultiLineString", "Polygon"), many)
    return each.select(F.coalesce("id", F.col("properties")["id"]).alias("id"), "properties", parts.alias("parts")).where("parts is not null")


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether a file has one feature a line: its first line is a whole one."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return first is not None and first[0].strip().startswith("{") and '"Feature"' in first[0] and '"FeatureCollection"' not in first[0]


def glue_geometry(df: DataFrame) -> DataFrame:
    """Rows whose geometry was cut at commas into several columns, with one column `geometry`: from the first that begins a geometry on."""
    texts = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    at = F.array_position(F.transform(texts, lambda v: F.upper(v).rlike(r"(MULTI)?LINESTRING|POINT|POLYGON")), True)
    rest = F.when(at > 0, F.rtrim(F.array_join(F.slice(texts, at.cast("int"), len(df.columns)), ","), F.lit(",")))
    clean = F.regexp_replace(F.regexp_replace(rest, "['\"]", ""), r"\s+", " ")
    return df.select(*[c for c in df.columns if c != "geometry"], clean.alias("geometry"))


def lines_meeting(lines: DataFrame, rings: list[list[tuple[float, float]]], buffer_km: float = 0.0) -> DataFrame:
    """Lines, whole, that touch any ring or come within the buffer."""
    hit = F.lit(False)
    for ring in rings:
        hit = hit | F.exists("parts", _meeting(ring, buffer_km / G.KM_PER_DEGREE))
    return lines.where(hit)


def _meeting(ring: list[tuple[float, float]], reach: float):
    return lambda p: G.meets(p, ring, reach)


def explode_parts(lines: DataFrame) -> DataFrame:
    """A row a part of a multi-part line, with its number; of a polygon only the outer ring should be given."""
    return lines.select(*[c for c in lines.columns if c != "parts"], F.posexplode("parts").alias("part", "points"))
