"""Writers: CSV with joined ids, GeoJSON rows, statistics and small HTML tables of aggregated frames."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import scalars as S


def flat(df: DataFrame) -> DataFrame:
    """Arrays of ids as text joined by semicolons; other columns as they are."""
    return df.select(*[F.array_join(c, ";").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", "\\").csv(path)


def with_code(models: DataFrame, links: DataFrame, refs: DataFrame) -> DataFrame:
    """Model lines with the code of the last reference line that uses them, as second column."""
    each = links.where("matched").select("a_id", F.explode("b_ids").alias("b_id")).join(refs.select(F.col("id").alias("a_id"), "ext_code"), "a_id")
    last = each.groupBy("b_id").agg(F.max_by("ext_code", "a_id").alias("ref_code"))
    first, *rest = models.columns
    return models.join(last, models["id"] == last["b_id"], "left").select(first, "ref_code", *rest)


def geojson_line(points: Column) -> Column:
    """A GeoJSON geometry of an array of points."""
    pair = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    return F.struct(F.lit("LineString").alias("type"), pair.alias("coordinates"))


def features(df: DataFrame, points: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geojson_line(F.col(points)).alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_geojson_lines(df: DataFrame, points: str, properties: list[str], path: str) -> None:
    features(df, points, properties).write.mode("overwrite").text(path)


def line_features(lines: DataFrame, links: DataFrame) -> DataFrame:
    """What a map draws: each line with its status, voltage class and parameters."""
    status = S.first_true((F.coalesce("is_duplicate", F.lit(False)), "duplicate"), (F.coalesce("is_parallel", F.lit(False)), "parallel"), (F.coalesce("is_geometric", F.lit(False)), "geometric"), (F.coalesce("matched", F.lit(False)), "matched"), default="unmatched")
    out = lines.join(links.withColumnRenamed("a_id", "id"), "id", "left")
    for c in ("is_duplicate", "is_parallel", "is_geometric", "matched"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(False))
    return out.withColumn("status", status).withColumn("class", S.kv_class(F.col("kv"), F.coalesce("is_dc", F.lit(False))))


def split_by_voltage(lines: DataFrame, path: str, kv: float = 220.0) -> None:
    """Low, high and unreadable voltages as three folders, in one pass over the lines."""
    part = F.when(F.col("kv").isNull(), "unparsed").when(F.col("kv") < kv, "lv").otherwise("mvhv")
    lines.withColumn("part", part).drop("parts").write.mode("overwrite").partitionBy("part").option("header", True).csv(path)


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A page with an aggregated frame; more rows than `most` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: aggregate before rendering")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def write_manual_links(links: DataFrame, path: str) -> None:
    """Links set by hand, few as they are, as one JSON array: what readers.read_manual_links takes."""
    links.agg(F.to_json(F.collect_list(F.struct(*links.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_changes(log: DataFrame, path: str, sample: int = 10) -> str:
    """The change log as CSV, and a short text with its first rows."""
    write_csv(log, path)
    key, column, *_ = log.columns
    rows = log.orderBy(key, column).limit(sample).collect()
    return "\n".join([f"{log.count()} values changed", *[", ".join(f"{c}: {r[c]}" for c in log.columns) for r in rows]])


def matching_rows(links: DataFrame, refs: DataFrame, models: DataFrame) -> DataFrame:
    """Each link with both sides' lengths, voltages and their ratio: the rows of the enhanced table of links."""
    each = links.where("matched").select("a_id", "b_ids", F.explode("b_ids").alias("b_id"))
    km = each.join(models.select(F.col("id").alias("b_id"), F.col("length_km").alias("b_km")), "b_id", "left").groupBy("a_id").agg(F.sum("b_km").alias("model_km"), F.count("b_km").alias("segments"))
    side = refs.select(F.col("id").alias("a_id"), "name", "kv", F.col("length_km").alias("ref_km"))
    out = links.join(side, "a_id").join(km, "a_id", "left")
    return out.select("a_id", "name", "kv", "matched", "b_ids", "ref_km", "model_km", F.coalesce("segments", F.lit(0)).alias("segments"), S.safe_div(F.col("model_km"), F.col("ref_km")).alias("ratio"))
