"""Comparisons, coverage and allocation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import scalars as S


def compare_by(left: DataFrame, right: DataFrame, key: str, value: Column, other: Column, names: tuple[str, str]) -> DataFrame:
    """Two aggregates by key side by side, their difference and percentage, and a row with the totals.

    Each side is aggregated once with a rollup, so the total needs no second pass.
    """
    a_name, b_name = names
    total = F.coalesce(F.col(key).cast("string"), F.lit("Total")).alias(key)
    a = left.where(F.col(key).isNotNull()).rollup(key).agg(value.alias(a_name)).select(total, a_name)
    b = right.where(F.col(key).isNotNull()).rollup(key).agg(other.alias(b_name)).select(total, b_name)
    out = a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.withColumn("difference", F.col(a_name) - F.col(b_name)).withColumn("difference_pct", F.when(F.col(b_name) != 0, (F.col(a_name) - F.col(b_name)) / F.col(b_name) * 100))


def buses(lines: DataFrame) -> DataFrame:
    """Each bus of either end and the most common voltage of its lines (the lower of equals)."""
    ends = lines.select(F.col("bus0").alias("bus"), "kv").unionByName(lines.select(F.col("bus1").alias("bus"), "kv")).where("bus is not null")
    counts = ends.groupBy("bus", "kv").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("bus").agg(F.max(F.struct(F.col("kv").isNotNull().alias("known"), F.col("n"), (-F.col("kv")).alias("kv"))).alias("m"))
    # A bus none of whose lines has a voltage may be called by one: what stands behind its last dash.
    named = F.regexp_extract("bus", r"-([0-9]+)$", 1).try_cast("double")
    return best.select("bus", F.coalesce(-F.col("m.kv"), named).alias("kv"))


def bucket_lengths(lines: DataFrame, bucket: Column) -> DataFrame:
    km = S.to_km(F.col("length_m"))
    return lines.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("routes"), F.sum(km).alias("route_km"), F.sum(km * F.col("circuits")).alias("circuit_km"), F.avg("circuits").alias("mean_circuits")
    )


def allocate(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of a reference line to its segments by share of length; circuits divide series values and multiply the shunt."""
    share = F.col("segment_km") / F.sum("segment_km").over(Window.partitionBy("a_id"))
    out = segments.join(totals, "a_id").withColumn("share", share)
    c = F.col("circuits")
    return out.select("a_id", "b_id", "share", *[(F.col(f"total_{p}") * F.col("share") / c).alias(f"allocated_{p}") for p in "rx"], (F.col("total_b") * F.col("share") * c).alias("allocated_b"))


def over_subscribed(links: DataFrame, lines: DataFrame) -> DataFrame:
    """Model lines that more links use than they have circuits."""
    used = links.groupBy("b_id").agg(F.count(F.lit(1)).alias("used"))
    return used.join(lines.select(F.col("id").alias("b_id"), "circuits"), "b_id").where("used > circuits")


def keep_within_capacity(links: DataFrame, capacity: str = "circuits") -> DataFrame:
    """The best users of each model line, as many as it has circuits: parallel lines first, then score, then id."""
    w = Window.partitionBy("b_id").orderBy(F.desc("is_parallel"), F.desc("score"), "a_id")
    return links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col(capacity))


def statistics(frame: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(statistic, category, n) over several labels in one pass: the labels are exploded, not scanned one by one."""
    labels = F.array(*[F.struct(F.lit(k).alias("statistic"), v.cast("string").alias("category")) for k, v in groups.items()])
    return frame.select(F.explode(labels).alias("s")).groupBy("s.statistic", "s.category").agg(F.count(F.lit(1)).alias("n"))


def copy_totals(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of a reference line on each of its segments, unscaled, with its values per km.

    segments: (a_id, b_id, status); totals: (a_id, length_km, r, x, b).
    """
    per_km = [S.safe_div(F.col(c), F.col("length_km")).alias(f"{c}_per_km") for c in "rxb"]
    return segments.join(totals, "a_id").select("a_id", "b_id", "status", *[F.col(c).alias(f"allocated_{c}") for c in "rxb"], *per_km)


def applied(allocated: DataFrame) -> DataFrame:
    """Segments whose totals were applied, to themselves or as a parallel circuit."""
    return allocated.where(F.col("status").isin("Applied", "Parallel Circuit"))


def weighted_means(segments: DataFrame, values: tuple[str, ...] = ("r", "x"), weight: str = "km") -> DataFrame:
    """Means of values over the segments of a line by their lengths."""
    return segments.where(F.col(weight) > 0).groupBy("a_id").agg(*[(F.sum(F.coalesce(v, F.lit(0.0)) * F.col(weight)) / F.sum(weight)).alias(f"mean_{v}") for v in values], F.count(F.lit(1)).alias("segments"))


def sample_score(length_ratio: Column, overlap: Column, similarity: Column) -> Column:
    """Quality of a sampled link: closeness of lengths, overlap of shapes, closeness of electrical values."""
    return 0.4 * (1 - F.least(F.lit(1.0), F.abs(length_ratio - 1))) + 0.4 * overlap + 0.2 * similarity


def sample_report(scored: DataFrame, parts: tuple[str, ...], score: str = "score") -> DataFrame:
    """(rating, links, averages of the parts and the score) of a sample."""
    return scored.groupBy(S.quality_rating(F.col(score)).alias("rating")).agg(F.count(F.lit(1)).alias("links"), *[F.avg(c).alias(f"avg_{c}") for c in (*parts, score)])


def users_of(links: DataFrame) -> DataFrame:
    """(b_id, a_ids, quality) of model lines: the reference lines that use each and the first label there is, by their ids; links: (a_id, b_id, quality)."""
    label = F.min_by("quality", F.when(F.coalesce(F.col("quality"), F.lit("")) != "", F.col("a_id")))
    return links.groupBy("b_id").agg(F.array_sort(F.collect_set("a_id")).alias("a_ids"), label.alias("quality"))


def enforce_capacity(uses: DataFrame, models: DataFrame, refs: DataFrame) -> DataFrame:
    """(a_id, b_ids, matched, ratio): links without the model lines of which better users leave no circuit; their ratios anew, unmatched where none stays.

    uses: (a_id, b_id, is_parallel, score); models: (b_id, b_km, circuits); refs: (a_id, km).
    """
    kept = keep_within_capacity(uses.join(models, "b_id")).groupBy("a_id").agg(F.array_sort(F.collect_list("b_id")).alias("_ids"), F.sum("b_km").alias("_km"))
    out = uses.select("a_id").distinct().join(refs, "a_id").join(kept, "a_id", "left")
    return out.select("a_id", F.coalesce("_ids", F.array().cast("array<string>")).alias("b_ids"), F.col("_ids").isNotNull().alias("matched"), F.when(F.col("km") > 0, F.col("_km") / F.col("km")).alias("ratio"))


def change_log(old: DataFrame, new: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, column, old, new) of values that differ between two versions of a table."""
    values = lambda t: F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(t)) for c in columns])
    a = old.select(key, F.explode(values("old")).alias("v")).select(key, "v.*")
    b = new.select(key, F.explode(values("new")).alias("v")).select(key, "v.*")
    return a.join(b, [key, "column"]).where(~F.col("old").eqNullSafe(F.col("new")))


def by_size(lines: DataFrame) -> DataFrame:
    """Lines with their place by voltage and length, the greatest first; places count inside a voltage, so no task holds all lines."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("kv").orderBy(F.desc("km"), "id")))


def total_bounds(lines: DataFrame) -> DataFrame:
    """The box around all lines."""
    b = lines.select(G.bounds(F.col("points")).alias("b"))
    return b.agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
