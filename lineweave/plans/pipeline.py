"""The whole linkage of two line tables: candidates, scores, assignment, later passes, repairs, overrides, reports.

Corridors are locked first; single lines and paths of several are assigned in order under
circuit capacity; then come the visual, coarse, parallel and signature passes, chain
extension and missed parallels; what is left of lines of one shape shares their best match.
Each pass is cut from the ones before by a written table.  Inputs are normalised lines (sources.readers).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import geometry as G
from lineweave.functions import scalars as S
from lineweave.operators import analytics, graph, joins, lineage, matching, passes, paths
from lineweave.plans.thresholds import CORRIDORS, Thresholds


@dataclass(frozen=True)
class Result:
    links: DataFrame
    candidates: DataFrame
    unmatched: DataFrame
    by_voltage: DataFrame


def with_points(lines: DataFrame) -> DataFrame:
    """The longest part stands for a line; its voltage class is the join key of all spatial work."""
    kind = F.when(F.col("kv").isin(380, 400), "ehv").when(F.col("kv").isin(220, 225), "220").otherwise(F.col("kv").cast("string"))
    return lines.withColumn("points", G.longest_part(F.col("parts"))).where(F.size("points") >= 2).withColumn("kind", kind)


def candidates(refs: DataFrame, models: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Scored pairs of a voltage class whose boxes come near: overlap, shape, length, direction, electrical values."""
    a = with_points(refs).select(F.col("id").alias("a_id"), "kind", F.col("points").alias("a_points"), F.col("length_km").alias("a_km"), *[F.col(f"{c}_per_km").alias(f"a_{c}") for c in "rxb"])
    b = with_points(models).select(F.col("id").alias("b_id"), "kind", F.col("points").alias("b_points"), F.col("length_km").alias("b_km"), "circuits", *[F.col(f"{c}_per_km").alias(f"b_{c}") for c in "rxb"])
    near = joins.box_pairs(a, b, ["kind"], "a_points", "b_points", t.overlap_buffer, 0.5)
    near = near.withColumn("ratio", F.col("b_km") / F.col("a_km")).where(F.col("ratio").between(t.ratio_low, t.ratio_high))
    cosine = G.abs_cos(G.direction(F.col("a_points")), G.direction(F.col("b_points")))
    near = near.withColumn("cosine", cosine).where(F.col("cosine") >= t.direction_least)
    measured = matching.line_measures(near, "a_points", "b_points", t.overlap_buffer)
    electrical = S.electrical_similarity([F.col(f"a_{c}") for c in "rxb"], [F.col(f"b_{c}") for c in "rxb"])
    score = matching.path_score(F.lit(1), electrical, F.col("covered"), F.col("ratio"), F.col("cosine"))
    return measured.select("a_id", "b_id", "circuits", "a_km", "b_km", "ratio", "hausdorff", "covered", "cosine", score.alias("score"))


def _sides(refs: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables in the columns that paths and passes take."""
    per_km = [F.col(f"{c}_per_km").alias(c) for c in "rxb"]
    a = with_points(refs).select(F.col("id").alias("a_id"), "kv", "points", F.col("length_km").alias("km"), "bus0", "bus1", *per_km)
    b = with_points(models).select(F.col("id").alias("b_id"), "kv", "points", F.col("length_km").alias("km"), "bus0", "bus1", F.coalesce("circuits", F.lit(1)).alias("circuits"), *per_km)
    return a, b


def _take(links: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Links (a_id, b_ids, score, ratio, matched, quality, is_copy, never, how) after a pass: lines that had none take what was found (a_id, b_ids, score)."""
    label = S.quality_label(F.col("_score"), F.size("_ids"), F.lit(False))
    new = found.select("a_id", F.col("b_ids").alias("_ids"), F.col("score").alias("_score"))
    out = links.join(new, "a_id", "left")
    takes = ~F.col("matched") & ~F.col("never") & F.col("_ids").isNotNull()
    choose = lambda c, v: F.when(takes, v).otherwise(F.col(c)).alias(c)
    out = out.select("a_id", choose("b_ids", F.col("_ids")), choose("score", F.col("_score")), "ratio", (F.col("matched") | takes).alias("matched"), choose("quality", label), "is_copy", "never", choose("how", F.lit(how)))
    return lineage.cut(out)


def later_passes(links: DataFrame, groups: DataFrame, refs: DataFrame, models: DataFrame, t: Thresholds) -> DataFrame:
    """The passes for lines that the main one leaves, in order: visual, coarse, parallel, signature, chain extension, missed parallels.

    refs and models as _sides gives them; groups: (a_id, parallel_group) of lines of one shape.
    """
    one = lambda found: found.select("a_id", F.array("b_id").alias("b_ids"), "score")

    def left(links: DataFrame) -> DataFrame:
        return refs.join(links.where("not matched and not never").select("a_id"), "a_id", "left_semi")

    def usage(links: DataFrame) -> DataFrame:
        return links.where("matched").select("a_id", F.explode("b_ids").alias("b_id"))

    def free(links: DataFrame) -> DataFrame:
        used = usage(links).groupBy("b_id").agg(F.count(F.lit(1)).alias("used"))
        rest = (F.col("circuits") - F.coalesce("used", F.lit(0))).cast("int")
        return models.join(used, "b_id", "left").withColumn("rest", rest).where("rest > 0").drop("used")

    columns = ("a_id", "kv", "points", "km")
    plain = lambda lines: lines.select("b_id", "kv", "points", "km")
    links = _take(links, one(passes.visual(left(links).select(*columns), plain(free(links)), t)), "visual")
    links = _take(links, one(passes.simple(left(links).select(*columns), plain(free(links)), t)), "coarse")
    in_group = usage(links).join(groups, "a_id").select("parallel_group", "b_id").distinct()
    links = _take(links, one(passes.parallel(left(links).select(*columns).join(groups, "a_id"), plain(free(links)), in_group, t)), "parallel")
    signed = free(links).select("b_id", G.signature(F.col("points")).alias("b_sig"), "circuits")
    used = usage(links).groupBy("b_id").agg(F.count(F.lit(1)).alias("used"))
    late = passes.late_signatures(left(links).select("a_id", G.signature(F.col("points")).alias("sig")), signed, used, t)
    links = _take(links, late.select("a_id", F.array("b_id").alias("b_ids"), F.lit(t.parallel_least).alias("score")), "signature")
    links = extend(links, refs, models, t)
    linked = usage(links).join(groups, "a_id").join(models.select("b_id", "kv"), "b_id")
    missed = matching.by_contained_suffix(linked.select("parallel_group", F.col("b_id").alias("id"), "kv"), plain(free(links)))
    wanted = matching.largest_pattern(left(links).select("a_id").join(groups, "a_id").join(missed, "parallel_group"))
    each = wanted.select("a_id", "score", F.explode("b_ids").alias("b_id")).join(free(links).select("b_id", "rest"), "b_id")
    legs = each.groupBy("a_id").agg(F.array_sort(F.collect_list(F.struct("b_id", "rest"))).alias("legs"), F.first("score").alias("score"))
    found = legs.select("a_id", F.col("legs.b_id").alias("b_ids"), F.col("legs.rest").alias("circuits"), F.lit(None).cast("double").alias("ratio"), "score")
    return _take(links, paths.assign(lineage.cut(found), groups), "pattern")


def extend(links: DataFrame, refs: DataFrame, models: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Matched lines that cover less than extend_ratio of their length grow along neighbouring model lines."""
    covered = links.where("matched").select("a_id", F.explode("b_ids").alias("b_id")).join(models.select("b_id", "km"), "b_id").groupBy("a_id").agg(F.sum("km").alias("have"))
    short = covered.join(refs, "a_id").where((F.col("km") > 0) & (F.col("have") / F.col("km") < t.extend_ratio))
    seeds = short.join(links.select("a_id", F.col("b_ids").alias("chain")), "a_id").select("a_id", F.col("kv").alias("a_kv"), "points", F.col("km").alias("length"), "chain")
    reach = t.extend_reach * t.overlap_buffer
    near = joins.box_pairs(seeds.withColumnRenamed("points", "a_points").select("a_id", "a_kv", "a_points"), models, [], "a_points", "points", 2 * reach, 0.5).where(S.compatible(F.col("a_kv"), F.col("kv"), "strict"))
    # An alias of its own, for the two sides of a cogroup must not share a column.
    parts = near.select(F.col("a_id").alias("a_id"), "b_id", "points", F.col("km").alias("length"), G.node_id(G.start(F.col("points"))).alias("u"), G.node_id(G.end(F.col("points"))).alias("v"))
    grown = graph.grow_chains(seeds.drop("a_kv"), parts, t.overlap_buffer, t.extend_ratio, t.extend_most, t.extend_reach, t.extend_iou).where("added > 0")
    out = links.join(grown.select("a_id", F.col("chain").alias("_chain"), F.col("ratio").alias("_ratio")), "a_id", "left")
    grows = F.col("_chain").isNotNull()
    columns = [c for c in links.columns if c not in ("b_ids", "ratio", "how")]
    out = out.select(*columns, F.coalesce("_chain", "b_ids").alias("b_ids"), F.coalesce("_ratio", "ratio").alias("ratio"), F.when(grows, F.concat_ws("+", "how", F.lit("extended"))).otherwise(F.col("how")).alias("how"))
    return lineage.cut(out.select(*links.columns))


def link(refs: DataFrame, models: DataFrame, manual: DataFrame | None = None, t: Thresholds = Thresholds(), corridors: dict = CORRIDORS) -> Result:
    """Links of all reference lines, one row each; `how` names the pass that found a link."""
    spark = refs.sparkSession
    locked = matching.corridors(spark, refs, models, corridors)
    open_refs = refs.join(locked.select(F.col("a_id").alias("id")), "id", "left_anti")
    same = refs.groupBy(F.to_json("parts").alias("shape")).agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    groups = lineage.cut(same.select(F.explode("ids").alias("a_id"), F.array_join("ids", "_").alias("parallel_group")))
    pairs = candidates(open_refs, models, t)
    a, b = _sides(open_refs, models)
    # Single lines that lie along the reference line, and paths of several between its ends.
    singles = pairs.select("a_id", F.array("b_id").alias("b_ids"), F.array("circuits").alias("circuits"), "ratio", "score")
    several = paths.candidates(a, b, t).where("segments > 1").select("a_id", "b_ids", "circuits", "ratio", "score")
    good = lineage.cut(singles.unionByName(several).where(F.col("score") > t.late_least))
    assigned = paths.assign(good, groups)
    found = assigned.select("a_id", "b_ids", "score", "ratio", F.lit(True).alias("matched"), S.quality_label(F.col("score"), F.size("b_ids"), F.lit(False)).alias("quality"), F.lit("path").alias("how"))
    links = found.unionByName(locked.select("a_id", "b_ids", "matched", F.col("forced_unmatched").alias("never"), F.when(F.col("matched"), "corridor").alias("how")), allowMissingColumns=True)
    links = matching.forbid(links, locked.where("forced_unmatched"))
    links = matching.fill_missing(links, refs)
    none = F.array().cast("array<string>")
    links = lineage.cut(links.select("a_id", F.coalesce("b_ids", none).alias("b_ids"), "score", "ratio", "matched", "quality", F.lit(False).alias("is_copy"), F.coalesce("never", F.lit(False)).alias("never"), "how"))
    links = later_passes(links, groups, _sides(refs, models)[0], b, t)
    # Lines of one shape that no pass has linked share their group's best match.
    spread = matching.spread_in_groups(links.join(groups, "a_id")).where("is_copy").select("a_id", F.col("b_ids").alias("_ids"))
    takes = F.col("_ids").isNotNull() & ~F.col("never")
    out = links.join(spread, "a_id", "left").select("a_id", F.when(takes, F.col("_ids")).otherwise(F.col("b_ids")).alias("b_ids"), "score", "ratio", (F.col("matched") | takes).alias("matched"), "quality", takes.alias("is_copy"), "never", F.when(takes, "copy").otherwise(F.col("how")).alias("how"))
    out = matching.forbid(out, locked.where("forced_unmatched"))
    if manual is not None:
        by_hand = matching.override(out.select("a_id", "b_ids", "matched"), matching.valid_manual(manual, refs, models))
        out = by_hand.join(out.select("a_id", "score", "quality", "ratio", "is_copy", "never", "how"), "a_id", "left").withColumn("how", F.when(F.col("manual"), "manual").otherwise(F.col("how")))
    used = out.where("matched").select(F.explode("b_ids").alias("id")).distinct()
    unmatched = models.join(used, "id", "left_anti")
    kv = S.canonical_kv(F.col("kv")).cast("string").alias("kv")
    by_voltage = analytics.compare_by(models.select(kv, "length_km"), refs.select(kv, F.col("length_km").alias("ref_km")), "kv", F.sum("length_km"), F.sum("ref_km"), ("model_km", "ref_km"))
    return Result(out, pairs, unmatched, by_voltage)
