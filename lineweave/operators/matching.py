"""Linkage passes: candidates, scores, ordered assignment under circuit capacity, repairs, overrides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions import kernels
from lineweave.functions import scalars as S
from lineweave.operators import joins, lineage
from lineweave.plans.thresholds import CORRIDORS, MANUAL_LINKS, Thresholds


MEASURES = ("hausdorff", "covered", "iou", "area_share")


def line_measures(pairs: DataFrame, a: str, b: str, buffer: float | str, measures: tuple[str, ...] = MEASURES[:2], parts: int | None = None) -> DataFrame:
    """Pairs of lines with the measures asked for: hausdorff, covered (share of a within the buffer of b) and, by raster, iou and area_share.

    The buffer is a number or the name of a column.  A pair costs much more than its
    row, so pairs are dealt out evenly first.  Lines of equal numbers of vertices are measured together; rasters are made once a line and batch.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema), *(f"{m} double" for m in measures)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[np.array([[p["x"], p["y"]] for p in row], dtype=float) for row in batch[c]] for c in (a, b)]
            wide = batch[buffer].to_numpy(dtype=float) if isinstance(buffer, str) else np.full(len(batch), buffer)
            out = {m: np.zeros(len(batch)) for m in MEASURES}
            kinds: dict[tuple[int, int], list[int]] = {}
            for i, (p, q) in enumerate(zip(*lines, strict=True)):
                kinds.setdefault((len(p), len(q)), []).append(i)
            for at in kinds.values():
                for low in range(0, len(at), 500):
                    some = at[low : low + 500]
                    p, q = (np.stack([side[i] for i in some]) for side in lines)
                    if "hausdorff" in measures:
                        out["hausdorff"][some] = kernels.hausdorff_many(p, q)
                    if "covered" in measures:
                        out["covered"][some] = kernels.covered_many(p, q, wide[some])
            if "iou" in measures or "area_share" in measures:
                cells: dict[tuple[bytes, float], np.ndarray] = {}
                for i, (p, q) in enumerate(zip(*lines, strict=True)):
                    d = float(wide[i])
                    for line in (p, q):
                        if (line.tobytes(), d) not in cells:
                            cells[line.tobytes(), d] = kernels.buffer_cells(line, d, d / 8)
                    out["iou"][i], out["area_share"][i] = kernels.cell_shares(cells[p.tobytes(), d], cells[q.tobytes(), d])
            yield batch.assign(**{m: out[m] for m in measures})

    parts = parts or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts).mapInPandas(run, schema)


def share(n: np.ndarray, of: np.ndarray, digits: int | None = None) -> np.ndarray:
    """Shares of whole numbers; with `digits` rounded half up, as round() of Spark has them."""
    return n / of if digits is None else (2 * 10**digits * n + of) // (2 * of) / 10.0**digits


def pair_measures(left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], points: tuple[str, str], buffer: float, measures: tuple[str, ...], near: bool = True, digits: int | None = None) -> DataFrame:
    """(left id, right id, measures) of all pairs of equal keys whose left id is the smaller; `near`: only of lines whose boxes come within the buffer, and where covered is asked for, only with a share.

    The measures are those of line_measures; rasters are made once a line and block.  iou and area_share are shares of cells; with `digits` they are rounded, half up.
    """
    (a, b), (p, q) = ids, points

    def wanted(some: pa.Table, others: pa.Table) -> np.ndarray:
        return some[a].to_numpy()[:, None] < others[b].to_numpy()

    def measured(some: pa.Table, others: pa.Table, lines: kernels.Lines, more: kernels.Lines, i: np.ndarray, j: np.ndarray) -> pa.Table:
        out, keep = {}, np.ones(len(i), dtype=bool)
        if "hausdorff" in measures:
            out["hausdorff"] = kernels.of_pairs(kernels.hausdorff_pairs, lines, more, i, j)
        if "covered" in measures:
            out["covered"] = kernels.of_pairs(kernels.covered_pairs, lines, more, i, j, np.full(len(i), buffer))
            keep = out["covered"] > 0 if near else keep
        if "iou" in measures or "area_share" in measures:
            p, at = np.unique(i, return_inverse=True)
            q = np.unique(j)
            q = q[np.argsort(others[b].to_numpy()[q], kind="stable")]  # a line's pairs, those with larger ids, follow each other
            place = np.zeros(len(more), dtype=np.int64)
            place[q] = np.arange(len(q))
            left, right = (kernels.Tiles(side, rows, buffer, buffer / 8) for side, rows in ((lines, p), (more, q)))
            both = left.shared(right, at, place[j])
            size = left.count[at]
            out["iou"], out["area_share"] = (share(both, np.maximum(1, n), digits) for n in (size + right.count[place[j]] - both, size))
        found = {a: some[a].take(i[keep]), b: others[b].take(j[keep])} | {m: pa.array(out[m][keep]) for m in measures}
        return pa.table(found)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([f"{a} {kind(left, a)}", f"{b} {kind(right, b)}", *(f"{m} double" for m in measures)])
    if near:
        left = left.withColumn("_reach", F.lit(float(buffer)))
    most = 2 * joins.LINES_MOST if "iou" in measures or "area_share" in measures else None  # a raster costs more than many pairs
    return joins.line_blocks(left, right, keys, p, q, wanted, measured, schema, "_reach" if near else None, 1.0, most, corner=0.5)


def path_score(segments: Column, electrical: Column, geometric: Column, ratio: Column, direction: Column) -> Column:
    """Score of a candidate: one segment and several weigh the parts differently; a close ratio earns a little more."""
    length = 1 - F.least(F.lit(1.0), F.abs(ratio - 1))
    single = 0.35 * electrical + 0.25 * geometric + 0.20 * length + 0.20 * direction
    several = 0.25 * electrical + 0.35 * geometric + 0.25 * length + 0.15 * direction + F.when(ratio.between(0.95, 1.05), 0.05).otherwise(0.0)
    return F.when(segments == 1, single).otherwise(several)


def best_of(candidates: DataFrame, key: str, score: str, tie: str, least: float) -> DataFrame:
    """The best candidate above a floor; the smaller tie column wins."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return candidates.where(F.col(score) > least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def twins(measured: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Pairs of model lines that are circuits of one route: hardly apart and nearly as long."""
    return measured.where((F.col("hausdorff") < t.twin_hausdorff) & F.col("length_ratio").between(1 - t.twin_ratio, 1 + t.twin_ratio))


#: Candidates of a part that one task folds at most.
FOLD_MOST = 200_000


def assign(candidates: DataFrame, parts: DataFrame, keep: int | None = None, most: int = FOLD_MOST) -> DataFrame:
    """Ordered assignment: reference lines, by string id, take their best candidate with circuits left.

    candidates: (a_id, b_id, score, circuits); parts: (a_id, part), the connected part of
    the candidate graph a line is in.  Parts don't touch each other, so each is
    folded alone, row after row: memory holds the circuits left of one part.  A part of more than `most`
    candidates is assigned in rounds of joins instead, with the same result.  A line tries all
    its candidates, or the best `keep` if that is given.
    """
    top = candidates if keep is None else candidates.withColumn("_n", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("score"), "b_id"))).where(F.col("_n") <= keep).drop("_n")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, left, done = None, {}, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.part != part:
                    part, left, done = r.part, {}, None
                if r.a_id != done and left.setdefault(r.b_id, int(r.circuits)) > 0:
                    left[r.b_id] -= 1
                    done = r.a_id
                    out.append((r.a_id, r.b_id, float(r.score)))
            yield pd.DataFrame(out, columns=["a_id", "b_id", "score"])

    rows = top.join(parts, "a_id").select("part", "a_id", "b_id", "score", "circuits")
    large = lineage.cut(rows.groupBy("part").count().where(F.col("count") > most).select("part"))
    small = rows if large.isEmpty() else rows.join(large, "part", "left_anti")
    ordered = small.repartition("part").sortWithinPartitions("part", "a_id", F.desc("score"), "b_id")
    folded = ordered.mapInPandas(fold, "a_id string, b_id string, score double")
    return folded if small is rows else folded.unionByName(in_rounds(rows.join(large, "part", "left_semi").drop("part")))


def in_rounds(candidates: DataFrame) -> DataFrame:
    """The ordered assignment by deferred acceptance: each line asks for its best candidate that hasn't turned it down, and a
    candidate holds the first lines by id, as many as it has circuits.  As all candidates rank lines alike, what is held in
    the end is what the lines would take in that order."""
    ranked = lineage.cut(candidates.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("score"), "b_id"))))
    asks = ranked.select("a_id").distinct().withColumn("rank", F.lit(1))
    while True:
        turn = F.row_number().over(Window.partitionBy("b_id").orderBy("a_id"))
        asked = lineage.cut(ranked.join(asks, ["a_id", "rank"]).withColumn("held", turn <= F.col("circuits")))
        if asked.where("not held").isEmpty():
            return asked.select("a_id", "b_id", "score")
        asks = asked.select("a_id", (F.col("rank") + F.when(F.col("held"), 0).otherwise(1)).alias("rank"))


def candidate_parts(candidates: DataFrame) -> DataFrame:
    """(a_id, part): the least reference id reachable over shared candidates.

    Each round spreads the least label over shared candidates and then takes the
    label's own label, so long chains shorten fast; rounds go on until nothing moves.
    """
    pairs = lineage.cut(candidates.select("a_id", "b_id").distinct())
    labels = pairs.select("a_id").distinct().withColumn("part", F.col("a_id"))
    while True:
        by_b = pairs.join(labels, "a_id").groupBy("b_id").agg(F.min("part").alias("part"))
        spread = pairs.join(by_b, "b_id").groupBy("a_id").agg(F.min("part").alias("part"))
        jump = spread.join(labels.select(F.col("a_id").alias("part"), F.col("part").alias("far")), "part").select("a_id", F.least("part", "far").alias("new"))
        moved = lineage.cut(jump.join(labels, "a_id").select("a_id", F.col("new").alias("part"), (F.col("new") < F.col("part")).alias("moved")))
        labels = moved.select("a_id", "part")
        if moved.where("moved").isEmpty():
            return labels


def corridors(spark: SparkSession, refs: DataFrame, models: DataFrame, config: dict = CORRIDORS) -> DataFrame:
    """Lines of configured corridors: the first by id, up to the capacity and with all segments there, are matched and locked; the others may never match."""
    rows = [(name, capacity, a, b) for name, (capacity, lines) in config.items() for a, ids in lines.items() for b in ids]
    wanted = spark.createDataFrame(rows, "corridor string, capacity int, a_id string, b_id string")
    found = wanted.join(models.select(F.col("id").alias("b_id"), F.lit(1).alias("there")), "b_id", "left")
    lines = found.groupBy("corridor", "capacity", "a_id").agg(F.min(F.coalesce("there", F.lit(0))).alias("complete"), F.array_sort(F.collect_list("b_id")).alias("b_ids"))
    lines = lines.join(refs.select(F.col("id").alias("a_id")), "a_id")
    turn = F.row_number().over(Window.partitionBy("corridor").orderBy(F.desc("complete"), "a_id"))
    matched = (F.col("complete") == 1) & (F.col("turn") <= F.col("capacity"))
    return lines.withColumn("turn", turn).select("corridor", "a_id", F.when(matched, F.col("b_ids")).otherwise(F.array().cast("array<string>")).alias("b_ids"), matched.alias("matched"), F.lit(True).alias("locked"), (~matched).alias("forced_unmatched"))


def spread_in_groups(links: DataFrame) -> DataFrame:
    """Unmatched members of a group of parallel lines take the ids of the group's best match.

    Best: ten points a segment, the coverage's band, and fifteen, ten or five for the label.
    """
    label = F.when(F.col("quality").contains("Excellent"), 15).when(F.col("quality").contains("Good"), 10).when(F.col("quality").contains("Fair"), 5).otherwise(0)
    points = 10 * F.size("b_ids") + S.coverage_points(F.col("ratio")) + label
    best = links.where("matched").groupBy("parallel_group").agg(F.min_by("b_ids", F.struct((-points).alias("p"), F.col("a_id"))).alias("best_ids"))
    out = links.join(best, "parallel_group", "left")
    takes = ~F.col("matched") & F.col("best_ids").isNotNull()
    return out.select("a_id", "parallel_group", F.when(takes, F.col("best_ids")).otherwise(F.col("b_ids")).alias("b_ids"), (F.col("matched") | takes).alias("matched"), takes.alias("is_copy"))


def override(links: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual links win over found ones and add lines that had none."""
    m = manual.select(F.col("a_id"), F.col("b_ids").alias("_ids"), F.lit(True).alias("_manual"))
    out = links.join(m, "a_id", "full")
    by_hand = F.coalesce("_manual", F.lit(False))
    return out.select("a_id", F.when(by_hand, F.col("_ids")).otherwise(F.col("b_ids")).alias("b_ids"), (by_hand | F.coalesce("matched", F.lit(False))).alias("matched"), by_hand.alias("manual"))


def manual_links(spark: SparkSession, config: dict = MANUAL_LINKS) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, b in config.items()], "a_id string, b_ids array<string>")


def valid_manual(manual: DataFrame, refs: DataFrame, models: DataFrame) -> DataFrame:
    """Manual links whose reference line and model lines all exist."""
    each = manual.join(refs.select(F.col("id").alias("a_id")), "a_id", "left_semi").withColumn("b_id", F.explode("b_ids"))
    missing = each.join(models.select(F.col("id").alias("b_id")), "b_id", "left_anti").select("a_id").distinct()
    return manual.join(refs.select(F.col("id").alias("a_id")), "a_id", "left_semi").join(missing, "a_id", "left_anti")


def fill_missing(links: DataFrame, refs: DataFrame) -> DataFrame:
    """A row for every reference line: those without a link are unmatched."""
    none = refs.select(F.col("id").alias("a_id")).join(links, "a_id", "left_anti")
    return links.unionByName(none.withColumn("matched", F.lit(False)), allowMissingColumns=True)


def forbid(links: DataFrame, never: DataFrame) -> DataFrame:
    """Lines that may never match are reset, whatever a pass has found."""
    f = never.select("a_id").distinct().withColumn("_never", F.lit(True))
    out = links.join(f, "a_id", "left")
    hit = F.coalesce("_never", F.lit(False))
    return out.withColumn("matched", F.col("matched") & ~hit).withColumn("b_ids", F.when(hit, F.array().cast("array<string>")).otherwise(F.col("b_ids"))).drop("_never")


def by_signature(a: DataFrame, b: DataFrame, near: float) -> DataFrame:
    """Lines with equal rounded ends and length; else, of lines whose ends lie near, the closest in length.

    a: (a_id, kind, sig), b: (b_id, kind, b_sig), sig as functions.geometry.signature gives it.
    """
    exact = first_gap(a.join(b, (F.col("sig") == F.col("b_sig")) & (a["kind"] == b["kind"])).select("a_id", "b_id", F.lit(0.0).alias("gap")))
    rest = a.join(exact, "a_id", "left_anti").select("a_id", "kind", "sig", F.col("sig.a.x").alias("ax"), F.col("sig.a.y").alias("ay"))
    other = b.select("b_id", F.col("kind").alias("b_kind"), "b_sig", F.col("b_sig.a.x").alias("bx"), F.col("b_sig.a.y").alias("by"))
    pairs = joins.cell_join(rest, other, ("ax", "ay"), ("bx", "by"), (near, near)).where("kind = b_kind")
    apart = lambda e: F.greatest(F.abs(F.col(f"sig.{e}.x") - F.col(f"b_sig.{e}.x")), F.abs(F.col(f"sig.{e}.y") - F.col(f"b_sig.{e}.y")))
    close = pairs.where((apart("a") < near) & (apart("b") < near))
    # Lengths are rounded, their differences are not: equal gaps must tie, or the last bits choose.
    return exact.unionByName(first_gap(close.select("a_id", "b_id", F.round(F.abs(F.col("sig.length") - F.col("b_sig.length")), 9).alias("gap"))))


def first_gap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy("a_id").orderBy("gap", "b_id"))).where("_n = 1").drop("_n")


def by_pattern(linked: DataFrame, models: DataFrame) -> DataFrame:
    """Lines of the model with the suffix of a linked one but another number, of a compatible voltage: parallels that were missed."""
    x = linked.select("a_id", F.col("id").alias("own"), F.col("kv").alias("own_kv"), S.id_pattern(F.col("id")).alias("own_pattern"), S.id_suffix(F.col("id")).alias("suffix"))
    y = models.select(F.col("id").alias("b_id"), F.col("kv").alias("b_kv"), S.id_pattern(F.col("id")).alias("b_pattern"), S.id_suffix(F.col("id")).alias("suffix"))
    return x.join(y, "suffix").where((F.col("own_pattern") != F.col("b_pattern")) & S.compatible(F.col("own_kv"), F.col("b_kv"))).select("a_id", "own", "b_id", "suffix", F.lit(0.9).alias("score"))


def by_contained_suffix(linked: DataFrame, models: DataFrame) -> DataFrame:
    """Model lines whose id holds the suffix of a linked one but not its number, of a compatible voltage.

    linked: (parallel_group, id, kv); models: (b_id, kv).  Gives (parallel_group, b_id, pattern, suffix).  Suffixes begin
    with a dash, so an id is looked up by all its endings from a dash on and by those cut at any later mark: an equality join
    with the linked lines' kinds, not with each of them.  An id of n marks holds at most n(n+1)/2 different numbers, so of a kind
    one number more than that is enough to find one that it doesn't hold.
    """
    x = linked.select("parallel_group", F.col("kv").alias("own_kv"), S.id_pattern(F.col("id")).alias("own_pattern"), S.id_suffix(F.col("id")).alias("suffix")).where("suffix <> ''")
    longest = models.agg(F.max(F.length("b_id")).alias("n")).first()["n"] or 0
    kind = ["parallel_group", "own_kv", "suffix"]
    turn = F.row_number().over(Window.partitionBy(*kind).orderBy("own_pattern"))
    numbers = x.where("own_pattern is not null").distinct().withColumn("_n", turn).where(F.col("_n") <= longest * (longest + 1) // 2 + 1)
    kinds = numbers.groupBy(*kind).agg(F.collect_list("own_pattern").alias("own_patterns"))
    n = F.length("b_id")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(F.col("b_id"), i, F.lit(1)) == "-")
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col("b_id"), i, k))))
    y = models.select("b_id", F.col("kv").alias("b_kv"), S.id_pattern(F.col("b_id")).alias("pattern"), F.explode(F.array_distinct(pieces)).alias("suffix")).where("pattern is not null")
    hit = y.join(kinds, "suffix").where(S.compatible(F.col("own_kv"), F.col("b_kv")) & F.exists("own_patterns", lambda p: ~F.contains(F.col("b_id"), p)))
    return hit.select("parallel_group", "b_id", "pattern", "suffix").distinct()


def largest_pattern(found: DataFrame) -> DataFrame:
    """(a_id, b_ids, score): of the candidates (a_id, b_id, pattern), all of the number that has most; the smaller number wins."""
    groups = found.groupBy("a_id", "pattern").agg(F.array_sort(F.collect_set("b_id")).alias("b_ids"))
    first = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc(F.size("b_ids")), "pattern"))
    return groups.withColumn("_n", first).where("_n = 1").select("a_id", "b_ids", F.lit(0.9).alias("score"))


def transfer(models: DataFrame, links: DataFrame, refs: DataFrame, columns: tuple[str, ...] = ("r", "x", "b"), tolerance: float = 1e-6) -> DataFrame:
    """Reference values on model lines with exactly one link, where they differ; `changed` counts them."""
    one = links.groupBy("b_id").agg(F.max("a_id").alias("a_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    values = one.join(refs.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"ref_{c}") for c in columns]), "a_id")
    out = models.join(values, models["id"] == values["b_id"], "left")
    moved = [F.coalesce(F.col(f"ref_{c}").isNotNull() & (F.col(c).isNull() | (F.abs(F.col(c) - F.col(f"ref_{c}")) > tolerance)), F.lit(False)) for c in columns]
    new = [F.when(m, F.col(f"ref_{c}")).otherwise(F.col(c)).alias(c) for c, m in zip(columns, moved, strict=True)]
    return out.select("id", *new, sum(m.cast("int") for m in moved).alias("changed"))
