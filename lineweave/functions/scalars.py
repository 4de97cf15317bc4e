"""Scalar semantics of grid records as column functions: numbers, units, voltages, ids, labels.

All stay inside generated code; none is a UDF.  Text that is no number gives null, and NaN
counts as null from the start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Operators of the national grid, as they appear in free text.
NATIONAL_OPERATORS = ("50hertz", "amprion", "tennet", "transnetbw")
# Score bands and their labels.
QUALITY_BANDS = ((0.8, "Excellent Match"), (0.6, "Good Match"), (0.4, "Fair Match"))
RATING_BANDS = ((0.85, "Excellent"), (0.7, "Good"), (0.5, "Fair"))
QUALITY_WORDS = ("Bus-Based", "Excellent", "Good", "Fair", "Visual", "Desperate")


def _number(c: Column) -> Column:
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def safe_int(c: Column) -> Column:
    """Truncated whole number; 0 where there is none."""
    return F.coalesce(_number(c).cast("int"), F.lit(0))


def num(c: Column) -> Column:
    return _number(c)


def locale_num(c: Column) -> Column:
    """A comma without a dot is a decimal comma; with a dot, commas part thousands."""
    s = F.regexp_replace(c.cast("string"), "[\\s ]", "")
    decimal = (F.instr(s, ",") > 0) & (F.instr(s, ".") == 0)
    return _number(F.when(decimal, F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(""))))


def to_km(c: Column, inclusive: bool = True) -> Column:
    """Kilometres of a length that may be in metres, by magnitude."""
    large = F.abs(c) >= 1000 if inclusive else c > 1000
    return F.when(large, c / 1000).otherwise(c)


def kv_max(c: Column) -> Column:
    """The largest voltage of a free text, in kV; volts are recognised by size."""
    text = F.replace(F.lower(c.cast("string")), F.lit(","), F.lit("."))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_max(F.transform(found, lambda v: F.when((v >= 1000) & (v % 1000 == 0), v / 1000).otherwise(v)))


def kv_number(c: Column) -> Column:
    """First token before a hyphen; direct current is null."""
    return F.when(F.upper(c).contains("DC"), F.lit(None)).otherwise(_number(F.split(c, "-")[0]))


def kv_bucket(kv: Column) -> Column:
    return F.when(kv.isNull(), "unknown").when((kv >= 200) & (kv < 260), "220-225").when((kv >= 360) & (kv <= 420), "380-400").otherwise("other")


def kv_bucket_wide(kv: Column) -> Column:
    return F.when(kv >= 300, "380").when((kv >= 200) & (kv < 300), "220").otherwise("other")


def kv_class(kv: Column, dc: Column) -> Column:
    return F.when(dc, "DC").when((kv >= 100) & (kv < 200), "110kV").when((kv >= 200) & (kv < 300), "220kV").when(kv >= 300, "400kV").otherwise("other")


def eligible_kv(kv: Column) -> Column:
    return F.coalesce(((kv >= 200) & (kv < 260)) | ((kv >= 360) & (kv <= 420)), F.lit(False))


def canonical_kv(kv: Column) -> Column:
    """380 and 400 are one level, 220 and 225 another."""
    return F.when(kv.isin(380, 400), 400).when(kv.isin(220, 225), 220).otherwise(kv.cast("int"))


def _ehv(kv: Column) -> Column:
    return kv.isin(380, 400)


def compatible(a: Column, b: Column, rule: str = "strict") -> Column:
    both = _ehv(a) & _ehv(b)
    if rule == "strict":
        out = ((a == 220) & (b == 220)) | both
    elif rule == "equal":
        out = (a == b) | both
    elif rule == "lenient":
        out = (a == b) | both | ((a == 220) & b.isin(220, 380, 400))
    else:
        raise ValueError(rule)
    return F.coalesce(out, F.lit(False))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def pct_of_base(base: Column, value: Column) -> Column:
    """Percent above the base; of nothing, 0 or 100."""
    return F.when(base == 0, F.when(value == 0, 0.0).otherwise(100.0)).otherwise((value - base) / base * 100)


def pct_or_null(a: Column, b: Column, least: float = 1e-9) -> Column:
    return F.when(F.abs(b) >= least, 100 * (a - b) / F.abs(b))


def pct_share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b * 100).otherwise(0.0)


def residual_pct(total: Column, allocated: Column) -> Column:
    return F.when(F.abs(total) >= 1e-12, 100 * (allocated - total) / F.abs(total))


def diff_bin(p: Column) -> Column:
    return F.when(p.isNull(), "undefined").when(F.abs(p) <= 20, "good").when(p > 50, "above-50").when(p < -50, "below-50").when(p > 20, "above-20").otherwise("below-20")


def residual_bin(p: Column) -> Column:
    return F.when(p.isNull(), "none").when(F.abs(p) <= 10, "good").when(F.abs(p) <= 30, "fair").otherwise("poor")


def id_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def id_pattern(c: Column) -> Column:
    """The number of a map object in an id."""
    tries = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"/(\d+)-", r"relation/(\d+)", r"way/(\d+)")]
    return F.coalesce(*tries)


def id_suffix(c: Column) -> Column:
    """What stands behind that number."""
    p = id_pattern(c)
    return F.when(p.isNotNull(), F.substr(c, F.position(p, c) + F.length(p)))


def national(*columns: Column) -> Column:
    """Any column names one of the national grid operators."""
    hits = [F.lower(F.coalesce(c, F.lit(""))).contains(name) for c in columns for name in NATIONAL_OPERATORS]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def whole_or_null(c: Column) -> Column:
    return F.rint(_number(c)).cast("int")


def quality_label(score: Column, segments: Column, parallel: Column) -> Column:
    label = F.lit("Poor Match")
    for least, text in reversed(QUALITY_BANDS):
        label = F.when(score >= least, text).otherwise(label)
    label = F.concat(F.when(segments > 1, F.concat(segments.cast("string"), F.lit("-Segment "))).otherwise(""), label)
    return F.concat(F.when(parallel, "Parallel Circuit - ").otherwise(""), label)


def quality_rating(score: Column) -> Column:
    label = F.lit("Poor")
    for least, text in reversed(RATING_BANDS):
        label = F.when(score >= least, text).otherwise(label)
    return label


def quality_category(quality: Column) -> Column:
    label = F.lit("Poor")
    for word in reversed(QUALITY_WORDS):
        label = F.when(quality.contains(word), word).otherwise(label)
    return label


def first_true(*cases: tuple[Column, str], default: str) -> Column:
    """The label of the first flag that is set: match types and statuses with their precedence."""
    out = F.lit(default)
    for flag, label in reversed(cases):
        out = F.when(flag, label).otherwise(out)
    return out


def unmatched_reasons(kv: Column, length_km: Column, bus0: Column, bus1: Column, near: Column) -> Column:
    has_bus = (F.coalesce(bus0, F.lit("")) != "") & (F.coalesce(bus1, F.lit("")) != "")
    found = F.concat_ws(
        "; ",
        F.when(~F.coalesce(kv.isin(220, 380, 400), F.lit(False)), "Non-standard voltage class"),
        F.when(length_km < 1, "Very short line (<1km)"),
        F.when(~has_bus, "Missing bus connections"),
        F.when(~near, "No nearby reference lines"),
    )
    other = F.when(length_km > 20, "Long line, possible cross-border or in area not covered by the reference").otherwise("Unknown (may be duplicate path or parallel circuit)")
    return F.when(found != "", found).otherwise(other)


def electrical_similarity(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """1 less the mean capped relative error over parameters that are positive on both sides; 0.5 without any."""
    errors = F.filter(F.array(*[F.when((x > 0) & (y > 0), F.least(F.abs(x - y) / x, F.lit(1.0))) for x, y in zip(a, b, strict=True)]), lambda e: e.isNotNull())
    total = F.aggregate(errors, F.lit(0.0), lambda s, e: s + e)
    return F.when(F.size(errors) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - total / F.size(errors)))


def coverage_points(ratio: Column) -> Column:
    """Points of a match's coverage, by bands around 1."""
    return (
        F.when(ratio.between(0.9, 1.1), 20).when(ratio.between(0.8, 1.2), 15).when(ratio.between(0.7, 1.3), 10).when(ratio.between(0.5, 1.5), 5).otherwise(0)
    )


def find_column(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that df has, exactly or else without regard to case."""
    for c in candidates:
        if c in df.columns:
            return c
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def first_of(df: DataFrame, *candidates: str) -> Column:
    """Null-safe choice over the candidates that df has."""
    have = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def with_id(df: DataFrame, prefix: str = "line_", order: str | None = None) -> DataFrame:
    """An `id` column: the table's, else its name column, else numbers in order.

    Which one is used is a decision on the whole table, so it is taken by one small
    aggregate.  Numbers count within range partitions by prefix sums of their sizes.
    """
    filled = [F.max((F.trim(F.col(c).cast("string")) != "").cast("int")).alias(c) for c in ("id", "name", "NE_name") if c in df.columns]
    has = df.agg(*filled).first().asDict() if filled else {}
    for c in ("id", "name", "NE_name"):
        if has.get(c):
            return df.withColumn("id", F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    part = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    if order:
        part = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = part.join(starts, "_part").withColumn("id", F.concat(F.lit(prefix), (F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1).cast("string")))
    return numbered.drop("_part", "_at", "_start")
