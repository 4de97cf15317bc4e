"""Mix sources to target weights by Pareto order sampling.

A source's target is met by whole copies of all its documents as long as they fit, and
for the rest by a sample without replacement of unequal probabilities: a document's
inclusion odds p/(1-p) are in proportion to its size, it has a uniform number u from its
id's hash, and its rank is u/(1-u) over these odds.  (What the odds are a multiple of is
the same within a source and changes no rank.)  The sample's size is fixed in words: the
documents of the least ranks are taken until the words left are used up.  The document
at the cut gives its first words only, so that the target is met exactly.

Words are counted once, into a narrow written table.  Cumulative sums run over (source,
rank bucket) totals first and inside a bucket then, so a source with most of the rows is
not sorted in one task.  Sources are rows of a small table; these, not the documents,
meet in one place.

Nulls: a null text has size 0; a null source is a source of its own, the last; a
null id is hashed as "null".  Empty documents and sources take 0 words.  Repeated
rows share their number and are told apart by nothing: which of them lies before
the cut does not change the result.  An empty table gives an empty table.  Other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import names, scratch

WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 1024
_UNIT = 16**13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of sources: sizes has (source, source_size).

    The words to share out are poured by weight; a source that reaches `most` times
    its size is full and what it can't take goes to the others by weight.  In the
    order of capacity over weight the full sources come first, so running sums tell
    which they are.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", (F.col("source_size") * most).cast("long"))
    t = t.withColumn("left_words", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("full", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left_words"))
    t = t.withColumn("place", F.row_number().over(by))
    level = F.min(F.when(~F.col("full"), F.struct("place", "left_words", "left_weight"))).over(everything)
    t = t.withColumn("level", level)
    poured = F.col("weight") * F.col("level.left_words") / F.col("level.left_weight")
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(poured).alias("target"))


def plan(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (and the columns in `keep`)."""
    others = [c for c in keep if c not in ("doc_id", "source")]
    inside = ("size", "u", "q", "bucket", "whole", "rest", "home", "least", "before", "start", "goal")
    size, u, q, bucket, whole, rest, home, least, before, start, goal = names.free(documents.select("doc_id", "source", *others), *(f"_{x}" for x in inside))
    number = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(_UNIT))
    docs = scratch.write(documents.select("doc_id", "source", *others, word_count(F.col("text")).alias(size), number.alias(u)), "sizes")
    per_source = targets(docs.groupBy("source").agg(F.sum(size).alias("source_size")), weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per_source = per_source.withColumn("whole", copies).withColumn("rest", F.rint(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    per_source = per_source.select(F.col("source").alias(home), F.col("whole").alias(whole), F.col("rest").alias(rest), F.struct("source_size", "target").alias(goal))
    rows = docs.join(per_source, F.col("source").eqNullSafe(F.col(home))).drop(home)
    rows = rows.withColumn(q, F.col(u) / (1 - F.col(u)) / F.greatest(F.col(size), F.lit(1)))
    spread = F.floor((F.ln(F.col(q)) + 40) * (_BUCKETS / 64))
    rows = rows.withColumn(bucket, F.greatest(F.lit(0), F.least(F.lit(_BUCKETS - 1), spread)).cast("int"))
    sums = rows.groupBy(F.col("source").alias(home), F.col(bucket).alias(least)).agg(F.sum(size).alias("n"))
    up_to = Window.partitionBy(home).orderBy(least).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(home, least, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias(start))
    own = Window.partitionBy("source", bucket).orderBy(q, "doc_id", size).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(before, F.coalesce(F.sum(size).over(own), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col(home)) & (F.col(bucket) == F.col(least)))
    extra = F.greatest(F.lit(0), F.least(F.col(size), F.col(rest) - F.col(start) - F.col(before)))
    taken = (F.col(whole) * F.col(size) + extra).cast("long")
    return rows.select("doc_id", *[c for c in keep if c != "doc_id"], F.col(size).alias("size"), F.col(goal)["source_size"].alias("source_size"), F.col(goal)["target"].alias("target"), taken.alias("taken"))


def apply(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself, in the columns of documents: a row for each whole copy and one for the first words of a document at a cut.

    The plan is made on narrow rows; texts move once, to meet their copies.  Rows that
    are equal in all columns stand together for the sum of their copies.
    """
    key, own, copies, part, piece = names.free(documents, "key", "own", "copies", "part", "piece")
    values = [F.col(c) for c, t in documents.dtypes if not t.startswith("map")]
    keyed = documents.withColumn(key, F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b")))  # 64 bits alone would meet by chance among 10^10 rows
    rows = plan(keyed.select("doc_id", "text", "source", F.col(key).alias("_own")), weights, share, most, keep=["_own"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rows = rows.where("taken > 0").select(F.col("_own").alias(own), whole.alias(copies), (F.col("taken") - whole * F.col("size")).cast("int").alias(part))
    takes = rows.groupBy(own).agg(F.sum(copies).cast("int").alias(copies), F.max(part).alias(part))
    met = keyed.join(takes, F.col(key) == F.col(own)).dropDuplicates([key])
    pieces = F.concat(F.array_repeat(F.lit(-1), F.col(copies)), F.when(F.col(part) > 0, F.array(F.col(part))).otherwise(F.array().cast("array<int>")))
    met = met.withColumn(piece, F.explode(pieces))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.greatest(F.col(piece), F.lit(1))), "")
    text = F.when(F.col(piece) < 0, F.col("text")).otherwise(first)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns])
