"""Rendezvous hashing of stable record keys over weighted shards, in column functions only.

Each (key, shard) pair has a uniform number u from md5; the shard with the least
-ln(u) / weight takes the record.  A new shard can only win records for itself, so
growing from n to n + 1 shards moves about 1 / (n + 1) of them and no other.

Nulls: a null key is a key of its own; a null text counts no bytes and has the
checksum of the empty text.  Repeated rows get the same shard and slots of their
own.  An empty table gives an empty table.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import names

#: Slots are numbered in this many pieces of a shard, so that no task sorts a whole shard.
SLOT_PIECES = 4096
_HEX = 13  # 52 bits, exact in a double


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes a key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    text = _key_text(key)
    cost = [
        F.struct((-F.ln((_number(F.concat(text, F.lit(f"@{i}")), _HEX) + F.lit(0.5)) / F.lit(float(16**_HEX))) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*cost))["shard"]


def with_shard(df: DataFrame, key: str, weights: Sequence[float], column: str = "shard") -> DataFrame:
    """df with the shard of each row; a column of that name is replaced."""
    return df.withColumn(column, choose(F.col(key), weights))


def with_slot(df: DataFrame, shard: str, key: str, order: Sequence[str], column: str = "slot", pieces: int = SLOT_PIECES) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is numbered in `pieces` parts, dealt by the key's hash; the counts of
    all parts (shards x pieces rows) are the only data that is brought together.
    `pieces` should grow with the table so that one part sorts in memory.
    """
    digits = len(f"{pieces - 1:x}")
    if pieces != 16**digits:
        raise ValueError("pieces must be a power of 16")
    piece_, s_, p_, n_, start_, r_ = names.free(df, "piece", "s", "p", "n", "start", "r")
    piece = _number(F.concat(_key_text(F.col(key)), F.lit("#")), digits)
    rows = df.withColumn(piece_, piece)
    counts = rows.groupBy(F.col(shard).alias(s_), F.col(piece_).alias(p_)).agg(F.count(F.lit(1)).alias(n_))
    before = F.coalesce(F.sum(n_).over(Window.partitionBy(s_).orderBy(p_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(s_, p_, before.alias(start_))
    within = F.row_number().over(Window.partitionBy(shard, piece_).orderBy(*order))
    joined = rows.withColumn(r_, within).join(starts, (F.col(shard) == F.col(s_)) & (F.col(piece_) == F.col(p_)))
    return joined.withColumn(column, (F.col(start_) + F.col(r_) - 1).cast("long")).drop(piece_, s_, p_, start_, r_)


def assign(documents: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        choose(F.col("doc_id"), weights).alias("shard"),
        choose(F.col("doc_id"), [*weights, weights[-1]]).alias("grown_shard"),
    )
    out = with_slot(rows, "shard", "doc_id", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: str, weights: Sequence[float]) -> None:
    """One folder of Parquet files a shard."""
    with_shard(df, key, weights).write.partitionBy("shard").parquet(path)
