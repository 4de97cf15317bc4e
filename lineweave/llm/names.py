"""Names for columns that are added to a caller's table, and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["key_a", "key_b"]


def row_key() -> list[Column]:
    """128 bits of a document's id and text, which its copies share: 64 would meet by chance among 10^10 rows."""
    return [F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("key_b")]


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that df has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
