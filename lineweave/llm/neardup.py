"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity.

Signatures: shingle hashes go through one permutation of 32-bit numbers (sigma);
a second one (pi) is used again and again, shifted circularly by 1 more for each
coordinate, so two permutations give all coordinates.  Bands of coordinates are
hashed to buckets; texts with equal shingle sets (by a 128-bit digest) are one node
from the start.
Nodes of a bucket meet in bounded tasks (blocks.py), where the full sets of all
pairs are intersected; what a task finds leaves it as a spanning forest, and
components.py joins the forests.

With 32 bands of 4 coordinates a pair at the threshold of 0.75 shares no bucket with
odds of about 5e-6, and closer pairs with less; there is no other way to miss a link.

Nulls: a null or empty text has no shingles, links with nothing and is its own
component; a null id is passed over when the least id is taken, and a document
without id is kept only as a component without any.  Long texts are taken whole.
Repeated rows and equal texts share a component.  Only id and text are read, whatever
other columns are called; `keep_one` gives them all back.  An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import blocks, bytescan, components, names, scratch, worker

BANDS, ROWS = 32, 4
WORDS = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles of a block; a task holds two blocks.
BLOCK_SHINGLES = 200_000
_TOP = np.uint32(0xFFFFFFFF)


def sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32-bit numbers."""
    x = x ^ (x >> np.uint32(15))
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, the one that is shifted."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least pi(sigma(s) + k) over the shingles."""
    first = sigma((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, _TOP)
    for i in range(0, len(first), 1024):
        np.minimum(least, pi(first[None, i : i + 1024] + shifts).min(axis=1), out=least)
    return least


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = (sign.reshape(bands, rows).astype(np.uint64) * bytescan.SHINGLE_MULT[:rows]).sum(axis=1, dtype=np.uint64)
    return bytescan.mix(keys ^ (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(56)))


def set_id(shingles: np.ndarray) -> np.ndarray:
    """128 bits of the set, as two numbers."""
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype="<i8")


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def describe(documents: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key_a, key_b, n_shingles, set_a, set_b, keys) of each document; without words no set and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            n, ids, keys = [], [], []
            for value in batch.column(3):
                s = bytescan.shingles(_raw(value), words)
                n.append(len(s))
                ids.append(set_id(s).tolist() if len(s) else (None, None))
                keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else None)
            numbers = [pa.array(x, pa.int64()) for x in (n, [i[0] for i in ids], [i[1] for i in ids])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *numbers, pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", *names.KEY, "n_shingles", "set_a", "set_b", "keys"],
            )

    return _keyed(documents).mapInArrow(worker.resting(run), "doc_id long, key_a long, key_b long, n_shingles long, set_a long, set_b long, keys array<long>")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), *names.row_key(), F.col("text").cast("binary").alias("text"))


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of incidence matrices."""
    every, sets = np.concatenate([*a, *b]), [*a, *b]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.r_[True, every[1:] != every[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    step = max(256, 8_000_000 // len(sets))
    for low in range(0, int(column[-1]) + 1, step):
        here = slice(*np.searchsorted(column, [low, low + step]))
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[owner[here], column[here] - low] = 1
        out += (m[: len(a)] @ m[len(a) :].T).astype(np.int64)
    return out


def _compare(percent: int, words: int):
    def run(table: pa.Table) -> pa.Table:
        worker.release()
        sides: tuple[dict, dict] = {}, {}
        for node, side, text in zip(table["node"].to_pylist(), table["side"].to_pylist(), table["text"], strict=True):
            if node not in sides[side]:  # copies of a row share its key
                sides[side][node] = bytescan.shingles(_raw(text), words)
        left, right = sides[0], sides[1] or sides[0]
        a, b = list(left.values()), list(right.values())
        ids = [*left, *(right if sides[1] else [])]
        shift = len(left) if sides[1] else 0
        out: list[tuple[int, int]] = []
        if a and b:
            common = intersections(a, b)
            sizes_a, sizes_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
            x, y = np.nonzero(100 * common >= percent * (sizes_a[:, None] + sizes_b[None, :] - common))
            roots = blocks.local_roots(len(ids), x.tolist(), (y + shift).tolist())
            out = [(ids[i], ids[r]) for i, r in enumerate(roots) if i != r]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _labelled(documents: DataFrame, words: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """(doc_id, key_a, key_b, n_shingles, component_id, one) of each document; one: whether its row stands for the component, null without words."""
    found = scratch.write(describe(documents, words, bands, rows), "signatures")
    sets, same = found.where("set_a is not null"), ["set_a", "set_b"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names.KEY))
    nodes = sets.groupBy(*same).agg(F.min("n_shingles").alias("weight"), first.alias("first"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", *same, "first.key_a", "first.key_b")
    members = sets.join(keyed, [*same, *names.KEY]).select("node", F.explode("keys").alias("key")).distinct()
    tasks = blocks.comparisons(members, nodes.select("node", "weight"), block).join(keyed.drop(*same), "node")
    texts = _keyed(documents).select(*names.KEY, "text").join(tasks, names.KEY).select("task", "side", "node", "text")
    links = texts.groupBy("task").applyInArrow(_compare(percent, words), "a long, b long")
    roots = components.connect(links)
    rooted = nodes.select("node", *same, "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("root").agg(F.min("first").alias("first"))
    labels = rooted.select(*same, "root").join(per_root, "root").select(*same, F.col("first.doc_id").alias("component_id"), F.struct("first.key_a", "first.key_b").alias("chosen"))
    out = found.select("doc_id", *names.KEY, "n_shingles", *same).join(labels, same, "left")
    alone = F.col("set_a").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    one = F.when(~alone, F.struct(*names.KEY) == F.col("chosen"))
    return out.select("doc_id", *names.KEY, "n_shingles", component.alias("component_id"), one.alias("one"))


def groups(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    out = _labelled(documents, words, percent, bands, rows, block)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents, all their columns, with one row of each component, that of the least id; all documents without words stay."""
    labels = _labelled(documents, words, percent, bands, rows, block)
    key_a, key_b, single = names.free(documents, "key_a", "key_b", "single")
    keys = [key_a, key_b]
    stay = labels.where("one is null or one").groupBy(F.col("key_a").alias(key_a), F.col("key_b").alias(key_b)).agg(F.max(F.col("one").isNotNull()).alias(single))
    kept = documents.withColumns(dict(zip(keys, names.row_key(), strict=True))).join(stay, keys)
    once = kept.where(F.col(single)).dropDuplicates(keys)
    return once.unionByName(kept.where(~F.col(single))).select(*documents.columns)
