"""Exact top-k by block-at-a-time pruning.

A term is a component: its integer value is the weight.  Rows are dealt to parts and
cut into blocks of neighbouring ids; a block has its forward index (the integer
rows) and the largest and least value of each term.  A query takes the blocks in the
order of their bounds, the summed term maxima of its signed weights, and stops when
the next bound falls below its k-th score; a bound equal to it is still looked at,
since a smaller id wins a tie.  Parts give k rows a query, and the best k of these win.

Queries come in chunks and meet each part once: a stated query set against all rows,
in blocks.  Sums are exact: in doubles while they stay below 2**53, in Python integers beyond.

Nulls: vectors that are null or hold null, NaN or infinite components, and rows
without id, take no part.  Vectors of different lengths don't meet.  Rows that share
the query's id are its own; other repeated rows count as rows.  With fewer than k
candidates all are returned; an empty table gives an empty one.  Only vec_id and embedding
are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import worker

BLOCK_ROWS, CHUNK_QUERIES = 64, 8192
#: Rows of a part, at most, and components of its rows together; small tables are cut into so many parts of so many rows at least.
PART_ROWS, PART_CELLS, SMALL_PARTS, SMALL_ROWS = 65_536, 8_000_000, 16, 4096
SCHEMA = "query_id long, vec_id long, score long"


def _matrix(column) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    x = np.floor(np.stack([np.asarray(r, dtype=np.float64) for r in rows]) * 256)
    if x.size and np.abs(x).max() ** 2 * max(1, x.shape[1]) >= 2.0**53:
        return np.array([[int(v) for v in r] for r in x], dtype=object)
    return x


class Blocks:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int = BLOCK_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.starts = np.arange(0, len(ids), size)
        self.ends = np.minimum(self.starts + size, len(ids))
        self.most = np.maximum.reduceat(self.rows, self.starts, axis=0)
        self.least = np.minimum.reduceat(self.rows, self.starts, axis=0)
        self.scored = 0

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores, best first."""
        bounds = self.most @ np.maximum(query, 0) + self.least @ np.minimum(query, 0)
        order = np.argsort(-bounds, kind="stable")
        ids, scores, at, step, kth = self.ids[:0], self.rows[:0, :0].sum(axis=1), 0, 4, None
        while at < len(order) and (kth is None or bounds[order[at]] >= kth):
            some = order[at : at + step]
            if kth is not None:
                some = some[bounds[some] >= kth]
            rows = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in some])
            rows = rows[self.ids[rows] != own]
            self.scored += len(rows)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.rows[rows] @ query])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            kth = scores[-1] if len(scores) == k else None
            at, step = at + step, step * 4
        return ids, scores


def _search(k: int, block: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        worker.release()
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            index = Blocks(rows["id"].to_numpy(), _matrix(rows["vector"]), block)
            weights = _matrix(queries["vector"])
            if weights.dtype != index.rows.dtype:
                weights, index = weights.astype(object), Blocks(index.ids, index.rows.astype(object), block)
            top = 2**63 - 1
            for own, query in zip(queries["id"].to_pylist(), weights, strict=True):
                ids, scores = index.search(own, query, k)
                out += [(own, int(i), max(-top - 1, min(top, int(s)))) for i, s in zip(ids, scores, strict=True)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, part: int | None = None, block: int = BLOCK_ROWS, chunk: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose id is divisible by `every`."""
    n = embeddings.agg(F.count("vec_id").alias("rows"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"), F.max(F.size("embedding")).alias("width")).first()
    if part is None:
        even = max(SMALL_ROWS, -(-n["rows"] // SMALL_PARTS))
        part = max(1, min(even, PART_ROWS, PART_CELLS // max(1, n["width"] or 1)))
    parts, chunks = max(1, -(-n["rows"] // part)), max(1, -(-n["queries"] // chunk))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.size("embedding").alias("width"), F.xxhash64("vec_id").alias("deal"))
    queries = rows.where(F.col("id") % every == 0).select("id", "vector", "width", F.pmod("deal", F.lit(chunks).cast("long")).alias("chunk")).distinct()
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rows = rows.select("id", "vector", "width", F.pmod("deal", F.lit(parts).cast("long")).alias("part"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    keys = ["width", "part", "chunk"]
    found = queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_search(k, block), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
