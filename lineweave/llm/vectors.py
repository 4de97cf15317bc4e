"""Near-duplicate vectors by binary codes of randomised rotations.

A unit vector is turned by random orthogonal matrices side by side (a longer vector of
length 1); the packed signs are its code, and the inner product of the code with the
turned vector is stored as the code's correction factor, next to the vector itself in
small whole numbers with random rounding.  Code against another's small numbers, over the
factor, estimates an inner product without bias.  What the code misses of its own vector
points anywhere across it, so a pair at the threshold lies within a known spread of its
estimate: pairs whose estimate plus bound stays below the threshold are done.

Candidates come from the signs of further rotations, cut into bands (buckets within
a label).  Buckets meet in bounded tasks (blocks.py), which read codes only and name the
vectors of undecided pairs; the full vectors of these, and no others, are fetched, and the
undecided pairs are computed exactly, in double precision: only they can link.  Tasks give
link counts and a spanning forest, never pairs.  At cosine 0.98 a pair shares none of 60
bands of 20 signs with odds of about 8e-9, and six spreads miss one with odds of 2e-9.
Vectors of a label that are equal (by a 128-bit hash) are one node with a count.

Nulls: rows without label or vector, with a null, NaN or infinite component, or all
zero, link with nothing and are their own component.  Vectors of different lengths
don't link.  Repeated rows are vectors of their own that link with each other; a
null id is passed over when the least id is taken.  Only vec_id, label and embedding are
read, whatever other columns are called.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import blocks, components, scratch, worker

BANDS, BITS = 60, 20
COSINE = 0.98
#: Bits of a code, at least: as many as whole rotations give.
CODE_BITS = 256
#: Bounds are this many times the estimate's standard deviation.
SPREAD = 6.0
#: Vectors of a block; a task holds two blocks.
BLOCK_VECTORS = 1000
#: Estimates say little in fewer dimensions; all pairs are computed exactly there.
LEAST_DIMENSIONS = 16


@lru_cache(maxsize=8)
def rotations(dimension: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random orthogonal matrices side by side, `bits` columns."""
    rng = np.random.Generator(np.random.PCG64([seed, dimension]))
    parts = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-bits // dimension))]
    return np.hstack(parts)[:, :bits]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Codes, factors and small whole numbers of unit vectors of one dimension."""

    def __init__(self, dimension: int, bits: np.ndarray, factor: np.ndarray, small: np.ndarray, scale: np.ndarray):
        self.dimension, self.bits, self.factor, self.small, self.scale = dimension, bits, factor, small, scale

    @staticmethod
    def turn(dimension: int) -> np.ndarray:
        """Rotations side by side, of which each column pair keeps inner products."""
        bits = dimension * -(-CODE_BITS // dimension)
        return rotations(dimension, bits, seed=11) / np.sqrt(bits // dimension)

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        d = x.shape[1]
        turned = x @ cls.turn(d)
        signs = turned >= 0
        factor = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        scale = np.abs(x).max(axis=1) / 126
        rng = np.random.Generator(np.random.PCG64([3, d]))
        small = np.floor(x / scale[:, None] + rng.random(d)[None, :]).astype(np.int8)
        return cls(d, np.packbits(signs, axis=1), factor.astype(np.float32), small, scale.astype(np.float32))

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.dimension, self.bits[at], self.factor[at], self.small[at], self.scale[at])

    def pointers(self) -> np.ndarray:
        """What a code says of its vector, over the factor."""
        turn = self.turn(self.dimension).astype(np.float32)
        signs = np.unpackbits(self.bits, axis=1, count=turn.shape[1]).astype(np.float32) * 2 - 1
        return signs @ turn.T / np.sqrt(np.float32(turn.shape[1])) / self.factor[:, None]

    def undecided(self, other: Codes, cosine: float) -> np.ndarray:
        """Which pairs (own by other) the estimate and its bound don't rule out."""
        if self.dimension < LEAST_DIMENSIONS:
            return np.ones((len(self.factor), len(other.factor)), dtype=bool)
        point = other.pointers()
        estimate = (self.small.astype(np.float32) @ point.T) * self.scale[:, None]
        count = self.turn(self.dimension).shape[1]
        f = other.factor.astype(np.float64)
        missed = np.sqrt(np.maximum(0.0, 1 - f**2)) / f * np.sqrt(1 - cosine**2) / np.sqrt(count - 1)
        rounded = self.scale.astype(np.float64)[:, None] * (np.linalg.norm(point, axis=1) / 2)[None, :]
        return estimate + SPREAD * (missed[None, :] + rounded) + 1e-5 >= cosine


def _describe(nodes: DataFrame, bands: int, bits: int) -> DataFrame:
    """The nodes with their band values and codes."""
    kinds = [("values", pa.list_(pa.int64())), ("bits", pa.binary()), ("factor", pa.float32()), ("small", pa.binary()), ("scale", pa.float32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_numpy(zero_copy_only=False)
            out: dict[str, list] = {k: [None] * len(vectors) for k, _ in kinds}
            lengths = np.array([len(v) for v in vectors], dtype=int)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = unit(np.stack([np.asarray(vectors[i], dtype=np.float64) for i in at]))
                signs = (x @ rotations(int(d), bands * bits)) >= 0
                values = signs.reshape(len(at), bands, bits) @ (1 << np.arange(bits))
                codes = Codes.of(x)
                for j, i in enumerate(at):
                    out["values"][i], out["bits"][i], out["small"][i] = values[j].astype(np.int64), codes.bits[j].tobytes(), codes.small[j].tobytes()
                    out["factor"][i], out["scale"][i] = codes.factor[j], codes.scale[j]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[k], t) for k, t in kinds]], [*batch.schema.names, *out])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(worker.resting(run), f"{schema}, values array<long>, bits binary, factor float, small binary, scale float")


def linked(a: np.ndarray, b: np.ndarray, cosine: float, undecided: np.ndarray | None = None) -> np.ndarray:
    """Which rows of a (unit vectors) and b have at least that cosine: the undecided pairs are computed."""
    x, y = np.nonzero(Codes.of(a).undecided(Codes.of(b), cosine) if undecided is None else undecided)
    out = np.zeros((len(a), len(b)), dtype=bool)
    for i in range(0, len(x), 100_000):
        p, q = x[i : i + 100_000], y[i : i + 100_000]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
    return out


def _stored(table: pa.Table, at: np.ndarray) -> Codes:
    rows = table.take(pa.array(at))
    matrix = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in rows[c]), dtype=t).reshape(len(at), -1)
    small = matrix("small", np.int8)
    return Codes(small.shape[1], matrix("bits", np.uint8), rows["factor"].to_numpy(), small, rows["scale"].to_numpy())


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of a task to compare, label by label: those of side 0, those of side 1 (or again those of side 0), whether they are the same."""
    kinds, sides = table["kind"].to_numpy(), table["side"].to_numpy()
    alone = not (sides == 1).any()
    for kind in np.unique(kinds):
        left = np.flatnonzero((kinds == kind) & (sides == 0))
        right = left if alone else np.flatnonzero((kinds == kind) & (sides == 1))
        if len(left) and len(right):
            yield left, right, alone


def _undecided(cosine: float):
    """Names the vectors of undecided pairs."""

    def run(table: pa.Table) -> pa.Table:
        worker.release()
        wanted = np.zeros(table.num_rows, dtype=bool)
        for left, right, alone in _sides(table):
            open_pairs = _stored(table, left).undecided(_stored(table, right), cosine)
            if alone:
                np.fill_diagonal(open_pairs, False)
            wanted[left] |= open_pairs.any(axis=1)
            wanted[right] |= open_pairs.any(axis=0)
        return table.select(["task", "side", "node"]).filter(pa.array(wanted))

    return run


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        worker.release()
        nodes, many, vectors = table["node"].to_numpy(), table["many"].to_numpy(), table["vector"].to_numpy()
        edges: list[tuple[int, int, int]] = []
        for left, right, alone in _sides(table):
            a, b = (unit(np.stack([np.asarray(vectors[i], dtype=np.float64) for i in at])) for at in (left, right))
            hit = linked(a, b, cosine, _stored(table, left).undecided(_stored(table, right), cosine))
            if alone:
                hit |= hit.T
                np.fill_diagonal(hit, False)
            x, y = np.nonzero(hit)
            ids = left if alone else np.concatenate([left, right])
            roots = blocks.local_roots(len(ids), x.tolist(), (y if alone else y + len(left)).tolist())
            count = hit @ many[right] if alone else np.concatenate([hit @ many[right], hit.T @ many[left]])
            edges += [(int(nodes[ids[i]]), int(nodes[ids[r]]), int(n)) for i, (r, n) in enumerate(zip(roots, count, strict=True)) if n]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64()), "links": pa.array([e[2] for e in edges], pa.int64())})

    return run


def groups(embeddings: DataFrame, cosine: float = COSINE, bands: int = BANDS, bits: int = BITS, block: int = BLOCK_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound
    same = ["same_a", "same_b"]
    hashes = [F.xxhash64("label", "embedding"), F.xxhash64("embedding", "label", F.lit(1))]
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), *[F.when(F.coalesce(valid, F.lit(False)), h).alias(c) for c, h in zip(same, hashes, strict=True)], F.xxhash64(F.col("label"), F.size("embedding")).alias("kind"), F.col("embedding").alias("vector"))
    nodes = rows.where("same_a is not null").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"), F.first("kind").alias("kind"), F.first("vector").alias("vector"))
    nodes = scratch.write(_describe(nodes.withColumn("node", F.monotonically_increasing_id()), bands, bits), "vectors")
    members = nodes.select("node", "kind", F.posexplode("values").alias("band", "value")).select("node", F.xxhash64("kind", "band", "value").alias("key"))
    tasks = scratch.write(blocks.comparisons(members.distinct(), nodes.select("node", F.lit(1).cast("long").alias("weight")), block), "tasks")
    codes = ["node", "kind", "bits", "factor", "small", "scale"]
    some = tasks.join(nodes.select(*codes), "node").groupBy("task").applyInArrow(_undecided(cosine), "task long, side int, node long")
    work = scratch.write(some, "undecided").join(nodes.select(*codes, "many", "vector"), "node")
    found = scratch.write(work.groupBy("task").applyInArrow(_compare(cosine), "a long, b long, links long"), "links", instead_of=[tasks])
    roots = components.connect(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = nodes.select("node", *same, "least", "many").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(per_root, "root").join(counts, "node", "left")
    labels = labels.select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"))
    out = rows.select("vec_id", *same).join(labels, same, "left")
    component = F.when(F.col("same_a").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
