"""Quality by compression: two zstandard dictionaries, one built from good and one from bad labelled texts.

A text is compressed, whole, in pieces of 4 KB against either dictionary.  The
difference of the two sizes over the larger, the length and the plain compression
ratio go into a logistic calibration, fitted on labelled texts that are in neither
dictionary.  Dictionaries and calibration are learnt from a bounded sample of whole
texts (`Bounds`), the rows of the least id hashes; dictionaries take the texts of at
most a piece among them.  Scoring is one map over all rows.

Nulls: a null or empty text has difference 0 and ratio 1 and gets the calibrated
score of that.  Label rows with a null id or label, and ids with both labels, teach
nothing; with too few labels of a class the score is the share of label 1 (0.5 where there
are none).  Very long texts are compressed whole, piece after piece.  Equal texts and repeated
rows get equal scores; only id and text are read, whatever other columns are called, and
`keep_good` gives them all back.  An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import worker

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Bounds:
    """The sample that learning may read, of each class: texts for the dictionary, texts for the calibration, bytes of all of them.

    Texts are taken whole; one of more than `longest` bytes is no part of the sample.
    """

    dictionary_texts: int = 600
    calibration_texts: int = 1500
    sample_bytes: int = 32 << 20
    longest: int = 1 << 20
    dictionary_bytes: int = 112_640


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: list[float] = field(default_factory=lambda: [0.0] * 3)
    spread: list[float] = field(default_factory=lambda: [1.0] * 3)
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)
    piece: int = 4096
    level: int = 3


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = (self._coder(x) for x in (model.good, model.bad))
        self.plain = zstandard.ZstdCompressor(level=model.level)

    def _coder(self, raw: bytes) -> zstandard.ZstdCompressor:
        if not raw:
            return zstandard.ZstdCompressor(level=self.model.level)
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=self.model.level)
        return zstandard.ZstdCompressor(level=self.model.level, dict_data=d, write_content_size=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 1.0
        step = self.model.piece
        good = bad = plain = 0
        for i in range(0, len(text), step):
            piece = text[i : i + step]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
            plain += len(self.plain.compress(piece))
        return (bad - good) / max(good, bad), math.log(len(text)), plain / len(text)

    def score(self, text: bytes) -> float:
        m = self.model
        z = m.weights[0] + sum(w * (x - a) / s for w, x, a, s in zip(m.weights[1:], self.features(text), m.mean, m.spread, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, texts)) // 4)), texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def divide(texts: list[bytes], most: int, piece: int) -> tuple[list[bytes], list[bytes]]:
    """Texts for a dictionary, at most two thirds, and those for the calibration.

    Dictionaries take whole texts that fit in a piece, for a few long ones would fill
    them; where hardly any text is as short, texts of all lengths.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= piece]
    chosen = set((short if len(short) >= 4 else range(len(texts)))[: min(most, len(texts) * 2 // 3)])
    return [t for i, t in enumerate(texts) if i in chosen], [t for i, t in enumerate(texts) if i not in chosen]


def calibrate(model: Model, texts: list[bytes], labels: list[int], prior: float) -> Model:
    """A logistic fit by Newton steps; each class counts by its share of all labels, not of the sample."""
    scorer = Scorer(model)
    x, y = np.array([scorer.features(t) for t in texts]), np.array(labels, dtype=float)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.c_[np.ones(len(x)), (x - mean) / spread]
    each = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (each * (y - p)) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.good, model.bad, mean.tolist(), spread.tolist(), w.tolist(), model.piece, model.level)


def learn(documents: DataFrame, labels: DataFrame, bounds: Bounds = Bounds(), fold: int = 5) -> Model:
    """Dictionaries and calibration from the labelled texts that are not held out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    known = known.where(F.crc32(F.col("_id").cast("string").cast("binary")) % fold != 0)
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    share = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
    want = bounds.dictionary_texts + bounds.calibration_texts
    order = F.xxhash64("_id")
    chosen = None
    for label in (0, 1):  # at most 2 x want ids: a proven bound
        some = known.where(F.col("_label") == label).orderBy(order, "_id").limit(want)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = documents.select("doc_id", F.col("text").alias("_t")).where(F.octet_length("text").between(1, bounds.longest))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "_label").agg(F.min("_t").alias("_t"))
    so_far = F.sum(F.octet_length("_t")).over(Window.partitionBy("_label").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_h", order).withColumn("_sum", so_far).where(F.col("_sum") <= bounds.sample_bytes)  # what the driver gets is bounded in bytes too
    rows = sorted(rows.select("_label", "_h", "_id", "_t").collect())
    by = {k: [r["_t"].encode() for r in rows if r["_label"] == k] for k in (0, 1)}
    if min(map(len, by.values())) < 4:
        z = math.log(prior / (1 - prior))
        return Model(b"", b"", weights=[z, 0.0, 0.0, 0.0])
    (bad, rest_bad), (good, rest_good) = (divide(by[k], bounds.dictionary_texts, Model.piece) for k in (0, 1))
    model = Model(dictionary(good, bounds.dictionary_bytes), dictionary(bad, bounds.dictionary_bytes))
    return calibrate(model, rest_bad + rest_good, [0] * len(rest_bad) + [1] * len(rest_good), prior)


def score(documents: DataFrame, model: Model, threshold: float = 0.3, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        scorer = Scorer(model)
        for batch in batches:
            s = pa.array([scorer.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)], pa.float64())
            predicted = pa.array([int(x >= threshold) for x in s.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s, predicted], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return documents.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(worker.resting(run), SCHEMA)


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all their columns, that the classifier does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        scorer = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array([scorer.score(t.as_buffer().to_pybytes() if t.is_valid else b"") >= threshold for t in texts], pa.bool_()))

    return documents.mapInArrow(worker.resting(run), documents.schema)
