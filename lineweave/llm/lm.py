"""A probabilistic suffix tree over words, learnt and applied by exchanging packed counts.

States are contexts of up to `depth` words (the first after the start of a text too).  A context is
retained if it was seen `least` times, whatever the size of the input (longer ones `least_deep` times), and the divergence of
its next-symbol distribution from that of its suffix, times its count, passes a threshold: the
number of states grows with the corpus.  Distributions are smoothed by Witten-Bell into
those of the suffix (of a retained context also where the suffix is not retained itself), down
to the root, which keeps mass for one unknown word.  A token is scored in the longest state
that its history ends in.

Text is cut into words once: a chunk of documents becomes one row with its words as
numbers of the chunk's own vocabulary.  A chunk's counts go out as one packed row of
sorted hashes and counts a partition; partitions add them up over all chunks and answer each
chunk with totals in the order it asked, so hashes travel once and no key, however
frequent, makes a hot partition.  Words go first, then pairs whose first word is frequent
enough, then triples whose first two words are, and so on.  Of the chunks that asked for a key one is told
that it owns it: it adds the key to its context's followers and divergence, and these go to the
partition of the context, which judges it and answers all chunks that hold it.  No list of
states is gathered anywhere.  Tables are written in the shared folder, so lost executors repeat
tasks only.

Nulls: a null or empty text is its end token alone; a null id is no held-out id.
Words are identified by 64-bit hashes, and counts are 64-bit totals.  With no training
text, all probability is the unknown word's.  Repeated rows count as often as they stand.
Very long texts are taken whole.  Only id and text are read, whatever other columns are
called.  An empty table gives an empty one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import bytescan, scratch, worker

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Hash of the end token.
END = np.uint64(0x5EED0E4D)
_PAIR = bytescan.SHINGLE_MULT[:3]


@dataclass(frozen=True)
class Settings:
    #: A context of one word must be seen so often in training, and a longer one so often.
    least: int = 2
    least_deep: int = 4
    #: And make up this share of all training tokens; 0: no share is asked for.
    share: float = 0.0
    #: Retained: count times divergence from the suffix, in nats, of at least this and this per distinct follower.
    divergence: float = 3.0
    per_follower: float = 0.5
    #: Words of a context, at most.
    depth: int = 3
    #: Text bytes of a chunk.
    chunk_bytes: int = 6_000_000
    #: Text bytes for each partition that adds up counts, so that what a partition reads doesn't grow with the input.
    part_bytes: int = 16_000_000


def pack(x: np.ndarray) -> bytes:
    """Sorted or small integers as zstandard over the byte planes of their differences or values."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash: an equal share of the range, so that sorted keys are cut into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(part_of(keys, parts), np.arange(parts + 1))


class Chunk:
    """Documents as numbers of a vocabulary; the last of each is the end token."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.vocabulary, self.tokens, self.lengths, self.train = vocabulary, tokens, lengths, train
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def token_train(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def before(self) -> np.ndarray:
        """Number of the word before each token; the start of a text is the end token before it, as often seen as there are texts."""
        out = np.empty(len(self.tokens), dtype=np.int64)
        out[1:] = self.tokens[:-1]
        out[self.starts] = self.tokens[self.ends - 1]
        return out


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


_CHUNKS = "chunk long, kind int, part int, n long, a binary, b binary, c binary, d binary"
_CHUNK_NAMES = ["chunk", "kind", "part", "n", "a", "b", "c", "d"]
_CHUNK_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_CHUNK_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNK_TYPES, strict=True)], _CHUNK_NAMES)


def _number_words(documents: DataFrame, fold: int, held: int, parts: int, chunk_bytes: int) -> DataFrame:
    """Chunk rows (kind 0: documents; kind 1: word hashes and training counts of a partition)."""

    def flush(ids: list, valid: list, train: list, words: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        hashes = np.concatenate(words)
        trained = np.repeat(np.array(train, dtype=bool), lengths)
        keys, inverse = np.unique(hashes, return_inverse=True)
        counts = np.bincount(inverse, weights=trained, minlength=len(keys)).astype(np.uint32)
        chunk = int.from_bytes(os.urandom(7), "big")  # the table is committed once: later steps all read the same names
        # Frequent words get small numbers, which pack well; `rank` leads from the sorted keys to them.
        rank = np.empty(len(keys), dtype=np.uint32)
        rank[np.argsort(-np.bincount(inverse), kind="stable")] = np.arange(len(keys), dtype=np.uint32)
        documents_row = (chunk, 0, -1, int(trained.sum()), pack(rank[inverse].astype(np.uint32)), pack(lengths), pack(np.array([i or 0 for i in ids], dtype=np.int64)), bytes(np.array(train, dtype=np.uint8) + 2 * np.array(valid, dtype=np.uint8)))
        rows = [documents_row]
        cut = cuts(keys, parts)
        for p in range(parts):
            s = slice(cut[p], cut[p + 1])
            rows.append((chunk, 1, p, 0, pack_keys(keys[s]), pack(counts[s]), pack(rank[s]), None))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        ids, valid, train, words, size = [], [], [], [], 0
        for batch in batches:
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = _raw(text)
                ids.append(i)
                valid.append(i is not None)
                train.append(t)
                words.append(np.append(bytescan.word_hashes(raw), END))
                size += len(raw)
                if size >= chunk_bytes or len(ids) >= 50_000:
                    yield flush(ids, valid, train, words)
                    ids, valid, train, words, size = [], [], [], [], 0
        if ids:
            yield flush(ids, valid, train, words)

    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held, F.lit(True))
    return documents.select(F.col("doc_id").cast("long"), training, F.col("text").cast("binary")).mapInArrow(worker.resting(run), _CHUNKS)


#: Kinds of rows: words asked for and answered, the number of words; for each depth grams and their totals, contexts and their states.
WORDS, TOTALS, VOCABULARY = 1, 2, 3
GRAMS, GRAM_TOTALS, CONTEXTS, STATES = 0, 1, 2, 3


def kind_of(depth: int, what: int) -> int:
    return 10 * depth + what


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the number of each key's."""
    order = np.argsort(keys)
    inside = keys[order]
    new = np.r_[True, inside[1:] != inside[:-1]] if len(keys) else np.zeros(0, dtype=bool)
    inverse = np.empty(len(keys), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return inside[new], order[new], inverse


def add_up(table: pa.Table, s: Settings) -> pa.Table:
    """What the chunks ask of a partition, added up.

    Words and grams with counts get totals, and one bit: of all chunks that ask for a key one owns it.
    Contexts with followers and gains get twice the followers, and one more if the context is retained.
    A row of kind VOCABULARY tells the number of words of training.
    """
    worker.release()
    kind, part, chunks = table["kind"][0].as_py(), table["part"][0].as_py(), table["chunk"].to_pylist()
    keys = [unpack_keys(x.as_py()) for x in table["a"]]
    numbers = np.concatenate([unpack(x.as_py(), np.uint32) for x in table["b"]]).astype(np.int64)
    whole = np.concatenate(keys)
    order = np.argsort(whole)
    sorted_keys = whole[order]
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(whole) else np.zeros(0, dtype=np.int64)
    add = lambda x: np.add.reduceat(x[order], first) if len(first) else x[:0]
    every, total = sorted_keys[first], add(numbers)
    owner = np.zeros(len(whole), dtype=bool)
    if kind != WORDS and kind % 10 == CONTEXTS:
        gain = add(np.concatenate([unpack(x.as_py(), np.float64) for x in table["c"]]))
        out = 2 * total + (gain >= s.divergence + s.per_follower * total)
    else:
        out = total
        owner[order[first]] = True
    ends = np.cumsum([len(k) for k in keys])
    rows = [(c, kind + 1, part, 0, pack(out[np.searchsorted(every, k)].astype(np.int64)), np.packbits(owner[e - len(k) : e]).tobytes(), None, None) for c, k, e in zip(chunks, keys, ends, strict=True)]
    if kind == WORDS:
        rows.append((0, VOCABULARY, part, int((total > 0).sum()), None, None, None, None))
    return pa.Table.from_batches([_rows(rows)])


def _answered(asked: DataFrame, s: Settings) -> DataFrame:
    return asked.groupBy("kind", "part").applyInArrow(lambda table: add_up(table, s), _CHUNKS)


def _ask(name: int, kind: int, parts: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """A row a partition with sorted keys and values."""
    cut = cuts(keys, parts)
    rows = []
    for p in range(parts):
        s = slice(cut[p], cut[p + 1])
        rows.append((name, kind, p, 0, pack_keys(keys[s]), *[pack(v[s]) for v in values], *[None] * (3 - len(values))))
    return rows


def _gram_keys(context: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    return bytescan.mix(context * _PAIR[0] + words * _PAIR[1] + np.uint64(depth) * _PAIR[2])


class Grams:
    """Tokens of a chunk in a frequent enough context of one depth: places, keys of contexts and of (context, word), and what they were answered."""

    def __init__(self, chunk: Chunk, depth: int, at: np.ndarray, context: np.ndarray):
        self.at = at
        self.keys = _gram_keys(context, depth, chunk.vocabulary[chunk.tokens[at]])
        self.every, self.first, self.inverse = distinct(self.keys)
        self.contexts, _, self.context = distinct(context)

    def counts(self, chunk: Chunk) -> np.ndarray:
        return np.bincount(self.inverse, weights=chunk.token_train()[self.at], minlength=len(self.every)).astype(np.uint32)

    def answer(self, rows: dict[int, dict], parts: int) -> None:
        got = [unpack(rows[p]["a"], np.int64) for p in range(parts)]
        self.total = np.concatenate(got)
        self.owned = np.concatenate([np.unpackbits(np.frombuffer(rows[p]["b"], dtype=np.uint8), count=len(x)) for p, x in enumerate(got)]).astype(bool)

    def gains(self, n: np.ndarray, suffix: np.ndarray, suffix_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per context, over the followers that this chunk owns: their number and the sum of c * log((c / n) / p), p by the suffix.

        Given per token: the count of its context, of the token after the suffix, and of the suffix.
        """
        own = np.flatnonzero(self.owned & (self.total > 0))
        at, c = self.first[own], self.total[own].astype(float)
        gain = c * (np.log(c / n[at]) - np.log(suffix[at] / suffix_n[at]))
        size = len(self.contexts)
        return np.bincount(self.context[at], minlength=size).astype(np.uint32), np.bincount(self.context[at], weights=gain, minlength=size)

    def states(self, rows: dict[int, dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token: followers of its context, and whether it is retained."""
        got = np.concatenate([unpack(rows[p]["a"], np.int64) for p in range(parts)])[self.context]
        return (got >> 1).astype(float), (got & 1).astype(bool)


class View:
    """A chunk's rows: documents, ids, the training total of each word number, and its grams of all depths as far as they are answered.

    context_n[d] is, per token, the count of the d words before it (of no word: all tokens), gram_n[d] that of
    these and the token itself; zero where a context is not frequent enough to be asked for.
    """

    def __init__(self, table: pa.Table, parts: int, tokens: int, low: tuple[float, float], depth: int):
        rows: dict[int, dict] = {}
        for r in table.to_pylist():
            rows.setdefault(r["kind"], {})[r["part"]] = r
        d = rows[0][-1]
        keys = [unpack_keys(rows[WORDS][p]["a"]) for p in range(parts)]
        rank = np.concatenate([unpack(rows[WORDS][p]["c"], np.uint32) for p in range(parts)])
        vocabulary, total = np.empty(len(rank), dtype=np.uint64), np.empty(len(rank), dtype=np.int64)
        vocabulary[rank], total[rank] = np.concatenate(keys), np.concatenate([unpack(rows[TOTALS][p]["a"], np.int64) for p in range(parts)])
        flags = np.frombuffer(d["d"], dtype=np.uint8)
        self.name, self.rows, self.parts = d["chunk"], rows, parts
        self.chunk = chunk = Chunk(vocabulary, unpack(d["a"], np.uint32).astype(np.int64), unpack(d["b"], np.int64), (flags & 1).astype(bool))
        self.ids = [i if f & 2 else None for i, f in zip(unpack(d["c"], np.int64).tolist(), flags.tolist(), strict=True)]
        before = chunk.before()
        size = len(before)
        self.context_n, self.gram_n, self.grams = [np.full(size, tokens), total[before]], [total[chunk.tokens]], [None]
        context = vocabulary[before]
        for level in range(1, depth + 1):
            at = np.flatnonzero(self.context_n[level] >= low[level > 1])
            grams = Grams(chunk, level, at, context[at])
            self.grams.append(grams)
            if kind_of(level, GRAM_TOTALS) not in rows:
                break
            grams.answer(rows[kind_of(level, GRAM_TOTALS)], parts)
            n, key = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint64)
            n[at], key[at] = grams.total[grams.inverse], grams.keys
            self.gram_n.append(n)
            # The words before a token are the gram that ends before it.
            n, context = np.r_[0, n[:-1]], np.r_[np.uint64(0), key[:-1]]
            n[chunk.starts] = 0
            self.context_n.append(n)


def _ask_level(parts: int, tokens: int, low: tuple[float, float], depth: int, level: int):
    """Asks for the grams of a depth and, now that those of the depth before are answered, for the states of its contexts."""

    def run(table: pa.Table) -> pa.Table:
        worker.release()
        v = View(table, parts, tokens, low, min(level, depth))
        rows = []
        if level <= depth:
            rows += _ask(v.name, kind_of(level, GRAMS), parts, v.grams[level].every, v.grams[level].counts(v.chunk))
        if level > 1:
            g, d = v.grams[level - 1], level - 1
            rows += _ask(v.name, kind_of(d, CONTEXTS), parts, g.contexts, *g.gains(v.context_n[d][g.at], v.gram_n[d - 1][g.at], v.context_n[d - 1][g.at]))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _score(parts: int, tokens: int, low: tuple[float, float], depth: int, vocabulary: int):
    def run(table: pa.Table) -> pa.Table:
        worker.release()
        v = View(table, parts, tokens, low, depth)
        chunk, t, size = v.chunk, v.gram_n[0], len(v.chunk.tokens)
        followers, retained = np.zeros((depth + 1, size)), np.zeros((depth + 2, size), dtype=bool)
        for d in range(1, depth + 1):
            at = v.grams[d].at
            followers[d][at], retained[d][at] = v.grams[d].states(v.rows[kind_of(d, STATES)], parts)
        # Witten-Bell of the root into an equal chance of all known words and one unknown one.
        p = (t + vocabulary / (vocabulary + 1)) / (tokens + vocabulary) if vocabulary else np.ones(size)
        for d in range(1, depth + 1):
            at = np.flatnonzero(retained[d:].any(axis=0))
            f = followers[d][at]
            p[at] = (v.gram_n[d][at] + f * p[at]) / (v.context_n[d][at] + f)
        base = np.log10((t + 1) / (tokens + vocabulary + 1))
        add = lambda x: np.add.reduceat(x, chunk.starts)
        ids = v.ids
        arrays = [
            pa.array(ids, pa.int64()), pa.array(~chunk.train), pa.array(chunk.lengths), pa.array(add((t > 0).astype(np.int64))),
            pa.array(np.full(len(ids), tokens, dtype=np.int64)), pa.array(add(base)), pa.array(add(np.log10(p))),
        ]
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(documents: DataFrame, fold: int = 7, held: int = 2, settings: Settings = Settings(), parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    if not parts:
        size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(8, -(-size // settings.part_bytes))
    depth = settings.depth
    chunks = scratch.write(_number_words(documents, fold, held, parts, settings.chunk_bytes), "chunks", by="kind")
    tokens = chunks.where("kind = 0").agg(F.sum("n").alias("n")).first()["n"] or 0
    share = settings.share * tokens
    low = max(1.0, settings.least, share), max(1.0, settings.least, settings.least_deep, share)
    answers = scratch.write(_answered(chunks.where(f"kind = {WORDS}"), settings), "words", by="kind")
    vocabulary = answers.where(f"kind = {VOCABULARY}").agg(F.sum("n").alias("n")).first()["n"] or 0
    # Counts of words are answered: they needn't travel with the chunks any more.
    known = chunks.withColumn("b", F.when(F.col("kind") != WORDS, F.col("b"))).unionByName(answers.where(f"kind = {TOTALS}"))
    for level in range(1, depth + 2):
        asked = known.groupBy("chunk").applyInArrow(_ask_level(parts, tokens, low, depth, level), _CHUNKS)
        known = known.unionByName(scratch.write(_answered(asked, settings), f"level-{level}", by="kind"))
    return known.groupBy("chunk").applyInArrow(_score(parts, tokens, low, depth, vocabulary), SCHEMA)
