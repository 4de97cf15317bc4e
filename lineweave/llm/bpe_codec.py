"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Every prefix of a piece has one BPE encoding, and its last token is the only token
that ends there and is compatible with the encoding of what stands before it.  A
state of the transducer holds, for each position at which a token may still be
running, the trie node reached from there and the tokens up to there since the last
token that all of them share.  Reading a byte moves the nodes, adds the position
after it and emits what has become common to all: no token waits for more bytes
than the longest token has.  States are made when they are first reached and are
kept up to a bound.

The decoder feeds tokens to a UTF-8 state machine whose state is the bytes of an
unfinished character; it hands out whole characters and never waits otherwise.

Nulls: a null or empty text has no tokens; its digests are those of empty strings.
Long texts are coded whole, piece after piece.  Equal texts and repeated rows get equal
tokens.  Only id and text are read, whatever other columns are called.  An empty table
gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import worker
from lineweave.llm.bpe_count import TwoGenerations

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class State:
    """runs: (trie node, tokens since the shared one, last token) of each position where a token may be running; the last is the end itself."""

    __slots__ = ("runs", "steps")

    def __init__(self, runs: tuple):
        self.runs, self.steps = runs, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000):
        self.ranks, self.most_states = ranks, most_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte to node
        self.token_at, self.inner = [-1], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for b in token:
                child = self.child.get(node << 8 | b)
                if child is None:
                    child = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.inner[node] = 1
                node = child
            self.token_at[node] = rank
        self.whole: dict[int, bool] = {}
        self.fits: Callable[[tuple[int, int]], bool] = TwoGenerations(self._fits, 400_000).__getitem__
        self.states: dict[tuple, State] = {}
        self.clear()

    def clear(self) -> None:
        for state in self.states.values():
            state.steps.clear()  # states may lead to each other in circles
        self.states.clear()
        self.start = self._state(((0, (), -1),))

    def _state(self, runs: tuple) -> State:
        state = self.states.get(runs)
        if state is None:
            state = self.states[runs] = State(runs)
        return state

    def merged(self, raw: bytes) -> list[bytes]:
        """Plain pairwise merging; for single tokens and pairs of tokens only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        if a < 0:
            if b not in self.whole:
                self.whole[b] = self.merged(self.tokens[b]) == [self.tokens[b]]
            return self.whole[b]
        return self.merged(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        runs, end = [], None
        find, token_at, inner = self.child.get, self.token_at, self.inner
        for node, chain, last in state.runs:
            child = find(node << 8 | byte)
            if child is not None:
                token = token_at[child]
                if end is None and token >= 0 and self.fits((last, token)):
                    end = (0, (*chain, token), token)
                if inner[child]:
                    runs.append((child, chain, last))
        runs.append(end)
        out = ()
        if first := runs[0][1]:  # the oldest run has the fewest tokens: nothing is shared before it has one
            shared = len(first)
            for _, chain, _ in runs:
                while chain[:shared] != first[:shared]:
                    shared -= 1
            if shared:
                out = first[:shared]
                runs = [(node, chain[shared:], last) for node, chain, last in runs]
        moved = self._state(tuple(runs)), out
        state.steps[byte] = moved
        return moved

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.most_states:
            self.clear()
        whole = self.ranks.get(piece)
        if whole is not None:  # as the library does: a piece that is a token stays one
            return [whole]
        state, ids = self.start, []
        for byte in piece:
            moved = state.steps.get(byte) or self.step(state, byte)
            state = moved[0]
            if moved[1]:
                ids += moved[1]
            if len(self.states) > 2 * self.most_states:  # a very long piece: go on from this state alone
                runs = state.runs
                self.clear()
                state = self._state(runs)
        ids += state.runs[-1][1]
        return ids


class Utf8Machine:
    """Bytes of an unfinished character go in and out as the state; `split` says how much of the bytes is whole characters."""

    @staticmethod
    def split(raw: bytes) -> int:
        for back in range(1, min(3, len(raw)) + 1):
            b = raw[-back]
            if b < 0x80:
                break
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1
                return len(raw) - back if need > back else len(raw)
        return len(raw)


class StreamDecoder:
    """Token after token to whole characters; moves (state, token) -> (state, bytes) are kept once made."""

    def __init__(self, tokens: dict[int, bytes], most: int = 150_000):
        self.tokens = tokens
        self.moves = TwoGenerations(self._move, most)
        self.pending = b""

    def _move(self, key: tuple[bytes, int]) -> tuple[bytes, bytes]:
        raw = key[0] + self.tokens[key[1]]
        cut = Utf8Machine.split(raw)
        return raw[cut:], raw[:cut]

    def feed(self, ids: Iterable[int]) -> bytes:
        """The characters that these tokens complete, as UTF-8; bytes that can't start or go on a character pass through."""
        out, pending, moves = [], self.pending, self.moves
        for i in ids:
            pending, done = moves[pending, i]
            out.append(done)
        self.pending = pending
        return b"".join(out)

    def end(self) -> bytes:
        rest, self.pending = self.pending, b""
        return rest


#: Pieces in a generation of the memo, and states: about 250 bytes and 1 KB each.  They bound a worker's memory and change no result.
MEMO, STATES = 700_000, 250_000


def codec(path: str, pattern: str, memo: int = MEMO, states: int = STATES) -> Codec:
    """One a Python worker, so that what it has learnt serves the worker's next tasks."""
    return worker.keep(("codec", path, pattern, memo, states), lambda: Codec(path, pattern, memo, states))


class Codec:
    def __init__(self, path: str, pattern: str, memo: int = MEMO, states: int = STATES):
        self.transducer = Transducer(read_ranks(path), states)
        self.pieces = regex.compile(pattern).findall
        self.memo = TwoGenerations(lambda piece: tuple(self.transducer.encode(piece.encode())), memo)
        self.decoder = StreamDecoder(self.transducer.tokens)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for tokens in map(self.memo.__getitem__, self.pieces(text)):
            ids += tokens
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decoder.feed(ids) + self.decoder.end()


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[str]:
    for t in batch.column(at):
        yield t.as_py() if t.is_valid else ""


def digests(documents: DataFrame, path: str, pattern: str, memo: int = MEMO, states: int = STATES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, memo, states)
        for batch in batches:
            n, a, b = [], [], []
            for text in _texts(batch, 1):
                ids = own.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(worker.resting(run), SCHEMA)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, the real output: one array a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = pa.array([own.encode(t) for t in _texts(batch, 1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(worker.resting(run), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of what `encode` gave; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(x.as_py()).decode("utf-8", "replace") if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(worker.resting(run), "doc_id long, text string")
