"""Token counts of byte-level BPE without tokens: a heap of adjacent pairs over a linked list of symbols.

The lowest-ranked adjacent pair is popped and merged again and again; the count is
the number of first symbols minus the number of merges.  Texts are cut by special
strings (one token each) and by the vocabulary's pattern; counts of pieces are kept
in a bounded memo of two generations.

Nulls: a null or empty text has 0 bytes and 0 tokens.  Long texts are counted whole,
piece after piece; a long piece takes n log n steps.  Equal texts and repeated
rows get equal counts; only id and text are read, whatever other columns are called.
An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import worker

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself where it is printable, else the next of U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class TwoGenerations(dict):
    """A memo of `most` fresh entries; the generation before it is asked before anything is computed again."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Counter:
    def __init__(self, ranks: dict[tuple[str, str], int], pattern: str, specials: list[str], memo: int = 500_000):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.memo = TwoGenerations(self.count_piece, memo)

    @classmethod
    def from_json(cls, path: str, pattern: str, **settings) -> Counter:
        """From a file of the `tokenizers` library: byte-level BPE without prefix space."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        return cls({pair: i for i, pair in enumerate(merges)}, pattern, [t["content"] for t in whole.get("added_tokens", [])], **settings)

    def count_piece(self, piece: str) -> int:
        letters, ranks = self.letters, self.ranks
        symbols: list[str | None] = [letters[b] for b in piece.encode()]
        n = count = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, pair) for i in range(n - 1) if (r := ranks.get(pair := (symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = a + b, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(pair := (symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, pair))
            k = before[i]
            if k >= 0 and (r := ranks.get(pair := (symbols[k], symbols[i]))) is not None:
                heapq.heappush(heap, (r, k, pair))
        return count

    def count(self, text: str) -> int:
        if self.specials is None:
            return sum(map(self.memo.__getitem__, self.pieces(text)))
        total = at = 0
        for m in self.specials.finditer(text):
            total += 1 + sum(map(self.memo.__getitem__, self.pieces(text[at : m.start()])))
            at = m.end()
        return total + sum(map(self.memo.__getitem__, self.pieces(text[at:] if at else text)))


def counter(path: str, pattern: str) -> Counter:
    """One a Python worker, so that its memo serves the worker's next tasks."""
    return worker.keep(("counter", path, pattern), lambda: Counter.from_json(path, pattern))


def count_tokens(documents: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            counts = [own.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
            over = pa.array([n > limit for n in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return documents.select(F.col("doc_id").cast("long"), size.alias("n_bytes"), "text").mapInArrow(worker.resting(run), SCHEMA)
