"""Removal of repeated strings by merging sampled Burrows-Wheeler orders of shards.

A text is a string of symbols: its bytes, or its words (A-Z as a-z, whatever stands
between them).  Every window of `size` symbols (400 bytes, 51 words) owns the least hash
of its grams (64 bytes, 8 words; the leftmost of equals): its anchor.  Equal windows own
equal anchors at equal places, so only the suffixes that start at anchors need an order.

1. Anchors of all texts, each with the run of windows that own it and a 128-bit digest of
   the symbols these cover.  Anchors whose gram occurs once in the corpus are done.
2. Occurrences with equal digests become one member with a count.
3. Where a gram still has several members, each shard of the texts sorts its members: by
   the suffix at the anchor and by the reversed symbols before it, the transform of the
   text and that of its reverse.  Shards are merged by refining their interleave: all
   start as one block, a run of each shard.  A round cuts the runs where the shard's own
   common prefixes end and deals them into blocks by eight more bytes at the heads of the
   runs; a block with one run is settled, its order and common prefixes are the shard's.
   The depth at which two blocks part is their common prefix.  No member is compared with
   its shard's others again: runs that are not sorted give wrong blocks.
4. A window that lies l symbols before the anchor is repeated if another member shares
   l symbols to the left and size - l to the right: equal blocks in both merged orders.
5. Repeated windows become spans of every occurrence.

A gram with more than `most` different members (a passage shared by a good part of
all documents) is not brought into one task: the digests of its windows are counted
with partial aggregation, which gives the same windows.

Nulls: a null text counts as empty.  Texts shorter than a window lose nothing.  Very
long texts are scanned in overlapping pieces.  Repeated rows are copies like others:
equal texts of a window's length or more lose every byte.  An empty table gives an empty
one.  Only id and text are read by `remove`, whatever other columns are called; `cleaned`
gives all columns back, characters cut in two going whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import bytescan, names, scratch, worker


@dataclass(frozen=True)
class Windows:
    """What counts as repeated: a run of `size` symbols that starts at another place too."""

    size: int = 400
    gram: int = 64
    words: bool = False

    @property
    def unit(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.words else 1

    def symbols(self, text: bytes) -> np.ndarray:
        return bytescan.word_hashes(text) if self.words else np.frombuffer(text, dtype=np.uint8)


STRINGS = Windows()
#: Passages of over 50 words.
PASSAGES = Windows(51, 8, words=True)
SIZE, GRAM = STRINGS.size, STRINGS.gram
#: Members of a gram that one task merges at most.
MOST = 20_000
#: Members that a task holds at once.
BATCH = 20_000
_PIECE_BITS = 18
_ANCHORS = "gram long, hash_a long, hash_b long, width int, at int, key_a long, key_b long, starts array<long>"
_KIND = ["gram", "hash_a", "hash_b", "width"]


def digests(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """128 bits of each of the strings [start, end) of raw, as two numbers."""
    view = memoryview(raw)
    return np.frombuffer(b"".join(hashlib.blake2b(view[s:e], digest_size=16).digest() for s, e in zip(starts, ends, strict=True)), dtype="<i8").reshape(-1, 2)


def anchors(text: bytes, windows: Windows = STRINGS) -> tuple[np.ndarray, ...]:
    """Per anchor: gram hash, digest of the covered symbols (two columns), number of windows, place of the anchor behind the first window, start of the first window."""
    size, gram, unit = windows.size, windows.gram, windows.unit
    codes = windows.symbols(text)
    raw = codes.tobytes()
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    step = (1 << _PIECE_BITS) - size
    low = (np.uint64(1) << np.uint64(_PIECE_BITS)) - np.uint64(1)
    for base in range(0, max(0, len(codes) - size + 1), step):
        hashes = bytescan.window_hashes(bytescan.prefix_sums(codes[base : base + step + size - 1]), gram)
        placed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        owner = (bytescan.sliding_minimum(placed, size - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        end = np.r_[first[1:], len(owner)]
        place = owner[first]
        covered = digests(raw, ((first + base) * unit).tolist(), ((end - 1 + size + base) * unit).tolist())
        for got, x in zip(out, (hashes[place], covered, end - first, place - first, first + base), strict=True):
            got.append(x)
    return tuple(np.concatenate(x) if x else np.zeros((0, 2) if i == 1 else 0, dtype=np.int64) for i, x in enumerate(out))


def _once(found: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Anchors of a text with equal digests once, all their starts together, and how many starts each has: a text that repeats one line has few rows."""
    gram, covered, width, at, start = found
    order = np.lexsort((covered[:, 1], covered[:, 0]))
    h = covered[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(axis=1)]) if len(h) else np.zeros(0, dtype=np.int64)
    one = order[first]
    return (gram[one], covered[one], width[one], at[one], start[order]), np.diff(np.r_[first, len(h)])


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(*names.row_key(), F.col("text").cast("binary").alias("text"))


def _find_anchors(documents: DataFrame, windows: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                parts, counts = [], []
                some = batch.slice(low, 2000)
                for text in some.column(2):
                    found, many = _once(anchors(_raw(text), windows))
                    parts.append(found)
                    counts.append(many)
                g, h, w, a, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
                keys = [np.repeat(some.column(c).to_numpy(), [len(m) for m in counts]) for c in (0, 1)]
                arrays = [pa.array(x) for x in (g.view(np.int64), *h.T.copy(), w.astype(np.int32), a.astype(np.int32), *keys)]
                starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(s.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*arrays, starts], [*_KIND, "at", *names.KEY, "starts"])

    long_enough = _keyed(documents).where(F.octet_length("text") >= (2 * windows.size - 1 if windows.words else windows.size))
    return long_enough.mapInArrow(worker.resting(run), _ANCHORS)


_MEMBERS = {"gram": pa.int64(), "hash_a": pa.int64(), "hash_b": pa.int64(), "width": pa.int32(), "at": pa.int32(), "many": pa.int64(), "raw": pa.binary(), "shard": pa.int64(), "right": pa.int32(), "left": pa.int32()}


def _members(texts: DataFrame, windows: Windows) -> DataFrame:
    """(text, wanted) to one row a member: its covered symbols, from the shard that holds the text, and its places in the shard's two orders."""
    unit = windows.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            out: list[dict] = []
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = windows.symbols(_raw(text)).tobytes()
                out += [w | {"raw": raw[w["start"] * unit : (w["start"] + w["width"] - 1 + windows.size) * unit]} for w in wanted]
            if not out:
                continue
            shard = int.from_bytes(hashlib.blake2b(b"".join(b"%d %d" % (w["hash_a"], w["hash_b"]) for w in out), digest_size=7).digest(), "big")
            for side, key in (("left", lambda w: (w["gram"], _backwards(w["raw"], w["at"], unit))), ("right", lambda w: (w["gram"], w["raw"][w["at"] * unit :]))):
                out.sort(key=key)
                for i, w in enumerate(out):
                    w[side] = i
            for low in range(0, len(out), 5000):
                some = out[low : low + 5000]
                arrays = [pa.array([w[k] for w in some], t) if k != "shard" else pa.array([shard] * len(some), t) for k, t in _MEMBERS.items()]
                yield pa.RecordBatch.from_arrays(arrays, list(_MEMBERS))

    schema = "gram long, hash_a long, hash_b long, width int, at int, many long, raw binary, shard long, right int, left int"
    return texts.select("text", "wanted").mapInArrow(worker.resting(run), schema)


def _backwards(raw: bytes, at: int, unit: int) -> bytes:
    """The symbols before the anchor, nearest first."""
    if unit == 1:
        return raw[:at][::-1]
    return np.frombuffer(raw[: at * unit], dtype=np.uint64)[::-1].tobytes()


def symbols_of(rows: list[bytes], length: int) -> np.ndarray:
    """Eight bytes a number, big-endian, zeros behind the end: their order is that of the bytes."""
    width = -(-length // 8) * 8
    return np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), dtype=">u8").reshape(len(rows), width // 8).astype(np.uint64)


def _equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes in which two numbers that differ are equal."""
    differ = x ^ y
    return sum((differ >> np.uint64(64 - 8 * j) == 0).astype(np.int64) for j in range(1, 8))


def common_prefixes(symbols: np.ndarray) -> np.ndarray:
    """Bytes that each row but the first shares with the row before."""
    if len(symbols) < 2:
        return np.zeros(0, dtype=np.int64)
    differ = symbols[1:] != symbols[:-1]
    k = differ.argmax(axis=1)
    row = np.arange(len(k))
    return np.where(differ.any(axis=1), 8 * k + _equal_bytes(symbols[row + 1, k], symbols[row, k]), 8 * symbols.shape[1])


def interleave(block: np.ndarray, shard: np.ndarray, rank: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted shards, a row of symbols a member.

    block: where members start; rank: the place of a member in its shard's order.  Gives the
    merged order and, for each place in it, the common bytes with the place before (-1
    between first blocks).
    """
    n, rounds = symbols.shape
    source = np.lexsort((rank, shard, block))  # the shards' orders one behind the other
    s, b, d = symbols[source], block[source], shard[source]
    head = np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1])]
    own = np.r_[-1, common_prefixes(s)]
    lo = np.flatnonzero(head)
    hi = np.r_[lo[1:], n]
    first = np.r_[True, b[lo[1:]] != b[lo[:-1]]]
    owner, base = np.cumsum(first) - 1, lo[first]  # the block of each run, the final place at which a block begins
    bound = np.full(len(base), -1, dtype=np.int64)  # what a block's first member shares with the place before
    inner = np.flatnonzero(~head)
    inner = inner[np.argsort(own[inner] // 8, kind="stable")]
    ends = np.searchsorted(own[inner] // 8, np.arange(rounds + 1), side="left")
    order, common = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)

    def settle(done: np.ndarray) -> None:
        """Runs get their places, those of a block one behind the other."""
        a, z, o = lo[done], hi[done], owner[done]
        size = z - a
        before = np.cumsum(size) - size
        starts = np.r_[True, o[1:] != o[:-1]]
        place = base[o] + before - np.maximum.accumulate(np.where(starts, before, 0))
        row = np.repeat(a - before, size) + np.arange(size.sum())
        to = np.repeat(place - before, size) + np.arange(size.sum())
        order[to], common[to] = source[row], own[row]
        common[place] = np.where(starts, bound[o], 8 * rounds)

    for k in range(rounds):
        alone = np.bincount(owner, minlength=len(base))[owner] == 1
        if alone.any():
            settle(np.flatnonzero(alone))
            lo, hi, owner = lo[~alone], hi[~alone], owner[~alone]
        if not len(lo):
            return order, common
        # Cut the runs where the shard's own common prefix ends within this round's symbol.
        cuts = inner[ends[k] : ends[k + 1]]
        by = np.argsort(lo, kind="stable")
        run = np.searchsorted(lo[by], cuts, side="right") - 1
        inside = (run >= 0) & (cuts < hi[by][run])
        cuts, run = cuts[inside], by[run[inside]]
        heads, of = np.r_[lo, cuts], np.r_[owner, owner[run]]
        end = np.r_[hi, hi[run]]
        turn = np.argsort(heads, kind="stable")
        heads, of, end = heads[turn], of[turn], end[turn]
        end[:-1] = np.minimum(end[:-1], heads[1:])
        # Deal the runs into blocks by the symbol at their heads; ties stay in the order of the shards.
        symbol = s[heads, k]
        turn = np.lexsort((heads, symbol, of))
        heads, of, end, symbol = heads[turn], of[turn], end[turn], symbol[turn]
        new = np.r_[True, (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])]
        parted = np.r_[False, (of[1:] == of[:-1]) & (symbol[1:] != symbol[:-1])]
        size = end - heads
        before = np.cumsum(size) - size
        first = np.r_[True, of[1:] != of[:-1]]
        place = base[of] + before - np.maximum.accumulate(np.where(first, before, 0))
        shared = bound[of]
        at = np.flatnonzero(parted)
        shared[at] = 8 * k + _equal_bytes(symbol[at], symbol[at - 1])
        lo, hi, owner, base, bound = heads, end, np.cumsum(new) - 1, place[new], shared[new]
    settle(np.arange(len(lo)))
    return order, common


def repeated(table: dict[str, np.ndarray], raw: list[bytes], windows: Windows = STRINGS) -> np.ndarray:
    """Which windows are repeated: a row a member, a column a distance from the anchor back to the window's start."""
    size, unit = windows.size, windows.unit
    gram, width, at, many, shard = (table[c] for c in ("gram", "width", "at", "many", "shard"))
    n, reach = len(raw), int(at.max()) + 1
    right_order, right_common = interleave(gram, shard, table["right"], symbols_of([r[a * unit :] for r, a in zip(raw, at.tolist(), strict=True)], size * unit))
    left_order, left_common = interleave(gram, shard, table["left"], symbols_of([_backwards(r, a, unit) for r, a in zip(raw, at.tolist(), strict=True)], reach * unit))
    out = np.zeros((n, reach), dtype=bool)
    first = at - width + 1
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for back in range(reach):
        has = np.flatnonzero((first <= back) & (back <= at))
        if not len(has):
            continue
        right[right_order] = np.cumsum(right_common < (size - back) * unit)
        left[left_order] = np.cumsum(left_common < back * unit)
        key = right[has] * (n + 1) + left[has]
        _, place = np.unique(key, return_inverse=True)
        out[has, back] = np.bincount(place, weights=many[has])[place] >= 2
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


_SPANS = "gram long, hash_a long, hash_b long, width int, spans array<struct<s:long,e:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _merge(members: DataFrame, windows: Windows, batch_rows: int) -> DataFrame:
    """Members, all of a gram in one partition and next to each other, to the spans (within a member) that its repeated windows cover."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        numbers = {c: table[c].to_numpy() for c in _MEMBERS if c != "raw"}
        flags = repeated(numbers, [_raw(x) for x in table["raw"]], windows)
        spans = []
        for row, w, a in zip(flags, numbers["width"], numbers["at"], strict=True):
            starts = row[a - w + 1 : a + 1][::-1]
            spans.append([{"s": s, "e": e - 1 + windows.size} for s, e in _runs(starts)])
        return pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in _KIND], pa.array(spans, _SPAN_TYPE)], [*_KIND, "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= batch_rows:
                gram = held["gram"].to_numpy()
                cut = int(np.flatnonzero(gram != gram[-1]).max(initial=-1)) + 1  # the last gram may go on
                if cut:
                    yield solve(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return members.repartition("gram").sortWithinPartitions("gram").mapInArrow(worker.resting(run), _SPANS)


def _whole_windows(members: DataFrame, windows: Windows) -> DataFrame:
    """Members of very frequent grams to the same spans: windows digested whole and counted."""
    size, unit = windows.size, windows.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = _raw(row.column(5)[0])
                places = range(len(raw) // unit - size + 1)
                h = digests(raw, [p * unit for p in places], [(p + size) * unit for p in places])
                same = [pa.array([row.column(c)[0].as_py()] * len(h), row.column(c).type) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(h))), *[pa.array(x) for x in h.T.copy()]], [*_KIND, "many", "p", "window_a", "window_b"])

    each = members.select(*_KIND, "many", "raw").mapInArrow(worker.resting(run), "gram long, hash_a long, hash_b long, width int, many long, p long, window_a long, window_b long")
    same = ["gram", "window_a", "window_b"]
    often = each.groupBy(*same).agg(F.sum("many").alias("n")).where("n > 1").select(*same)
    hit = each.join(often, same)
    span = F.struct(F.col("p").alias("s"), (F.col("p") + size).alias("e"))
    return hit.groupBy(*_KIND).agg(F.collect_list(span).alias("spans"))


def spans(documents: DataFrame, windows: Windows = STRINGS, most: int = MOST, batch: int = BATCH) -> DataFrame:
    """(key_a, key_b, spans): the spans of symbols, unmerged, that lie under repeated windows, of texts that have any."""
    occurrences = scratch.write(_find_anchors(documents, windows), "anchors")
    # Written, so that the join reads plain shuffles, whose large partitions can be split: a common line's gram is hot.
    twice = scratch.write(occurrences.groupBy("gram").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("gram"), "twice")
    live = scratch.write(occurrences.join(twice, "gram"), "live", instead_of=[occurrences, twice])
    one = F.min(F.struct(*names.KEY, F.col("starts")[0].alias("start")))
    kinds = scratch.write(live.groupBy(*_KIND, "at").agg(F.sum(F.size("starts")).alias("many"), one.alias("one")), "members")
    per_gram = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = kinds.join(per_gram, "gram").select(*_KIND, "at", "many", "n", "one.*")
    own = F.collect_list(F.struct(*_KIND, "at", "many", "start"))

    def bring(some: DataFrame) -> DataFrame:
        lists = some.groupBy(*names.KEY).agg(own.alias("wanted"))
        return _members(_keyed(documents).join(lists, names.KEY).dropDuplicates(names.KEY), windows)

    parted = [_merge(bring(wanted.where(F.col("n") <= most)), windows, batch)]
    if not wanted.where(F.col("n") > most).isEmpty():
        parted.append(_whole_windows(bring(wanted.where(F.col("n") > most)), windows))
    # A kind that occurs twice is repeated from end to end whatever its neighbours are.
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), (F.col("width") - 1 + windows.size).cast("long").alias("e")))
    found = kinds.where("many > 1").select(*_KIND, whole.alias("spans"))
    for part in parted:
        found = found.unionByName(part.where(F.size("spans") > 0))
    hit = live.join(found, _KIND)
    moved = F.flatten(F.transform("starts", lambda at: F.transform("spans", lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e")))))
    out = hit.select(*names.KEY, moved.alias("spans")).groupBy(*names.KEY).agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return scratch.write(out, "spans", instead_of=[live, kinds])


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted maximal spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def passages(raw: bytes, found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans of words as spans of bytes, from the first byte of a word to the last of another."""
    own = merged(found)
    if not own:
        return []
    start, end = bytescan.word_bounds(np.frombuffer(raw, dtype=np.uint8))
    return [(int(start[s]), int(end[e - 1])) for s, e in own]


def cut(raw: bytes, found: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in found:
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return b"".join(kept)


def _with_spans(documents: DataFrame, most: int, batch: int) -> tuple[DataFrame, list[str]]:
    """The documents with the spans of each, of bytes and of words, and the names of these columns."""
    key_a, key_b, *own = names.free(documents, "key_a", "key_b", "strings", "passages")
    keys = [key_a, key_b]
    out = documents.withColumns(dict(zip(keys, names.row_key(), strict=True)))
    for windows, name in zip((STRINGS, PASSAGES), own, strict=True):
        some = spans(documents, windows, most, batch)
        out = out.join(some.select(F.col("key_a").alias(key_a), F.col("key_b").alias(key_b), F.col("spans").alias(name)), keys, "left")
    return out.select(*documents.columns, *own), own


def remove(documents: DataFrame, most: int = MOST, batch: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document by repeated strings, and n_passages, how many runs under repeated passages of over 50 words it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            n, removed, pieces, digest, many = [], [], [], [], []
            for text, found, words in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                raw, own = _raw(text), merged(found.as_py())
                n.append(len(raw))
                removed.append(sum(e - s for s, e in own))
                pieces.append(len(own))
                digest.append(hashlib.sha256(cut(raw, own)).hexdigest())
                many.append(len(merged(words.as_py())))
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, pieces)], pa.array(digest, pa.string()), pa.array(many, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    rows, own = _with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), most, batch)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), *own).mapInArrow(worker.resting(run), schema)


def cleaned(documents: DataFrame, most: int = MOST, batch: int = BATCH) -> DataFrame:
    """The documents, all their columns, without repeated strings and without repeated passages of over 50 words; n_chars follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        for batch in batches:
            at, last = batch.schema.get_field_index("text"), batch.num_columns - 2
            texts = []
            for text, found, words in zip(batch.column(at), batch.column(last), batch.column(last + 1), strict=True):
                value = text.as_py()
                if value is not None and (found.is_valid or words.is_valid):
                    raw = value.encode()
                    both = [*merged(found.as_py()), *passages(raw, words.as_py())]
                    value = cut(raw, merged([{"s": s, "e": e} for s, e in both])).decode("utf-8", "ignore")
                texts.append(value)
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:last])

    rows, _ = _with_spans(documents, most, batch)
    out = rows.mapInArrow(worker.resting(run), documents.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*documents.columns) if "n_chars" in documents.columns else out
