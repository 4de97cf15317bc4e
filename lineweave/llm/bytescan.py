"""Vectorised scans over UTF-8 bytes: words, 64-bit word and window hashes.

All functions take numpy byte arrays and never look at rows one byte at a time.
Words are hashed eight bytes a round through a chain of mixes, long ones by BLAKE2:
two different words share a hash with odds near 2**-64.  Window hashes are sums of
random 64-bit values times powers of an odd base (mod 2**64), so that of any substring
is a difference of prefix sums.  Some structured strings (Thue-Morse words) meet in
them: they choose candidates only, and nothing counts as equal because of them.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_MULT = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = np.ones(1, dtype=np.uint64)
_unpowers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n (mod 2**64), grown by doubling and kept."""
    global _powers, _unpowers
    while len(_powers) < n:
        k = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, k, 1 << 64))])
        _unpowers = np.concatenate([_unpowers, _unpowers * np.uint64(pow(_INVERSE, k, 1 << 64))])
    return _powers, _unpowers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Of bytes, or of word hashes."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((BYTE_CODE[codes] if codes.dtype == np.uint8 else codes) * up[: len(codes)], out=out[1:])
    return out


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all substrings of one width, by start."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(len(sums))
    return mix((sums[width:] - sums[:n]) * down[:n])


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_ROUND = np.uint64(0xA0761D6478BD642F)


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """One hash a word, in order; A-Z count as a-z.  Long texts are hashed so many words at a time."""
    raw = LOWER[np.frombuffer(text, dtype=np.uint8)]
    start, end = word_bounds(raw)
    parts = [span_words(raw, start[i : i + piece], end[i : i + piece]) for i in range(0, len(start), piece)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def span_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    out = mix(length.astype(np.uint64) * _ROUND + np.uint64(1))
    live = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(live):
        left = np.minimum(length[live] - at, 8).astype(np.uint64)
        some = eight[start[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[live] = mix((out[live] ^ some) * _ROUND + np.uint64(at + 1))
        at += 8
        live = live[length[live] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(words) - n + 1
    total = words[:m] * SHINGLE_MULT[0]
    for i in range(1, n):
        total += words[i : i + m] * SHINGLE_MULT[i]
    return mix(total + np.uint64(n))


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word hashes of a text; a text of fewer words gives its whole sequence as one."""
    words = word_hashes(text)
    return np.unique(ngram_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by start, in a few passes whatever the width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
