"""What a Python worker keeps between its tasks: the caches of one operator at a time.

Workers are used again by Spark and outlive a query; large caches of an operator
that has finished would count against the executor's memory while others run.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_kept: tuple[Hashable, Any] | None = None


def rest() -> None:
    """Give freed memory back: an idle worker's counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it frees as it likes


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with a rest at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        rest()

    return whole


def release() -> None:
    """Drop what another operator has left, and give its memory back."""
    global _kept
    if _kept is not None:
        _kept = None
        gc.unfreeze()
        gc.collect()
        rest()


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """The kept object of that key, or a new one in the place of any other.

    Its caches are bounded and cleared by hand: the garbage collector is told not to
    walk through them again and again.
    """
    global _kept
    if _kept is None or _kept[0] != key:
        release()
        _kept = key, make()
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
    return _kept[1]
