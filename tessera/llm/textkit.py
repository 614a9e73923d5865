"""Byte-level text kernels shared by the operators on documents.

Texts arrive as Arrow string arrays; words, lines and their hashes are found
for a whole block of texts at once with numpy, so no Python code runs per word.
A word is ``[^\\x20\\x09-\\x0D]+``; those separators are ASCII, so work on the
UTF-8 bytes equals work on code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 400_000
ROWS_PER_BATCH = 250

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _powers:
        up = np.full(size + 1, _BASE, np.uint64)
        down = np.full(size + 1, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        tables = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size > 2 * BLOCK_BYTES:  # one very long text: not worth keeping
            return tables
        _powers[size] = tables
    return _powers[size]


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of so many texts at most, unless the session says otherwise: long texts come in rows, not in bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ROWS_PER_BATCH)


def release_memory() -> None:
    """Gives freed memory back: a Python worker outlives its task and idles beside the next operator's."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """An object of bounded size that a worker keeps from one task of an operator to the next, such as a cache of words."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget_kept() -> None:
    _KEPT.clear()


def map_batches(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` that leaves no memory behind at the end of a task, nor at its start what another operator kept; with ``keeps`` it uses :func:`kept`."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget_kept()  # by name: the worker's module holds the objects, not this function's copy of it
        yield from run(batches)
        release_memory()

    return frame.mapInArrow(bounded, schema)


@dataclass
class Block:
    """Some texts side by side: ``data`` holds their bytes, ``bounds`` their n+1 limits."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Block:
        return Block(self.first, _LOWER[self.data], self.bounds)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the n+1 word limits of the texts."""
        space = _SPACE[self.data]
        edge = np.zeros(len(space) + 1, bool)
        edge[self.bounds] = True
        before = np.empty_like(space)
        after = np.empty_like(space)
        if len(space):
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
        starts = np.flatnonzero(~space & (before | edge[:-1]))
        ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
        """A 64-bit hash of each byte span, by differences of one running polynomial in the bytes' ``values``."""
        up, down = _power_tables(len(self.data) + 1)
        running = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * up[: len(self.data)], out=running[1:])
        return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-byte flags for each text."""
        running = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return running[self.bounds[1:]] - running[self.bounds[:-1]]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut an array of texts (null: empty) into blocks of about ``limit`` bytes; a longer text is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield Block(low, data[offsets[low] : offsets[high]], (offsets[low : high + 1] - offsets[low]).astype(np.int64))
        low = high


def window_hashes(words: np.ndarray, limits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the position of each window's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = words[:n].copy()
    for j in range(1, size):
        out = mix(out * _U(0x9FB21C651E98DF25) + words[j : j + n] + _U(j))
    text = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    inside = text[:n] == text[size - 1 :]
    at = np.flatnonzero(inside)
    return out[at], at


def text_of(limits: np.ndarray) -> np.ndarray:
    """For each item its text's number, from the n+1 limits."""
    return np.repeat(np.arange(len(limits) - 1), np.diff(limits))
