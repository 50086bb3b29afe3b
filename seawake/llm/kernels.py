"""Vectorised text kernels over Arrow string columns.

A batch is cut into chunks of about 256 KB; within a chunk, words and
windows of words are hashed by prefix sums of ``value * B**position`` modulo
2**64 (B odd, so that every power has an inverse), one NumPy pass per byte and
per word. Words are the runs of bytes other than space and 0x09-0x0D, which in
UTF-8 are the same as runs of such characters. A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15  # odd, 5 modulo 8: its powers have the full period
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)).astype(U64, copy=False)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, U64(b))
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for every i, whatever its place."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93), seed)


_tables: dict[int, np.ndarray] = {}


def byte_values(seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = mix(np.arange(256, dtype=U64), 1000 + seed)
    return _tables[seed]


@dataclass
class Words:
    """The words of the texts lo..hi-1 of a batch. word i is data[starts[i]:ends[i]]; text j has words offsets[j]:offsets[j+1]."""

    lo: int
    hi: int
    data: np.ndarray
    text_offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that start a window of k words of one text, and the windows' hashes."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        last = np.repeat(self.offsets[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + k <= last)
        return at, span_hashes(self.hashes, at, at + k, seed)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def pieces(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, offsets, bytes) of runs of texts of about `most` bytes; a longer text makes a run of its own."""
    off, raw = strings(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, off[lo : hi + 1] - off[lo], raw[off[lo] : off[hi]]
        lo = hi


def hashed_words(column: pa.Array, lower: bool = False, seed: int = 0, most: int = CHUNK_BYTES, cut: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[Words]:
    """cut: two tables of bytes; a word is cut between a byte of the first and a byte of the second."""
    for lo, hi, off, data in pieces(column, most):
        if lower:
            data = LOWER[data]
        inside = ~SPACE[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[off] = True
        begins, stops = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | first[1:-1]
            stops[:-1] &= ~inside[1:] | first[1:-1]
            if cut is not None:
                between = cut[0][data[:-1]] & cut[1][data[1:]]
                begins[1:] |= between
                stops[:-1] |= between
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        hashes = span_hashes(byte_values(seed)[data], starts, ends, seed)
        yield Words(lo, hi, data, off, starts, ends, np.searchsorted(starts, off), hashes)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the memory it no longer needs goes back to the system: a Python worker outlives its task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return tidied
