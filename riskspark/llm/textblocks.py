"""Vectorised work on the bytes of Arrow text columns: word bounds and 64-bit word hashes without Python strings.

Spark hands a task its rows as Arrow batches; `runs` cuts a batch into runs of whole documents of about `RUN_BYTES`, so
the working set stays small whatever the batch holds. One document beyond that size is a run of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

RUN_BYTES = 1 << 20
#: Arrow batches that tasks get, at most (or one row), so that memory doesn't depend on how long texts are.
BATCH_BYTES = 8 << 20

#: White space is these bytes, and a word any other byte; all are ASCII, so UTF-8 texts are cut at code points.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_seeds = np.random.Generator(np.random.PCG64(42))
_BYTE = _seeds.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWERED = _BYTE.copy()
_LOWERED[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


class Run(NamedTuple):
    """Documents first..last of a batch: their bytes, and where each begins in them (one bound more than documents)."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Where each word starts and ends in the bytes of a run, and how many words come before each document."""

    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray


def in_batches(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """`mapInArrow` over batches of bounded size; the worker, which lives on, gives free memory back after its task."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(lambda batches: giving_back(work, batches), schema)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `work` yields; then memory that was freed but kept goes back to the system. Idle workers of earlier stages
    count towards an executor's memory as much as those at work."""
    try:
        yield from work(batches)
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, grown by doubling."""
    known = _powers[base]
    while len(known) < n:
        step = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * step])
    _powers[base] = known
    return known[:n]


def texts_of(column: pa.Array) -> pa.Array:
    """The column as large strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    texts = texts_of(column)
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield Run(first, last, whole[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
        first = last


def words(run: Run, space: np.ndarray = SPACE) -> Words:
    """Words never cross from one document into the next. `space` tells for each byte whether it separates words."""
    word = ~space[run.data]
    n = len(word)
    opens, closes = word.copy(), word.copy()
    if n:
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        begin = run.bounds[:-1][run.bounds[:-1] < run.bounds[1:]]
        opens[begin] = word[begin]
        final = run.bounds[1:][run.bounds[:-1] < run.bounds[1:]] - 1
        closes[final] = word[final]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, run.bounds))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(run: Run, found: Words, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z if `lower`: differences of one running polynomial."""
    table = _LOWERED if lower else _BYTE
    total = np.zeros(len(run.data) + 1, np.uint64)
    np.cumsum(table[run.data] * _power(_BASE, len(run.data)), out=total[1:])
    inverse = _power(_INVERSE, len(run.data) + 1)
    return mixed((total[found.ends] - total[found.starts]) * inverse[found.starts])


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` neighbours, for as many places as there are."""
    out = hashes[:len(hashes) - width + 1] if len(hashes) >= width else hashes[:0]
    for k in range(1, width):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:len(hashes) - width + 1 + k])
    return out


def shingle_hashes(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by document) of every `width` words in a row; a document with fewer has its whole sequence."""
    counts = np.diff(before)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(bounds[-1], np.uint64)
    every = chained(hashes, width)
    doc = np.repeat(np.arange(len(counts)), n)
    place = np.arange(bounds[-1]) - bounds[:-1][doc] + before[:-1][doc]
    full = counts[doc] >= width
    out[full] = every[place[full]]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        out[bounds[d]] = chained(hashes[before[d]:before[d + 1]], int(counts[d]))[0]
    return out, bounds
