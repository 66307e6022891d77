"""Words of many texts at once: numpy arrays over the Arrow buffer of a batch.

A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return. Nulls count as empty texts. Work memory is a small multiple of the bytes of
one slice (see ``slices``), whatever the length of the batch.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession

from tabwright.session import ship_with_tasks

ship_with_tasks(__name__)

#: Bytes of text looked at together; a longer single text makes a slice of its own.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 15

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


@dataclass
class Words:
    """Byte ranges of all words; ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # the texts' bytes, then eight zeros
    bounds: np.ndarray  # byte range of text i: bounds[i]:bounds[i + 1]
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text each word lies in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, SLICE_ROWS rows at most."""
    for batch in batches:
        size = np.cumsum(text_bytes(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            stop = min(stop, at + SLICE_ROWS)
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(texts: pa.Array) -> np.ndarray:
    return np.diff(_buffers(texts)[1])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, byte bounds of each)."""
    return _buffers(texts)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    if not len(texts) or where is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    found = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return found, bounds - bounds[0]


def scan(texts: pa.Array, lower: bool = False) -> Words:
    """The words of every text; ``lower`` folds A to Z."""
    raw, bounds = _buffers(texts)
    data = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=data[: len(raw)]) if lower else np.copyto(data[: len(raw)], raw)
    solid = ~SPACE[raw]
    cuts = bounds[:-1][bounds[:-1] < len(raw)]
    fresh, last = solid.copy(), solid.copy()
    fresh[1:] &= ~solid[:-1]
    fresh[cuts] |= solid[cuts]
    last[:-1] &= ~solid[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] |= solid[cuts]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    left = end - start
    out = mix((eight[start] & MASK[np.minimum(left, 8)]) ^ _U(seed))
    live = np.flatnonzero(left > 8)
    at, rest = start[live] + 8, left[live] - 8
    while len(live):
        out[live] = mix(out[live] * _U(0x9E3779B97F4A7C15) ^ eight[at] & MASK[np.minimum(rest, 8)])
        more = rest > 8
        live, at, rest = live[more], at[more] + 8, rest[more] - 8
    return mix(out + left.astype(np.uint64))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    return range_hashes(words.data, words.start, words.end, seed)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and ``first`` for windows: those of text i, in order."""
    windows = np.maximum(np.diff(first) - (k - 1), 0)
    starts = np.concatenate([[0], np.cumsum(windows)])
    at = ragged(first[:-1], windows)
    out = hashes[at]
    for j in range(1, k):
        out *= _U(0xD1342543DE82EF95)
        out += hashes[at + j]
    return mix(out), starts


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)


def per_text(values: np.ndarray, first: np.ndarray, how: np.ufunc = np.add, empty=0) -> np.ndarray:
    """``how`` over the values of each text; ``empty`` where it has none."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, dtype=values.dtype if how is not np.add else np.result_type(values.dtype, np.int64) if values.dtype == bool else values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = how.reduceat(values, first[full], axis=0, dtype=out.dtype)
    return out


def crc_mod(ids: list, mod: int) -> np.ndarray:
    """crc32 of the id as text, modulo ``mod``; -1 where it is null."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % mod for i in ids], dtype=np.int64)


def share(spark: SparkSession, model: object) -> Broadcast:
    """Broadcast a model of bounded size by value: executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shared(sent: Broadcast) -> object:
    return pickle.loads(sent.value)
