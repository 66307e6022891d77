"""Pieces of texts that may be one of very many given words: rolling hashes against a filter of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tabwright.session import ship_with_tasks, spread

ship_with_tasks(__name__)

#: Bits of the filter for each word, and in all; beyond that it lets more through, and the join has more to do.
BITS_EACH, MOST_BITS = 64, 1 << 28
#: Bits of a row of Spark's bitmap aggregate.
BUCKET = 1 << 15
#: Code points hashed at once.
CHARS = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), ends


def _doubled(points: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of so many code points from each place), for the powers of two up to ``most``."""
    size, h = 1, _mixed(points + np.uint64(1))
    while size <= most:
        yield size, h
        wider = h[: max(len(h) - size, 0)]
        h, size = _mixed(wider * _FACTOR + h[size : size + len(wider)]), 2 * size


def _of_length(h: np.ndarray, at: np.ndarray, size: int, length: int) -> np.ndarray:
    """Hashes of ``length`` code points (size <= length < 2 * size) by the first and the last ``size`` of them."""
    return _mixed((h[at] * _FACTOR ^ h[at + (length - size)]) + np.uint64(length))


def _two_bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(bits - 1)
    return (h & low).astype(np.int64), (h >> np.uint64(32) & low).astype(np.int64)


def _lets_through(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where both bits of a hash are set."""
    one, two = _two_bits(h, 8 * len(filled))
    there = np.flatnonzero(filled[one >> 3] >> (one & 7) & 1)
    return there[(filled[two[there] >> 3] >> (two[there] & 7) & 1).astype(bool)]


def _start(h: np.ndarray, size: int) -> np.ndarray:
    """What the filter holds of a word besides its whole hash: that of its first ``size`` code points."""
    return _mixed(h ^ np.uint64(size))


def entity_filter(asked: DataFrame) -> Broadcast:
    """A Bloom filter of the texts in ``entity``, of bounded size: each one's hash, and that of its start."""
    spark = asked.sparkSession
    bits = 1 << max(16, min(MOST_BITS, BITS_EACH * asked.count()).bit_length())
    bits = min(bits, MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            points, ends = _code_points(texts)
            lengths = np.diff(ends, prepend=0)
            found = []
            for size, h in _doubled(points, int(lengths.max(initial=0))):
                for length in np.unique(lengths[(lengths >= size) & (lengths < 2 * size)]):
                    at = (ends - lengths)[lengths == length]
                    found += [*_two_bits(_start(h[at], size), bits), *_two_bits(_of_length(h, at, size, int(length)), bits)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found or [np.zeros(0, np.int64)])))], ["place"])

    # Spark counts bits from 1.
    place = F.col("place") + 1
    parts = spread(asked).mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number(place).alias("bucket"))
    filled = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).toLocalIterator():
        start = (bucket - 1) * (BUCKET // 8)
        filled[start : start + BUCKET // 8] = np.frombuffer(bitmap, np.uint8)
    return spark.sparkContext.broadcast(filled)


def pieces(known: Broadcast, lengths: Sequence[int]):
    """For ``mapInArrow`` over (id, text): (id, piece) for the pieces of the given lengths that the filter lets through."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sizes = np.cumsum([len(t) for t in texts])
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + CHARS, "right")))
                yield _cut(ids[first:last], texts[first:last])
                first = last

    def _cut(ids: np.ndarray, texts: list[str]) -> pa.RecordBatch:
        filled = known.value
        points, ends = _code_points(texts)
        own = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        left = ends[own] - np.arange(len(points))  # code points up to the text's end
        rows, parts = [], []
        for size, h in _doubled(points, max(lengths)):
            wanted = [n for n in lengths if size <= n < 2 * size]
            if not wanted:
                continue
            begun = _lets_through(filled, _start(h, size))
            for length in wanted:
                at = begun[left[begun] >= length]
                kept = _lets_through(filled, _of_length(h, at, size, length))
                at = at[kept]
                begin = at - np.concatenate([[0], ends])[own[at]]
                # Each piece once for a text.
                for row, piece in {(row, texts[row][i : i + length]) for i, row in zip(begin.tolist(), own[at].tolist())}:
                    rows.append(row)
                    parts.append(piece)
        return pa.RecordBatch.from_arrays([pa.array(ids[np.array(rows, np.int64)], pa.int64()), pa.array(parts, pa.string())], ["id", "piece"])

    return cut
