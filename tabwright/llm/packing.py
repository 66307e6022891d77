"""Packing along a space-filling curve.

Each document becomes token ids and a hashed vector: the mean of pseudo-random vectors that its
ids stand for, in a few dimensions. Documents are range-sorted by the Hilbert key of that vector,
so neighbours are alike, and each range packs its documents in that order, cutting them where a
sequence is full. What is left at the end of a range is cut into powers of two, so nothing is
padded. Equal keys are spread by a hash of the id, so many copies do not share one task.

Ids are those of the tokenizer file; a text is cut at white space into units the tokenizer never
merges across, and every distinct unit of a slice is encoded once. Texts with other white space
than ASCII's are encoded whole.

Nulls: a null text is empty and gives the end id alone; null ids are packed like others, repeated
rows one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.textscan import SPACE, mix, per_text, ragged, range_hashes, scan, share, shared, slices
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

LENGTH = 2048
END = 1
DIMS = 4
KEY_BITS = 8  # of each dimension
SLICE_BYTES = 6 << 20
_NEWLINE = 10
_WIDE_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]"
)

_WIDE_HINTS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", *(bytes([b]) for b in range(0x1C, 0x20))]

#: How a byte-level vocabulary writes bytes, and how it cuts text before merging.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(file: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level BPE file whose ids are in merge order."""
    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    others = iter(range(256, 512))
    written = {chr(b) if b in _PLAIN else chr(next(others)): b for b in range(256)}
    return {
        bytes(written[c] for c in token): i for token, i in model.items() if all(c in written for c in token) and not token.startswith("<|")
    }


def encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


def _units(texts: pa.Array) -> tuple:
    """(bytes, unit starts, unit ends, first unit of each text, white-space unit?).

    A unit is a word with the blank before it, or white space that belongs to no word.
    """
    w = scan(texts)
    text = w.text
    before = np.where(np.arange(len(w.start)) == w.first[:-1][text], w.bounds[:-1][text], np.concatenate([[0], w.end[:-1]])) if len(w.start) else w.start
    gap = w.start - before
    blank = (gap > 0) & (w.data[np.maximum(w.start - 1, 0)] == 0x20)
    long, odd = gap > 1, (gap > 0) & ~blank
    last = np.where(w.count > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, w.bounds[:-1])
    tail = last < w.bounds[1:]
    start = np.concatenate([w.start - blank, before[long], w.start[odd] - 1, last[tail]])
    end = np.concatenate([w.end, w.start[long] - 1, w.start[odd], w.bounds[1:][tail]])
    space = np.concatenate([np.zeros(len(w.start), bool), np.ones(len(start) - len(w.start), bool)])
    order = np.argsort(start, kind="stable")
    start, end, space = start[order], end[order], space[order]
    return w.data, start, end, np.searchsorted(start, w.bounds), space


class Known:
    """Token ids of the units met so far, by the units' hash; forgotten when they grow too many."""

    LIMIT = 1_000_000

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def add(self, hashes: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        begin = len(self.ids) + np.cumsum(count) - count
        joined = np.concatenate([self.hashes, hashes])
        order = np.argsort(joined)
        self.hashes = joined[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, ids])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, whether it is known)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def token_ids(texts: pa.Array, enc: tiktoken.Encoding, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text), each text followed by the end id."""
    data, start, end, first, space = _units(texts)
    raw = data.tobytes()
    distinct, which, place = np.unique(range_hashes(data, start, end), return_index=True, return_inverse=True)
    new = ~known.find(distinct)[1]
    if len(known.hashes) + new.sum() > known.LIMIT:
        known.__init__()
        new[:] = True
    words, spaces = new & ~space[which], new & space[which]
    if words.any():
        # New words go through the encoder in one text with line breaks between; no word has one inside.
        at = which[words]
        joined = b"\n".join([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
        ids = enc.encode_to_numpy(joined.decode("utf-8", "replace"))
        (newline,) = enc.encode_ordinary("\n")
        breaks = np.flatnonzero(ids == newline)
        count = np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1
        known.add(distinct[words], count, ids[ids != newline].astype(np.uint16))
    if spaces.any():
        at = which[spaces]
        ids = [enc.encode_ordinary(raw[a:b].decode()) for a, b in zip(start[at].tolist(), end[at].tolist())]
        count = np.array([len(x) for x in ids], np.int64)
        known.add(distinct[spaces], count, np.array([i for x in ids for i in x], np.uint16))
    unit = known.find(distinct)[0][place]
    per_unit = known.count[unit] if len(unit) else np.zeros(0, np.int64)
    flat = known.ids[ragged(known.begin[unit], per_unit)] if len(unit) else known.ids[:0]
    ends = np.concatenate([[0], np.cumsum(per_unit)])[first[1:]]
    sizes = np.diff(np.concatenate([[0], ends]))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(bounds[-1], END, np.uint16)
    out[ragged(bounds[:-1], sizes)] = flat
    return _whole_where_needed(texts, enc, out, bounds, raw, len(first) - 1)


def _whole_where_needed(texts, enc, ids, first, raw, rows):
    """Texts with wide white space again, encoded whole."""
    if not any(hint in raw for hint in _WIDE_HINTS) or not _WIDE_SPACE.search(raw):
        return ids, first
    own = [ids[first[i] : first[i + 1]] for i in range(rows)]
    for i, text in enumerate(texts.to_pylist()):
        if text and _WIDE_SPACE.search(text.encode()):
            own[i] = np.append(np.array(enc.encode_ordinary(text), np.uint16), np.uint16(END))
    return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows x dims), each below ``2**bits``."""
    x = points.T.astype(np.int64).copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[i] ^= swap
            x[0] ^= np.where(flip, low, swap if i else 0)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry = np.where((x[dims - 1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hilbert keys of the documents' vectors; each id's vector comes from a hash of the id."""
    drawn = mix(np.arange(DIMS << 16, dtype=np.uint64) + np.uint64(0x51)).reshape(1 << 16, DIMS)
    table = ((drawn >> np.uint64(40)).astype(np.float32) / (1 << 23) - 1) * np.float32(np.sqrt(3))
    mean = per_text(table[ids], first) / np.maximum(np.diff(first), 1)[:, None]
    grid = 1 << KEY_BITS
    return hilbert(np.clip((1 / (1 + np.exp(-8 * mean))) * grid, 0, grid - 1).astype(np.int64), KEY_BITS)


def tokenized(docs: DataFrame, file: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, curve (Hilbert key), ids (unsigned 16-bit, little endian, the end id last)."""
    sent = share(docs.sparkSession, vocabulary(file))  # the vocabulary, of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(shared(sent)), Known()
        for part in slices(batches, "text", SLICE_BYTES):
            ids, first = token_ids(part.column("text"), enc, known)
            packed = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(curve_keys(ids, first)), packed], ["id", "curve", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, curve long, ids binary")


def cut_sequences(docs: list[np.ndarray], length: int, room: list, local: int) -> tuple[list, list, int]:
    """Lay documents end to end and cut at ``length``.

    ``room`` holds the pieces (document, start, ids, document size) of the open sequence. Returns the
    finished pieces (document, start, ids, size, sequence, offset), the open ones and the next sequence.
    """
    done, used = [], sum(len(p[2]) for p in room)
    for name, ids in docs:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, length - used)
            room.append((name, at, ids[at : at + take], len(ids)))
            at, used = at + take, used + take
            if used == length:
                done += _numbered(room, local)
                room, used, local = [], 0, local + 1
    return done, room, local


def _numbered(pieces: list, sequence: int) -> list:
    out, offset = [], 0
    for name, start, ids, size in pieces:
        out.append((name, start, ids, size, sequence, offset))
        offset += len(ids)
    return out


def close_sequence(room: list, local: int) -> list:
    """The open sequence cut into powers of two, the largest first."""
    done, rest = [], room
    while rest:
        total = sum(len(p[2]) for p in rest)
        part = 1 << (total.bit_length() - 1)
        taken, after = [], []
        for name, start, ids, size in rest:
            here = min(part, len(ids))
            part -= here
            if here:
                taken.append((name, start, ids[:here], size))
            if here < len(ids):
                after.append((name, start + here, ids[here:], size))
        done += _numbered(taken, local)
        rest, local = after, local + 1
    return done


def pack_documents(docs: DataFrame, file: str, length: int = LENGTH, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds
    the ids (unsigned 16-bit, little endian).

    Tokenized documents are written once, so sorting them never encodes a text again. A sequence is
    numbered by its range and its place there.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = staged(tokenized(docs, file, id, text), "tokenized")
    ordered = rows.withColumn("spread", F.xxhash64("id"))
    ordered = ordered.repartitionByRange("curve", "spread").sortWithinPartitions("curve", "spread", "id", "ids")

    def batch(pieces: list) -> pa.RecordBatch:
        name, start, ids, size, sequence, offset = zip(*pieces)
        wide = [x.astype("<u4") for x in ids]
        columns = {
            id: pa.array(name, known), "start": start, "length": [len(x) for x in ids],
            "ids_crc32": [zlib.crc32(x.tobytes()) for x in wide], "doc_tokens": size,
            "sequence_id": sequence, "offset": offset,
        }
        if with_ids:
            columns["ids"] = pa.array([x.tobytes() for x in ids], pa.binary())
        return pa.RecordBatch.from_pydict({k: v if k in (id, "ids") else pa.array(v, pa.int64()) for k, v in columns.items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal known
        room, local = [], TaskContext.get().partitionId() << 40
        for part in batches:
            known = part.schema.field("id").type
            names, packed = part.column("id").to_pylist(), part.column("ids").to_pylist()
            docs_here = [(n, np.frombuffer(b, np.uint16)) for n, b in zip(names, packed)]
            done, room, local = cut_sequences(docs_here, length, room, local)
            if done:
                yield batch(done)
        done = close_sequence(room, local)
        if done:
            yield batch(done)

    known = None
    numbers = ", ".join(f"`{c}` long" for c in ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return ordered.select("id", "ids").mapInArrow(pack, f"`{id}` {kind}, {numbers}" + (", ids binary" if with_ids else ""))
