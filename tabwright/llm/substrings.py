"""Substring dedup with prefix-partitioned suffix trees.

A window is a run of ``WINDOW`` consecutive words of a document. A word goes when a window that
covers it starts, with the same words, in a document with a smaller id as well.

1. *Candidates.* Equal windows hold the same smallest ``GRAM``-word hash, at the same place. Only
   these hashes (about one word in four) are shuffled; those that two different texts share mark
   the suffixes that can repeat. Of equal texts the one with the smallest id stands for all.
2. *Trees.* The marked suffixes are dealt out by a prefix, which is longer where the mark says
   that it is frequent. A group's suffixes, sorted by their words, are the leaves of its subtree
   in order; the common prefix of neighbours gives the inner nodes, and a node at the depth of a
   window is a repeat, owned by its smallest document. Within a slice of texts equal suffixes
   are combined before they are shuffled.
3. *Cutting.* The repeated starts come back to their documents, whose kept words are joined.

Edges are hashes of four to five words; a leaf is told from another by 112 bits of them.

Nulls: a null text has no words. A row without an id is never cut and owns nothing. Rows repeated
with the same id and text are treated alike; rows of one id with different texts are told apart
by their text and do not cut each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.textscan import Words, mix, ragged, scan, shingle_hashes, slices, word_hashes
from tabwright.session import input_bytes, ship_with_tasks, staged

ship_with_tasks(__name__)

WINDOW = 13
GRAM = 7
#: Words up to which each edge of the tree reaches: prefix lengths that groups may be formed by.
DEPTHS = (4, 8, 13)
#: Texts that share a mark before longer prefixes part its suffixes.
FREQUENT = (256, 4096)
#: Bytes of input text behind one group.
GROUP_BYTES = 64 << 20
UNKNOWN_BYTES = 1 << 50
#: Bytes of entries a task holds before it sends them.
GATHER_BYTES = 32 << 20


def groups_for(docs: DataFrame) -> int:
    """Groups of bounded size: they grow with the input (its files hold about half the text's bytes)."""
    size = 2 * input_bytes(docs)
    if size >= UNKNOWN_BYTES:  # what Spark assumes of rows that don't come from files
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, size // GROUP_BYTES)


# --- windows and their marks ------------------------------------------------------------------


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word each window starts at, first window of each text)."""
    count = np.maximum(np.diff(first) - (WINDOW - 1), 0)
    return ragged(first[:-1], count), np.concatenate([[0], np.cumsum(count)])


def marks(hashes: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at each word, word that holds each window's smallest gram)."""
    grams, gram_first = shingle_hashes(hashes, first, GRAM)
    at_word = np.zeros(len(hashes), np.uint64)
    at_word[ragged(first[:-1], np.diff(gram_first))] = grams
    best, place = at_word[starts], starts.copy()
    for j in range(1, WINDOW - GRAM + 1):
        other = at_word[starts + j]
        less = other < best
        best[less] = other[less]
        place[less] = starts[less] + j
    return at_word, place


def text_digests(words: Words) -> np.ndarray:
    """64 bits of each whole text; ``digest_of`` is the same as a column."""
    raw = words.data[:-8].tobytes()
    own = [hashlib.md5(raw[a:b]).digest()[:8] for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]
    return np.frombuffer(b"".join(own), ">i8").astype(np.int64)


def digest_of(text: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 16), 16, -10).cast("long")


def joined(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def pack_entries(ids: np.ndarray, digests: np.ndarray, text: np.ndarray, where: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Entries (text of the slice, word, values) as bytes, by text and word.

    Texts are written once with the number of their entries, words as steps, 64-bit values as their lower 48 bits.
    """
    order = np.lexsort((where, text))
    text, where = text[order], where[order].astype(np.int64)
    used, begin, count = np.unique(text, return_index=True, return_counts=True)
    steps = np.diff(where, prepend=0)
    steps[begin] = where[begin]
    out = [np.array([len(used), len(text)], np.int64), ids[used].astype(np.int64), digests[used].astype(np.int64)]
    out += [count.astype(np.uint32), steps.astype(np.uint32)]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        out.append(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :6]) if c.dtype == np.uint64 else c)
    return b"".join(x.tobytes() for x in out)


def unpack_entries(blob: bytes, kinds: tuple) -> tuple[np.ndarray, ...]:
    """(document, digest, word, values...) of each entry."""
    texts, n = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, out = 16, []
    for kind, m in ((np.int64, texts), (np.int64, texts), (np.uint32, texts), (np.uint32, n)):
        out.append(np.frombuffer(blob, kind, m, at))
        at += out[-1].nbytes
    ids, digests, count, steps = out
    count = count.astype(np.int64)
    total = np.cumsum(steps, dtype=np.int64)
    begin = np.cumsum(count) - count
    before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0)
    values = []
    for kind in kinds:
        if kind == np.uint64:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
            at += 6 * n
            values.append(wide.reshape(-1).view(np.uint64))
        else:
            values.append(np.frombuffer(blob, kind, n, at))
            at += values[-1].nbytes
    return np.repeat(ids, count), np.repeat(digests, count), (total - np.repeat(before, count)).astype(np.uint32), *values


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's counts, as if nothing were cut."""
    for part in slices(batches, "text"):
        w = scan(part.column("text"))
        raw, digests = w.data[:-8].tobytes(), text_digests(w)
        kept = [hashlib.sha256(joined(raw[a:b])).hexdigest() for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(digests), pa.array(w.count.astype(np.int64)), pa.array(kept)], ["id", "digest", "n_words", "kept_sha256"]
        )


def _mark_rows(groups: int):
    """The marks of a task's texts by group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Gathered(groups)
        for part in slices(batches, "text"):
            w = scan(part.column("text"))
            starts, window_first = window_starts(w.first)
            if not len(starts):
                continue
            at_word, place = marks(word_hashes(w), w.first, starts)
            ids = part.column("id")
            named = np.array(ids.is_valid())
            id_of = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            chosen = np.unique(place[named[np.repeat(np.arange(part.num_rows), np.diff(window_first))]])
            text = np.searchsorted(w.first, chosen, side="right") - 1
            digests, mark = text_digests(w), at_word[chosen]
            yield from sent.add(mark >> np.uint64(48), lambda e: pack_entries(id_of, digests, text[e], chosen[e] - w.first[text[e]], [mark[e]]))
        yield from sent.flush()

    return rows


class _Gathered:
    """Packed entries by group, held back until a task has GATHER_BYTES of them: a row for each group then, not for
    each group and slice, so rows follow what is sent."""

    def __init__(self, groups: int):
        self.groups, self.held, self.size = groups, {}, 0

    def add(self, key: np.ndarray, packed) -> Iterator[pa.RecordBatch]:
        """Take entries to the groups of their keys; ``packed`` gives the bytes of some of them."""
        group = (mix(key) % np.uint64(self.groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            raw = packed(order[a:b])
            self.held.setdefault(int(group[order[a]]), []).extend((len(raw).to_bytes(8, "little"), raw))
            self.size += len(raw)
        if self.size >= GATHER_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            numbers = sorted(self.held)
            rows = pa.array([b"".join(self.held[n]) for n in numbers], pa.binary())
            self.held, self.size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)), rows], ["group", "packed"])


def _blobs(table: pa.Table) -> Iterator[bytes]:
    """What slices packed for a group."""
    for row in table.column("packed"):
        raw, at = row.as_py(), 0
        while at < len(raw):
            size = int.from_bytes(raw[at : at + 8], "little")
            yield raw[at + 8 : at + 8 + size]
            at += 8 + size


PACKED = "group int, packed binary"


def shared_marks(table: pa.Table) -> pa.Table:
    """Of one group: the marks that at least two texts have, packed by document.

    Of equal texts only the smallest document is kept. A place is a word number, and in its
    upper two bits how frequent the mark is.
    """
    parts = [unpack_entries(b, (np.uint64,)) for b in _blobs(table)]
    ids, digests, where, mark = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, digests, mark))
    ids, digests, mark, where = ids[order], digests[order], mark[order], where[order]
    new_mark = np.concatenate([[True], mark[1:] != mark[:-1]])
    new_text = new_mark | np.concatenate([[True], digests[1:] != digests[:-1]])
    texts_of_mark = np.add.reduceat(new_text.astype(np.int64), np.flatnonzero(new_mark))[np.cumsum(new_mark) - 1]
    smallest = ids[np.flatnonzero(new_text)][np.cumsum(new_text) - 1]
    keep = (texts_of_mark > 1) & (ids == smallest)
    ids, digests, where = ids[keep], digests[keep], where[keep]
    level = np.searchsorted(FREQUENT, texts_of_mark[keep], side="right").astype(np.uint32)
    return _by_document(ids, digests, where | (level << np.uint32(30)))


def _by_document(ids: np.ndarray, digests: np.ndarray, places: np.ndarray) -> pa.Table:
    order = np.lexsort((places, digests, ids))
    ids, digests, places = ids[order], digests[order], places[order]
    cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(ids)) if len(ids) else cuts
    blobs = [places[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts, ends)]
    return pa.table({"id": pa.array(ids[cuts], pa.int64()), "digest": pa.array(digests[cuts], pa.int64()), "places": pa.array(blobs, pa.binary())})


PLACES = "id long, digest long, places binary"


# --- suffixes and trees -----------------------------------------------------------------------


def _suffix_rows(groups: int):
    """Marked suffixes by group. Equal ones of a slice are combined: those of a larger document go along as judged."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gathered(groups)
        for part in slices(batches, "text"):
            w = scan(part.column("text"))
            digests = text_digests(w)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            sent = [np.concatenate([np.frombuffer(b, np.uint32) for b in own]) for own in part.column("places").to_pylist()]
            right = digests == part.column("digest").to_numpy()
            sent = [s if ok else s[:0] for s, ok in zip(sent, right)]
            hashes = word_hashes(w)
            starts, window_first = window_starts(w.first)
            if not len(starts) or not sum(map(len, sent)):
                continue
            level = np.zeros(len(hashes), np.uint8)
            everywhere = np.concatenate(sent)
            at = np.repeat(w.first[:-1], [len(s) for s in sent]) + (everywhere & np.uint32((1 << 30) - 1)).astype(np.int64)
            level[at] = (everywhere >> np.uint32(30)) + 1
            _, place = marks(hashes, w.first, starts)
            live = level[place] > 0
            text = np.repeat(np.arange(part.num_rows), np.diff(window_first))[live]
            level, starts = level[place[live]] - 1, starts[live]
            edges = [_edge(hashes, starts, a, b) for a, b in zip((0, *DEPTHS), DEPTHS)]
            order = np.lexsort((ids[text], edges[2], edges[1], edges[0]))
            edges, text, starts, level = [e[order] for e in edges], text[order], starts[order], level[order]
            new = np.concatenate([[True], np.any([e[1:] != e[:-1] for e in edges], axis=0)])
            leaf = np.flatnonzero(new)
            owner = ids[text[leaf]][np.cumsum(new) - 1]
            beaten = (ids[text] > owner).astype(np.uint8)
            where = starts - w.first[text]
            prefix = edges[0].copy()
            for depth in (1, 2):
                prefix = np.where(level >= depth, mix(prefix ^ edges[depth]), prefix)
            upper, lower = edges[0].astype(np.uint32), edges[1].astype(np.uint32)

            def packed(e, ids=ids, digests=digests, text=text, where=where, beaten=beaten, edges=(upper, lower, edges[2])):
                live, gone = e[beaten[e] == 0], e[beaten[e] == 1]
                own = pack_entries(ids, digests, text[live], where[live], [x[live] for x in edges])
                return len(own).to_bytes(8, "little") + own + pack_entries(ids, digests, text[gone], where[gone], [])

            yield from out.add(prefix, packed)
        yield from out.flush()

    return rows


def _edge(hashes: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hash of words a to b of each suffix."""
    out = hashes[starts + a]
    for j in range(a + 1, b):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[starts + j]
    return mix(out)


def repeated_starts(table: pa.Table) -> pa.Table:
    """One group's subtree: the starts whose window a smaller document has too.

    Sorted by their edges, suffixes are the tree's leaves in order. Neighbours that share all
    edges hang from one node as deep as a window.
    """
    trees, judged = [], []
    for blob in _blobs(table):
        size = int.from_bytes(blob[:8], "little")
        trees.append(unpack_entries(blob[8 : 8 + size], EDGE_KINDS))
        judged.append(unpack_entries(blob[8 + size :], ()))
    ids, digests, where, *edges = (np.concatenate(x) for x in zip(*trees))
    depth, order = common_depths(edges, ids)
    ids, digests, where = ids[order], digests[order], where[order]
    leaf = np.flatnonzero(depth < DEPTHS[-1])  # a leaf whose neighbour before shares less than a window
    owner = np.repeat(ids[leaf], np.diff(np.append(leaf, len(ids))))
    later = ids > owner
    found = zip((ids[later], digests[later], where[later]), (np.concatenate(x) for x in zip(*judged)))
    return _by_document(*(np.concatenate(x) for x in found))


EDGE_KINDS = (np.uint32, np.uint32, np.uint64)


def common_depths(edges: list[np.ndarray], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words each suffix shares with the one before it, order of the suffixes); ties by ``last``."""
    order = np.lexsort((last, *edges[::-1]))
    depth = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for edge, words in zip(edges, DEPTHS):
        same &= edge[order][1:] == edge[order][:-1]
        depth[1:][same] = words
    return depth, order


# --- cutting ----------------------------------------------------------------------------------


def cut_words(raw: bytes, starts: np.ndarray) -> tuple[list[bytes], int, list[bool]]:
    """(kept words, words removed, mask of removed words)."""
    words = raw.split()
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts.astype(np.int64) + WINDOW, len(words)), -1)
    mask = np.cumsum(gone[:-1]) > 0
    kept = [w for w, m in zip(words, mask.tolist()) if not m]
    return kept, int(mask.sum()), mask


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sent = [np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in own])) for own in part.column("places").to_pylist()]
        done = [cut_words((t or "").encode(), s) for t, s in zip(part.column("text").to_pylist(), sent)]
        kept = [b" ".join(k).decode() for k, _, _ in done]
        removed = pa.array([n for _, n, _ in done], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), part.column("digest"), removed, pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept]), pa.array(kept)],
            ["id", "digest", "n_removed", "kept_sha256", "kept_text"],
        )


def removed_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For documents (id long, text): (every row's counts, repeated starts by document, texts that have candidates).

    Every row: id, digest, n_words, kept_sha256 (as if nothing were cut).
    Starts: id, digest, places (lists of packed word numbers), for the smallest of equal texts.
    """
    groups = groups_for(docs)
    marked = docs.mapInArrow(_mark_rows(groups), PACKED).repartition(groups, "group").groupBy("group").applyInArrow(shared_marks, PLACES)
    marked = marked.groupBy("id", "digest").agg(F.collect_list("places").alias("places"))
    texts = staged(docs.join(marked, "id").select("id", "digest", "places", "text"), "marked-texts")
    judged = texts.mapInArrow(_suffix_rows(groups), PACKED).repartition(groups, "group").groupBy("group").applyInArrow(repeated_starts, PLACES)
    judged = judged.groupBy("id", "digest").agg(F.collect_list("places").alias("places"))
    every = staged(docs.mapInArrow(_counted, "id long, digest long, n_words long, kept_sha256 string"), "counted")
    return every, judged, texts.select("id", "digest", "text")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, copy (an equal text has a smaller id), kept_text.

    ``kept_text`` is given where a part of the text was cut, else null: nothing is left of a copy that
    is cut, and an uncut text is as it was.
    """
    kind = docs.schema[id].dataType
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    every, judged, texts = removed_windows(rows)
    judged = texts.join(judged, ["id", "digest"]).dropDuplicates(["id", "digest"])
    cut = staged(judged.mapInArrow(_cut_rows, "id long, digest long, n_removed long, kept_sha256 string, kept_text string"), "cut")
    # Equal texts: the smallest id of each that occurs more than once.
    same = ["digest", "kept_sha256"]
    twice = every.filter("id IS NOT NULL").groupBy(*same).agg(F.min("id").alias("smallest"), F.max("id").alias("largest"))
    twice = staged(twice.filter("smallest < largest").select(*same, "smallest"), "equal-texts")
    out = every.join(twice, same, "left").join(cut.withColumnRenamed("kept_sha256", "cut_sha256"), ["id", "digest"], "left")
    copy = F.coalesce(F.col("id") > F.col("smallest"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("id").cast(kind).alias(id),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        copy.alias("copy"),
        "digest",
        F.when(~copy, F.col("kept_text")).alias("kept_text"),
    )
