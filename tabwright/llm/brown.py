"""Language-model scores from Brown's class-based bigrams.

A text is its words, A to Z in lower case, and one end token. Every word has a class; a token's
probability is that of its class after the class before it, times that of the word in its class.

- Counts of all words of all training texts are kept, sharded by the word's hash: each slice of
  texts sends its distinct words once per shard. They grow with the corpus and never meet in one
  place.
- Exchange clustering assigns the classes: a word moves to the class that raises the likelihood of
  the training bigrams most. A table of fixed size gives the start: there the frequent words move
  one by one, all others with their kind (first and last bytes). From there every counted word
  moves by its own bigrams, in sweeps over the shards; unseen words keep the class of their kind.
- The number of classes grows with the cube root of the vocabulary, so the table of classes grows
  slower than it. In a sweep half of the words, by hash, move against the table before the sweep;
  a sweep that lowers the likelihood is taken back and is the last.
- Smoothing: transitions are interpolated with the classes' own shares; in a class every word
  counts a tenth more than it was seen, and one further word stands for the unseen.

Texts are encoded once, in slices: their distinct words by shard and the tokens as places among
these. Shards send a slice the classes and counts of its words; a slice sends a shard how often each
of its words that move in a sweep stands beside each class.

Nulls: a null text has the end token alone; a row without an id is held out. Repeated rows count
and are scored one by one. Without training texts all counts are zero and the class model is
uniform. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.textscan import MASK, Words, mix, per_text, scan, share, shared, slices, word_hashes
from tabwright.session import drop_shuffles, input_bytes, ship_with_tasks, staged, unstaged

ship_with_tasks(__name__)

ADD = 0.1
CLASSES = 64
#: Words with a class of their own choice at the start; all others are of one of KINDS kinds there.
FREQUENT = 1024
KINDS = 3072
#: Weight of the classes' own shares in a transition.
BACKOFF = 5.0
SWEEPS = 8
SHARD_BYTES = 16 << 20
SLICE_BYTES = 4 << 20
#: Sweeps over the shards; in each, half of the words may move.
SHARD_SWEEPS = 2
#: (word, class) counts looked at together.
ENTRIES = 1 << 11
#: Counts up to this many get their gains from a table.
FEW = 8
MISSING = 0xFFFF


def classes_for(distinct: int) -> int:
    """Classes of words; the end token has one more."""
    return max(CLASSES, math.ceil(distinct ** (1 / 3)))


def shards_for(docs: DataFrame) -> int:
    return max(64, 2 * input_bytes(docs) // SHARD_BYTES)


@dataclass
class Model:
    kinds: np.ndarray  # class of each kind, for unseen words
    step: np.ndarray  # log10 of class transitions
    inside: np.ndarray  # per class log10 of (words' counts + ADD * (words + 1))
    total: int  # training tokens
    distinct: int
    ends: int


# --- words and types --------------------------------------------------------------------------


def kinds_of(words: Words, which: np.ndarray) -> np.ndarray:
    """The kind of words: a hash of their first two bytes and their last one."""
    start, end = words.start[which], words.end[which]
    if not len(start):
        return np.zeros(0, np.int64)
    eight = np.ndarray((len(words.data) - 7,), "<u8", words.data.data, strides=(1,))
    head = eight[start] & MASK[np.minimum(end - start, 2)]
    tail = words.data[end - 1].astype(np.uint64)
    return (mix(head ^ (tail << np.uint64(32))) % np.uint64(KINDS)).astype(np.int64)


def types_of(hashes: np.ndarray, kinds: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The type of words: a frequent word's number, or FREQUENT plus its kind."""
    kind = FREQUENT + kinds.astype(np.int64)
    if not len(frequent):
        return kind
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, at, kind)


TYPES = FREQUENT + KINDS + 1  # the last is the end token


def _sequence(tokens: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(token before, token) of every token of all texts, each text followed by its end; it also starts after one."""
    out = np.full(len(tokens) + len(count), end, np.int64)
    out[np.arange(len(tokens)) + np.repeat(np.arange(len(count)), count)] = tokens
    return np.concatenate([[end], out[:-1]]), out


def _pack(*arrays: np.ndarray) -> bytes:
    raw = pickle.dumps(arrays, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))


# --- counting ---------------------------------------------------------------------------------

#: What a row holds: a slice's texts, its words by shard, a shard's words, the places of a slice's words
#: among them, a shard's classes, those of a slice's words, counts beside classes, and a slice's table.
TEXTS, ASKED, WORDS, PLACES, CLASSED, SENT, BESIDE, TABLE = range(8)
ROW = "kind int, slice long, shard int, packed binary"


def _row_batch(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "slice", "shard", "packed"), columns, types)})


def _by_kind(table: pa.Table) -> dict[int, list[tuple[int, int, bytes]]]:
    out = {}
    for kind, *row in zip(*(table.column(n).to_pylist() for n in ("kind", "slice", "shard", "packed"))):
        out.setdefault(kind, []).append(tuple(row))
    return {k: sorted(v, key=lambda r: r[:2]) for k, v in out.items()}


def _encoded(shards: int):
    """Each slice's texts as places among its distinct words, which are sorted by shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", SLICE_BYTES):
            w = scan(part.column("text"), lower=True)
            hashes, which, place = np.unique(word_hashes(w), return_index=True, return_inverse=True)
            group = ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place, hashes, group = rank[place], hashes[order], group[order]
            kinds = kinds_of(w, which[order]).astype(np.uint16)
            seen = part.column("seen").to_numpy(zero_copy_only=False).astype(bool)
            ids = part.column("id")
            planes = np.ascontiguousarray(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
            here, cuts = np.unique(group, return_index=True)
            texts = _pack(planes, w.count, seen, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), hashes, kinds, here, np.append(cuts, len(group)))
            yield from _row_batch([(TEXTS, at, -1, texts)]).to_batches()
            at += 1

    return rows


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's distinct words by shard, with their training counts."""
    for batch in batches:
        for at, blob in zip(batch.column("slice").to_pylist(), batch.column("packed").to_pylist()):
            place, count, seen, _, _, hashes, kinds, here, cuts = _texts(blob)
            times = np.bincount(_seen(place, count, seen)[0], minlength=len(hashes)).astype(np.uint32)
            out = [(ASKED, at, int(s), _pack(hashes[a:b], times[a:b], kinds[a:b])) for s, a, b in zip(here, cuts[:-1], cuts[1:])]
            yield from _row_batch(out).to_batches()


def _texts(blob: bytes) -> tuple[np.ndarray, ...]:
    planes, *rest = _unpack(blob)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64), *rest


def merged_counts(table: pa.Table) -> pa.Table:
    """One shard's training words with their counts over all slices, and the places of each slice's words among them."""
    asked = [(at, shard, *_unpack(blob)) for at, shard, blob in _by_kind(table)[ASKED]]
    shard = asked[0][1]
    every, which, place = np.unique(np.concatenate([x[2] for x in asked]), return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([x[3] for x in asked]), len(every)).astype(np.int64)
    known = counts > 0
    to = np.where(known, np.cumsum(known) - 1, known.sum()).astype(np.uint32)
    hashes, kinds, counts = every[known], np.concatenate([x[4] for x in asked])[which][known], counts[known]
    ends = np.cumsum([len(x[2]) for x in asked])
    out = [(WORDS, -1, shard, _pack(hashes, counts, kinds))]
    for (at, _, own, *_rest), end in zip(asked, ends):
        to_own = to[place[end - len(own) : end]]
        out.append((PLACES, at, shard, _pack(to_own, np.append(counts, 0)[to_own])))
    top = np.sort(np.argsort(-counts, kind="stable")[:FREQUENT])
    none = [None] * (len(out) - 1)
    more = {
        "distinct": pa.array([len(hashes), *none], pa.int64()),
        "tokens": pa.array([int(counts.sum()), *none], pa.int64()),
        "top": pa.array([hashes[top].view(np.int64).tolist(), *none], pa.list_(pa.int64())),
        "top_counts": pa.array([counts[top].tolist(), *none], pa.list_(pa.int64())),
    }
    out = _row_batch(out)
    for name, column in more.items():
        out = out.append_column(name, column)
    return out


MERGED = f"{ROW}, distinct long, tokens long, top array<long>, top_counts array<long>"


def _columns(blob: bytes, kinds: tuple, at: int = 0) -> list[np.ndarray]:
    (n,) = np.frombuffer(blob, np.int64, 1, at)
    at, out = at + 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _seen(place: np.ndarray, count: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place[np.repeat(seen, count)], count[seen]


def _bigram_counts(frequent: np.ndarray):
    """One row per block of types of each task: how often each type follows each other one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TYPES * TYPES, np.int32)
        for batch in batches:
            for blob in batch.column("packed").to_pylist():
                place, count, seen, _, _, hashes, kinds, _, _ = _texts(blob)
                place, count = _seen(place, count, seen)
                before, after = _sequence(types_of(hashes, kinds, frequent)[place], count, TYPES - 1)
                code, times = np.unique(before * TYPES + after, return_counts=True) if len(count) else (np.zeros(0, np.int64),) * 2
                total[code] += times.astype(np.int32)
        for at in range(0, TYPES * TYPES, BLOCK):
            own = total[at : at + BLOCK]
            used = np.flatnonzero(own)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at // BLOCK], pa.int32()), pa.array([np.int64(len(used)).tobytes() + used.astype(np.uint32).tobytes() + own[used].tobytes()], pa.binary())],
                    ["block", "packed"],
                )

    return rows


BLOCK = 1 << 18


def merged_bigrams(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for blob in table.column("packed").to_pylist():
        used, count = _columns(blob, (np.uint32, np.int32))
        total[used] += count
    used = np.flatnonzero(total)
    packed = np.int64(len(used)).tobytes() + used.astype(np.uint32).tobytes() + total[used].tobytes()
    return pa.table({"block": table.column("block")[:1], "packed": pa.array([packed], pa.binary())})


# --- exchange clustering ----------------------------------------------------------------------


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each type (the last type keeps a class of its own) by the exchange algorithm.

    Types start by falling frequency, dealt to the classes in turn; in each sweep every type goes to
    the class in which the bigram likelihood of classes is highest.
    """
    n = len(bigrams)
    bigrams = bigrams.astype(np.float64, copy=False)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.full(n, classes, np.int64)
    of[order] = np.arange(n - 1) % classes
    k = classes + 1
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # followers and predecessors of each type by class
    table = member.T @ right
    plogp = lambda x: x * np.log(np.maximum(x, 1e-300))
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    outs, ins = bigrams.sum(axis=1), bigrams.sum(axis=0)
    live = [i for i in order if weight[i] > 0]
    base, last = plogp(table), classes  # logs of the table but for the class joined last
    for _ in range(sweeps):
        moved = 0
        for i in live:
            c, r, l, own = of[i], right[i], left[i], bigrams[i, i]
            # Take the type out of its class: r and l then count its neighbours among the others.
            r, l = r.copy(), l.copy()
            r[c] -= own
            l[c] -= own
            table[c] -= r
            table[:, c] -= l
            table[c, c] -= own
            rows[c] -= outs[i]
            columns[c] -= ins[i]
            for e in {c, last}:
                base[e], base[:, e] = plogp(table[e]), plogp(table[:, e])
            # Joining class d changes its row by r, its column by l, and the corner by r[d], l[d] and own.
            gain = (plogp(table + r[None, :]) - base).sum(axis=1) + (plogp(table + l[:, None]) - base).sum(axis=0)
            d = np.arange(k)
            corner = table[d, d]
            gain += plogp(corner + r + l + own) - plogp(corner + r) - plogp(corner + l) + plogp(corner)
            gain -= plogp(rows + outs[i]) - plogp(rows) + plogp(columns + ins[i]) - plogp(columns)
            gain[classes] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            table[best] += r
            table[:, best] += l
            table[best, best] += own
            rows[best] += outs[i]
            columns[best] += ins[i]
            last = best
            if best != c:
                moved += 1
                of[i] = best
                right[:, c] -= bigrams[:, i]
                right[:, best] += bigrams[:, i]
                left[:, c] -= bigrams[i]
                left[:, best] += bigrams[i]
        if moved * 200 < len(live):
            break
    return of


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of class after class, interpolated with the classes' shares."""
    k = len(table)
    own = (table.sum(axis=0) + ADD) / (table.sum() + ADD * k)
    return np.log10((table + BACKOFF * own) / (table.sum(axis=1, keepdims=True) + BACKOFF))


# --- sweeps over the shards -------------------------------------------------------------------


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the training bigrams of classes, but for the words' own part, which is the same for all classes."""
    return float(_plogp(table).sum() - _plogp(table.sum(axis=1)).sum() - _plogp(table.sum(axis=0)).sum())


def moves(of: np.ndarray, counts: np.ndarray, word: np.ndarray, side: np.ndarray, beside: np.ndarray, times: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word, from how often (times) it stands before (side 0) or after (side 1) each class.

    The entries are sorted by word, and each word has some. The last class is the end token's.
    """
    k = len(table) - 1
    lines = np.stack([table.T, table])  # [side, class beside, own class]
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    low = np.stack([_plogp(lines + n) - _plogp(lines) for n in range(1, FEW + 1)])  # gains of small counts
    out = of.copy()
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    bounds, at = np.append(first, len(word)), 0
    while at < len(first):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + ENTRIES, side="right")) - 1)
        a, b = bounds[at], bounds[stop]
        w, s, c, n = word[a:b], side[a:b], beside[a:b], times[a:b].astype(float)
        own, local = word[first[at:stop]], first[at:stop] - a
        line = lines[s, c, of[w]]
        stay = np.add.reduceat(_plogp(line) - _plogp(line - n), local)
        each = low[np.minimum(times[a:b], FEW) - 1, s, c]
        many = np.flatnonzero(times[a:b] > FEW)
        line = lines[s[many], c[many]]
        each[many] = _plogp(line + n[many, None]) - _plogp(line)
        gain = np.add.reduceat(each, local, axis=0)
        m, to = np.unique(counts[own], return_inverse=True)
        for total in (rows, columns):
            gain -= (_plogp(total + m[:, None]) - _plogp(total))[to]
            stay -= _plogp(total[of[own]]) - _plogp(total[of[own]] - counts[own])
        gain[:, k] = -np.inf
        gain[np.arange(len(own)), of[own]] = stay
        best = gain.argmax(axis=1)
        out[own] = np.where(gain[np.arange(len(own)), best] > stay + 1e-9, best, of[own])
        at = stop
    return out


def _sent(of: np.ndarray, found: dict, moved: int) -> pa.Table:
    """A shard's classes and what it sends to the slices."""
    shard, longer = found[WORDS][0][1], np.append(of, MISSING).astype(np.uint16)
    out = [(CLASSED, moved, shard, _pack(of.astype(np.uint16)))]
    out += [(SENT, at, shard, _pack(longer[_unpack(blob)[0]])) for at, _, blob in found[PLACES]]
    return _row_batch(out)


def _started(sent):
    def rows(table: pa.Table) -> pa.Table:
        frequent, classes = shared(sent)
        found = _by_kind(table)
        hashes, _, kinds = _unpack(found[WORDS][0][2])
        return _sent(classes[types_of(hashes, kinds, frequent)], found, 0)

    return rows


def turns(hashes: np.ndarray, sweep: int) -> np.ndarray:
    """Which words may move in a sweep: half of them, the other half in the next one."""
    return (mix(hashes) >> np.uint64(sweep // 2)) & np.uint64(1) == np.uint64(sweep % 2)


def _moved(sent):
    def rows(table: pa.Table) -> pa.Table:
        bigrams = shared(sent)
        found, k = _by_kind(table), len(bigrams)
        counts = _unpack(found[WORDS][0][2])[1]
        of = _unpack(found[CLASSED][0][2])[0].astype(np.int64)
        places = {at: _unpack(blob)[0].astype(np.int64) for at, _, blob in found[PLACES]}
        codes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, _, blob in found.get(BESIDE, []):
            step, n = _unpack(blob)
            code = np.cumsum(step, dtype=np.int64)  # (place, side, class)
            codes.append(places[at][code // (2 * k)] * (2 * k) + code % (2 * k))
            times.append(n.astype(np.int64))
        code, times = np.concatenate(codes), np.concatenate(times)
        order = np.argsort(code, kind="stable")
        code, times = code[order], times[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        code, times = code[begin], np.add.reduceat(times, begin) if len(begin) else times
        new = moves(of, counts, code // (2 * k), code // k % 2, code % k, times, bigrams)
        return _sent(new, found, int((new != of).sum()))

    return rows


def _classes(found: dict, count: int, kinds: np.ndarray, by_kind: np.ndarray, end: int) -> np.ndarray:
    """Class of each distinct word of a slice; unseen ones have that of their kind. The end token is the last."""
    of = np.concatenate([np.zeros(0, np.int64), *(_unpack(blob)[0].astype(np.int64) for _, _, blob in found.get(SENT, []))])
    assert len(of) == count, "a slice misses classes of its words"
    return np.append(np.where(of == MISSING, by_kind[kinds], of), end)


def _steps(code: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, as small as they get."""
    steps = np.diff(code, prepend=0)
    return steps.astype(np.uint32) if steps.max() < 1 << 32 else steps


def _beside(sent, sweep: int | None):
    """How often the words of a slice that move in a sweep stand beside each class, by shard, and its table of classes.

    Without a sweep to come only the table is asked for.
    """

    def rows(table: pa.Table) -> pa.Table:
        by_kind, k = shared(sent)
        found = _by_kind(table)
        ((at, _, blob),) = found[TEXTS]
        place, count, seen, _, _, hashes, kinds, here, cuts = _texts(blob)
        place, count = _seen(place, count, seen)
        of = _classes(found, len(hashes), kinds, by_kind, k - 1)
        if not len(count):
            return _row_batch([])
        before, after = _sequence(place, count, len(hashes))
        pair, pairs = np.unique(of[before] * k + of[after], return_counts=True)
        own = _row_batch([(TABLE, at, -1, _pack(pair, pairs))])
        if sweep is None:
            return own
        turn = np.append(turns(hashes, sweep), False)  # the end token stays
        first, second = turn[before], turn[after]
        code = np.concatenate([(before * (2 * k) + of[after])[first], (after * (2 * k) + k + of[before])[second]])
        code, times = np.unique(code, return_counts=True)
        bounds = np.searchsorted(code, cuts * (2 * k))
        out = [
            (BESIDE, at, int(s), _pack(_steps(code[a:b] - cut * (2 * k)), times[a:b].astype(np.uint32)))
            for s, cut, a, b in zip(here, cuts, bounds[:-1], bounds[1:]) if b > a
        ]
        return pa.concat_tables([own, _row_batch(out)])

    return rows


def _table_rows(k: int):
    """The classes' counts of each task, a row for each class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for blob in batch.column("packed").to_pylist():
                pair, times = _unpack(blob)
                total[pair] += times
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array([x.tobytes() for x in total.reshape(k, k)], pa.binary())], ["class", "packed"])

    return rows


def merged_rows(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("packed").to_pylist())
    return pa.table({"class": table.column("class")[:1], "packed": pa.array([total.tobytes()], pa.binary())})


def class_table(beside: DataFrame, k: int) -> np.ndarray:
    """Class after class over all slices."""
    rows = beside.filter(F.col("kind") == TABLE).select("packed").mapInArrow(_table_rows(k), "class long, packed binary")
    out = np.zeros((k, k))
    for c, packed in rows.groupBy("class").applyInArrow(merged_rows, "class long, packed binary").collect():
        out[c] = np.frombuffer(bytes(packed), np.int64)
    return out


# --- training ---------------------------------------------------------------------------------


def train(encoded: DataFrame, ends: int, sweeps: int = SHARD_SWEEPS) -> tuple[Model, DataFrame, DataFrame]:
    """(model, words and places, their classes), from encoded slices with ``ends`` training texts."""
    spark = encoded.sparkSession
    words = staged(encoded.mapInArrow(_asked, ROW).groupBy("shard").applyInArrow(merged_counts, MERGED), "words")
    drop_shuffles(spark)
    tokens, distinct = words.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (tokens or 0) + ends, (distinct or 0) + (ends > 0)
    top = words.filter("top IS NOT NULL").select(F.explode(F.arrays_zip("top", "top_counts")).alias("x")).select("x.top", "x.top_counts")
    top = top.orderBy(F.col("top_counts").desc(), "top").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    pairs = encoded.select("packed").mapInArrow(_bigram_counts(frequent), "block int, packed binary").groupBy("block").applyInArrow(merged_bigrams, "block int, packed binary")
    bigrams = np.zeros(TYPES * TYPES)
    for block, packed in pairs.collect():  # TYPES squared numbers at most
        used, count = _columns(bytes(packed), (np.uint32, np.int64))
        bigrams[block * BLOCK + used.astype(np.int64)] = count
    del top, pairs
    classes = classes_for(distinct)
    start = exchange(bigrams.reshape(TYPES, TYPES), classes)
    del bigrams
    k, by_kind = classes + 1, start[FREQUENT : FREQUENT + KINDS]
    words = words.select("kind", "slice", "shard", "packed")
    kinds = share(spark, (by_kind, k))
    of = staged(words.groupBy("shard").applyInArrow(_started(share(spark, (frequent, start))), ROW), "classes")
    drop_shuffles(spark)
    before = None
    for sweep in range(sweeps + 1):
        sent = of.filter(F.col("kind") == SENT)
        beside = staged(encoded.unionByName(sent).groupBy("slice").applyInArrow(_beside(kinds, sweep if sweep < sweeps else None), ROW), "beside")
        del sent
        table = class_table(beside, k)
        drop_shuffles(spark)
        if before is not None:
            worse = likelihood(table) < likelihood(before[1])
            unstaged(of if worse else before[0])
            if worse:
                of, table = before
                unstaged(beside)
                break
        if sweep == sweeps or not tokens:
            unstaged(beside)
            break
        before = of, table
        both = words.unionByName(of.filter(F.col("kind") == CLASSED)).unionByName(beside.filter(F.col("kind") == BESIDE))
        of = staged(both.groupBy("shard").applyInArrow(_moved(share(spark, table)), ROW), "classes")
        unstaged(beside)
        del beside, both
        drop_shuffles(spark)
    model = Model(by_kind, transitions(table), np.zeros(k), int(tokens), int(distinct), int(ends))
    model.inside = np.log10(class_sizes(words, of, classes))
    return model, words, of


def class_sizes(words: DataFrame, of: DataFrame, classes: int) -> np.ndarray:
    """Per class: its words' counts plus ADD for each word and one more."""

    def rows(table: pa.Table) -> pa.Table:
        found = _by_kind(table)
        counts, own = _unpack(found[WORDS][0][2])[1], _unpack(found[CLASSED][0][2])[0]
        return pa.table({"class": np.arange(classes), "size": np.bincount(own, counts + ADD, minlength=classes).astype(float)})

    both = words.filter(F.col("kind") == WORDS).unionByName(of.filter(F.col("kind") == CLASSED))
    sizes = np.full(classes + 1, ADD)
    for c, size in both.groupBy("shard").applyInArrow(rows, "class long, size double").groupBy("class").agg(F.sum("size")).collect():
        sizes[c] += size
    sizes[classes] = 1.0  # the end token is alone in its class
    return sizes


# --- scoring ----------------------------------------------------------------------------------

SCORED = "id long, held_out boolean, n_tokens long, known long, base double, score double"


def _scored(sent):
    def rows(table: pa.Table) -> pa.Table:
        model = shared(sent)
        found = _by_kind(table)
        ((_, _, blob),) = found[TEXTS]
        place, count, seen, ids, null, hashes, kinds, _, _ = _texts(blob)
        k = len(model.step)
        of = _classes(found, len(hashes), kinds, model.kinds, k - 1)
        times = np.concatenate([np.zeros(0, np.int64), *(_unpack(blob)[1] for _, _, blob in found.get(PLACES, []))])
        z = np.log10(model.total + ADD * (model.distinct + 1))
        before, after = _sequence(place, count, len(hashes))
        first = np.concatenate([[0], np.cumsum(count)])
        log = np.log10(times + ADD)
        base = np.log10(model.ends + ADD) - z + per_text((log - z)[place], first)
        walk = per_text(model.step[of[before], of[after]], np.concatenate([[0], np.cumsum(count + 1)]))
        score = walk + per_text((log - model.inside[of[:-1]])[place], first)
        known = per_text(times[place] > 0, first) + (model.ends > 0)
        return pa.table({
            "id": pa.array(ids, mask=null), "held_out": ~seen, "n_tokens": count + 1, "known": known.astype(np.int64), "base": base, "score": score,
        })

    return rows


def score_documents(docs: DataFrame, known: Column, id: str = "doc_id", text: str = "text", sweeps: int = SHARD_SWEEPS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of probabilities)."""
    kind = docs.schema[id].dataType
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(known, F.lit(False)).alias("seen"))
    encoded = staged(rows.mapInArrow(_encoded(shards_for(rows)), ROW), "encoded")
    model, words, of = train(encoded, rows.filter("seen").count(), sweeps)
    parts = encoded.unionByName(of.filter(F.col("kind") == SENT)).unionByName(words.filter(F.col("kind") == PLACES))
    out = parts.groupBy("slice").applyInArrow(_scored(share(docs.sparkSession, model)), SCORED)
    return out.select(
        F.col("id").cast(kind).alias(id), "held_out", "n_tokens", F.col("known").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
