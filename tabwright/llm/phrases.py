"""Collocations by Toivonen's sampling: phrases of two or three words that occur together more than apart.

A hashed quarter of the documents proposes words and word pairs. One pass over all documents counts
what the proposal allows and its negative border: every word, every pair of proposed words
(proposed itself or not) and every triple whose two pairs are proposed. A word or pair of the
border that turns out frequent is a failure of the proposal; it is added, and a further pass counts
only the pairs and triples that the addition makes possible, until no pass finds a failure.
These passes count by a hash of the phrase, which can only raise a count, so nothing frequent is missed;
a last pass counts by the phrases themselves, those whose hash was frequent, and drops the others.
So the counts of all frequent phrases are whole and exact, whatever the sample missed.

What is proposed or frequent travels as a bitmap of bounded size (``MOST_BITS``). Phrases that share
a bit only make the border larger. Each pass counts within slices of text (numpy), then by Spark's grouping.

Text: A to Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends; the words of a piece are split
by blanks and tabs. Phrases do not cross pieces; overlapping occurrences all count. Nulls: a null text is empty; a
null language is ``und``; ids do not matter. Repeated rows count as often as they occur. Ties in rank follow
the phrase's bytes. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.ordering import numbered
from tabwright.llm.textscan import mix, ragged, range_hashes, share, shared, slices, text_buffer
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

LEAST = 10
TOP = 2000
#: Percent of a phrase's occurrences inside a longer one that make the longer one stand for it.
COVER = 50
#: One document of so many proposes phrases, those found twice at least.
SAMPLE = 4
PROPOSED = 2
#: Bits of a bitmap: 32 MB at most, eight for each phrase below that.
LEAST_BITS, MOST_BITS = 16, 28
#: Bits of the hash that the first passes count by.
KEY_BITS = 44
SLICE_BYTES = 2 << 20

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- words of pieces --------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, text of each word, piece of each word); pieces are numbered upwards through all texts."""
    raw, bounds = text_buffer(texts)
    solid = _SOLID[raw]
    cuts = bounds[:-1][(bounds[:-1] < len(raw)) & (bounds[:-1] > 0)]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[cuts] |= solid[cuts]
    ends[:-1] &= ~solid[1:]
    ends[cuts - 1] |= solid[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(bounds, start, side="right") - 1
    piece = np.cumsum(_BREAK[raw])[start] + text if len(start) else np.zeros(0, np.int64)
    length = end - start
    letters = _LOWER[raw[ragged(start, length)]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    return words, text, piece


def hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, bounds = text_buffer(texts)
    return range_hashes(np.concatenate([data, np.zeros(8, np.uint8)]), bounds[:-1], bounds[1:])


def _spot(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The hash of a word in its language, of both hashes."""
    return mix(word ^ mix(lang))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + b)


def _key(k: int, spot: np.ndarray) -> np.ndarray:
    """What the first passes count by: the number of words, then KEY_BITS bits of the hash."""
    return (spot >> _U(64 - KEY_BITS)).astype(np.int64) | (k << KEY_BITS)


def _has(marks: np.ndarray, spot: np.ndarray) -> np.ndarray:
    at = (spot >> _U(61 - (len(marks).bit_length() - 1))).astype(np.int64)  # len(marks) bytes
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


# --- counting ---------------------------------------------------------------------------------


class Slice:
    """The words of a slice of texts: each place's word of its language, and their hashes."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        words, text, self.piece = words_of(texts)
        named = langs.fill_null("und").dictionary_encode()
        self.lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        self.langs = named.dictionary.cast(pa.string())
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        size = max(len(self.words), 1)
        own, self.at, self.n = np.unique(self.lang * size + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        self.own_lang, self.own_word = own // size, own % size
        self.spot = _spot(hashes(self.words)[self.own_word], hashes(self.langs)[self.own_lang]) if len(own) else np.zeros(0, np.uint64)
        self.size = max(len(own), 1)
        #: Places whose word is followed by another in the same piece, and the hash of the two.
        self.near = np.flatnonzero(self.piece[1:] == self.piece[:-1])
        self.joined = _pair(self.spot[self.at[self.near]], self.spot[self.at[self.near + 1]])

    def pairs(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, count) of the distinct pairs at the ``live`` ones of ``near``."""
        at = self.near[live]
        key, n = np.unique(self.at[at] * self.size + self.at[at + 1], return_counts=True)
        return key // self.size, key % self.size, n

    def following(self, of_pair: np.ndarray) -> np.ndarray:
        """A value of each pair of ``near`` at its place, 0 or false where no pair begins."""
        out = np.zeros(len(self.piece), of_pair.dtype)
        out[self.near] = of_pair
        return out

    def triples(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, third, count) of the distinct triples at places ``at``."""
        pairs, which = np.unique(self.at[at] * self.size + self.at[at + 1], return_inverse=True)
        key, n = np.unique(which * self.size + self.at[at + 2], return_counts=True)
        pair = pairs[key // self.size]
        return pair // self.size, pair % self.size, key % self.size, n

    def triple_places(self) -> np.ndarray:
        return np.flatnonzero(self.piece[2:] == self.piece[:-2])


def hashed_counts(s: Slice, new: np.ndarray | None, old: np.ndarray | None, words_too: bool) -> pa.RecordBatch:
    """(key, n): counts by length and hash of all words (``words_too``), and of the pairs and triples that ``new`` allows
    and ``old`` did not. Without ``new``: of words and pairs, all of them."""
    parts = [(_key(1, s.spot), s.n)] if words_too else []
    live = np.ones(len(s.near), bool)
    if new is not None:
        may, did = _has(new, s.spot)[s.at], _has(old, s.spot)[s.at]
        live = may[s.near] & may[s.near + 1] & ~(did[s.near] & did[s.near + 1])
    first, second, n = s.pairs(live)
    parts.append((_key(2, _pair(s.spot[first], s.spot[second])), n))
    if new is not None:
        may, did = s.following(_has(new, s.joined)), s.following(_has(old, s.joined))
        first, second, third, n = s.triples(np.flatnonzero(may[:-1] & may[1:] & ~(did[:-1] & did[1:])))
        parts.append((_key(3, _pair(_pair(s.spot[first], s.spot[second]), s.spot[third])), n))
    key, n = np.concatenate([key for key, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(key)  # neighbours compress well in the shuffle
    return pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(n[order].astype(np.int64))], ["key", "n"])


def named_counts(s: Slice, marks: np.ndarray) -> pa.RecordBatch:
    """(lang, k, phrase, n): counts of the words, pairs and triples in ``marks``; with k = 0 the number of words."""
    kept = np.flatnonzero(_has(marks, s.spot))
    live = _has(marks, s.joined)
    first, second, n2 = s.pairs(live)
    at = s.triple_places()
    at = at[_has(marks, _pair(s.following(s.joined)[at], s.spot[s.at[at + 2]]))] if len(at) else at
    a, b, c, n3 = s.triples(at)
    text = lambda i: s.words.take(pa.array(s.own_word[i]))
    blank = pa.scalar(" ", s.words.type)
    total = np.bincount(s.lang, minlength=len(s.langs))
    parts = [
        (0, np.arange(len(total)), pa.array([""] * len(total), s.words.type), total),
        (1, s.own_lang[kept], text(kept), s.n[kept]),
        (2, s.own_lang[first], pc.binary_join_element_wise(text(first), text(second), blank), n2),
        (3, s.own_lang[a], pc.binary_join_element_wise(text(a), text(b), text(c), blank), n3),
    ]
    return pa.RecordBatch.from_arrays(
        [
            s.langs.take(pa.array(np.concatenate([p[1] for p in parts]))),
            pa.array(np.concatenate([np.full(len(p[3]), p[0], np.int8) for p in parts])),
            pa.chunked_array([p[2] for p in parts]).combine_chunks().cast(pa.string()),
            pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64)),
        ],
        ["lang", "k", "phrase", "n"],
    )


def _each_slice(docs: DataFrame, count, marks: tuple, shape: str) -> DataFrame:
    """``count`` of every slice of the documents, with the bitmaps ``marks``."""
    sent = share(docs.sparkSession, marks)  # bitmaps of bounded size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(sent)
        for part in slices(batches, "text", SLICE_BYTES):
            yield count(Slice(part.column("text"), part.column("lang")), *own)

    return docs.mapInArrow(counted, shape)


def _frequent_keys(docs: DataFrame, least: int, new: np.ndarray | None, old: np.ndarray | None, words_too: bool) -> DataFrame:
    """(k, key) of the hashes counted ``least`` times or more, written.

    Few of a task's hashes come from more than one of its slices, so they are summed behind the shuffle only.
    """

    def count(s: Slice, new, old) -> pa.RecordBatch:
        return hashed_counts(s, new, old, words_too)

    counts = _each_slice(docs, count, (new, old), "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("f"))
    found = counts.filter(f"f >= {least}")
    return staged(found.select(F.shiftright("key", KEY_BITS).alias("k"), F.col("key").bitwiseAND((1 << KEY_BITS) - 1).alias("key")), "phrase-keys")


def bits_for(phrases: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * phrases).bit_length()))


def _marks(keys: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of hashes, set by Spark's bitmap aggregate: 2 ** bits / 32768 rows of 4 KB."""
    at = keys.select((F.shiftright("key", KEY_BITS - bits) + 1).alias("at"))
    buckets = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, part in buckets.collect():
        begin = (bucket - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(part, np.uint8)[: len(out) - begin]
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, bits: int | None = None) -> tuple[DataFrame, int]:
    """(lang, k, phrase, f) of all words, pairs and triples found ``least`` times or more, and of k = 0, the
    number of words; and how many counting passes over all documents it took. ``docs`` has text, lang and __id."""
    chosen = docs.filter(F.pmod(F.xxhash64("__id", "text"), F.lit(sample)) == 0).select("text", "lang")
    docs = docs.select("text", "lang")
    proposed = _frequent_keys(chosen, min(PROPOSED, least), None, None, True)
    bits = bits or bits_for(2 * proposed.count())
    new = _marks(proposed, bits)
    old, frequent, passes = np.zeros_like(new), np.zeros_like(new), 0
    while True:
        found = _frequent_keys(docs, least, new, old, not passes)
        passes += 1
        frequent |= _marks(found, bits)
        grown = new | _marks(found.filter("k < 3"), bits)
        if np.array_equal(grown, new):
            break
        new, old = grown, new
    named = _each_slice(docs, named_counts, (frequent,), "lang string, k byte, phrase string, n long")
    counts = named.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter(f"f >= {least} OR k = 0")
    return staged(counts, "phrase-counts"), passes


# --- the operator -----------------------------------------------------------------------------


def collocations(
    docs: DataFrame, top: int = TOP, least: int = LEAST, cover: int = COVER, sample: int = SAMPLE,
    bits: int | None = None, text: str = "text", lang: str = "lang", id: str = "doc_id",
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score, whole and exact."""
    plain = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"), docs[id].alias("__id"))
    counts, _ = frequent_phrases(plain, least, sample, bits)
    return best_phrases(counts, top, cover)


def best_phrases(counts: DataFrame, top: int = TOP, cover: int = COVER) -> DataFrame:
    """Score, clear and rank the phrases of :func:`frequent_phrases`."""
    own = counts.filter("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = own.select("lang", "k", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select(
        "lang", "k", "phrase", "a", "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    heads = counts.select(F.col("lang").alias("x_lang"), F.col("phrase").alias("x"), F.col("k").alias("x_k"), F.col("f").alias("l")).filter("x_k > 0")
    rests = heads.select(F.col("x_lang").alias("y_lang"), F.col("x").alias("y"), F.col("x_k").alias("y_k"), F.col("l").alias("r"))
    cuts = cuts.join(heads, (F.col("lang") == F.col("x_lang")) & (F.col("head") == F.col("x")))
    cuts = cuts.join(rests, (F.col("lang") == F.col("y_lang")) & (F.col("rest") == F.col("y")))
    wide = lambda c: f"CAST({c} AS DECIMAL(18, 0))"  # noqa: E731  products of up to 38 digits
    score = F.expr(f"({wide('a')} * {wide('a')} * 1000000BD) div ({wide('l')} * {wide('r')})")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    triples = own.filter("k = 3").select("lang", "f", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("part"))
    longer = triples.groupBy(F.col("lang").alias("z_lang"), F.col("part").alias("z")).agg(F.max("f").alias("longer"))
    best = best.join(longer, (F.col("lang") == F.col("z_lang")) & (F.col("phrase") == F.col("z")), "left")
    left = best.filter(f"longer IS NULL OR 100 * longer < {cover} * a")
    left = staged(left.select("lang", "phrase", "a", "least.l", "least.r", "least.score"), "phrase-scores")
    ranked = numbered(left, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "rank", "all")
    totals = counts.filter("k = 0").select(F.col("lang").alias("t_lang"), F.col("f").alias("n"))
    ranked = ranked.filter(f"rank < {top}").join(totals, F.col("lang") == F.col("t_lang"))
    return ranked.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
