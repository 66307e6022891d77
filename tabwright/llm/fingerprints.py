"""SimHash fingerprints of whole texts, and all pairs of them within a Hamming radius.

Every word starts a term of up to three words; a term weighs as often as it occurs. Each term's
128-bit hash votes on every bit, and the fingerprint has the bits with a majority. Likeness is
the share of equal bits.

To find near fingerprints they are cut into one block more than bits may differ, so two near
ones agree in a block. Each permuted table leads with another block and is joined on it; a pair
is reported by the first table that has it, after its exact distance is checked.

Nulls: a null text is an empty one, whose fingerprint is all zeros; a null id sorts last. Equal
texts have equal fingerprints, repeated rows get a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.llm.textscan import mix, per_text, scan, slices, word_hashes
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

BITS = 128
TERM = 3
#: Rows that one window task orders by id, about, and the number of such ranges that a plan may name.
RANGE_ROWS = 4096
RANGES = 100_000

#: A byte's bits, one in each byte of a 64-bit word, so that up to 255 of them add up in place.
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def simhash(texts: pa.Array) -> np.ndarray:
    """Two signed 64-bit halves for each text."""
    w = scan(texts, lower=True)
    hashes, count = word_hashes(w), w.count
    terms = hashes * np.uint64(0x9E3779B97F4A7C15)
    left = np.repeat(w.first[1:], count) - np.arange(len(hashes))  # words up to the text's end
    for j in range(1, TERM):
        terms *= np.uint64(0xD1342543DE82EF95)
        terms[: len(terms) - j] += np.where(left[: len(terms) - j] > j, hashes[j:], np.uint64(0))
    # Up to 255 terms of one text are added at a time, eight votes to a 64-bit word.
    parts = -(-count // 255)
    part_of = np.concatenate([[0], np.cumsum(parts)])
    begin = np.repeat(w.first[:-1], parts) + 255 * (np.arange(part_of[-1]) - np.repeat(part_of[:-1], parts))
    votes = np.zeros((len(count), BITS), np.int64)
    for half in range(BITS // 64):
        bytes_of = mix(terms ^ np.uint64(half + 1)).view(np.uint8).reshape(-1, 8) if len(terms) else None
        for b in range(8):
            if bytes_of is None:
                break
            ones = np.add.reduceat(_LANES[bytes_of[:, b]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
            column = 64 * half + 8 * b
            votes[:, column : column + 8] = per_text(ones, part_of)
    bits = 2 * votes > count[:, None]
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).reshape(len(count), BITS // 64)


def _halves(texts: pa.Array) -> pa.StructArray:
    high, low = simhash(texts).T
    return pa.StructArray.from_arrays([pa.array(high.copy()), pa.array(low.copy())], ["high", "low"])


PRINT = "struct<high: bigint, low: bigint>"


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the fingerprint of a text column as a struct of two longs."""
    names = df.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, _halves(part.column(text))], [*names, name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(add, f"{', '.join(fields)}, `{name}` {PRINT}")


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprint columns differ."""
    return F.bit_count(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high"))) + F.bit_count(
        F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low"))
    )


def likeness(a: str, b: str) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def as_text(name: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{name}.{half}")), 16, "0") for half in ("high", "low")]))


def near_pairs(prints: DataFrame, radius: int, name: str = "fingerprint") -> DataFrame:
    """(a, b, distance) for all distinct fingerprints a < b (as text) that differ in at most ``radius`` bits.

    Copies of a fingerprint are one: join the pairs back to the rows by fingerprint.
    """
    digits = BITS // 4
    if not 0 <= radius < digits:
        raise ValueError(f"radius must be from 0 to {digits - 1}")
    cuts = [digits * i // (radius + 1) for i in range(radius + 2)]
    distinct = staged(prints.select(F.col(name).alias("fp")).filter("fp IS NOT NULL").distinct(), "fingerprints")
    text = as_text("fp")
    blocks = F.array(*[F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    tables = distinct.select("fp", text.alias("text"), blocks.alias("blocks"))
    tables = tables.select("fp", "text", "blocks", F.posexplode("blocks").alias("table", "lead"))
    a, b = tables.alias("a"), tables.alias("b")
    earlier = F.expr("exists(sequence(0, a.table), i -> i < a.table AND a.blocks[i] = b.blocks[i])")
    pairs = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.lead") == F.col("b.lead")) & (F.col("a.text") < F.col("b.text")))
    pairs = pairs.withColumn("distance", distance("a.fp", "b.fp")).filter((F.col("distance") <= radius) & ~earlier)
    return pairs.select(F.col("a.text").alias("a"), F.col("b.text").alias("b"), "distance")


# --- each document beside the next one --------------------------------------------------------


def _range_of(id: str, bounds: list) -> Column:
    """How many of the sorted bounds an id reaches: first among every g-th bound, then among g of them."""
    if not bounds:
        return F.lit(0)
    g = max(1, int(len(bounds) ** 0.5))
    listed = F.array(*[F.lit(x) for x in bounds])
    rough = F.array(*[F.lit(x) for x in bounds[g - 1 :: g]])
    return F.coalesce(
        F.aggregate(
            F.slice(listed, F.size(F.filter(rough, lambda x: x <= F.col(id))) * g + 1, g),
            F.size(F.filter(rough, lambda x: x <= F.col(id))) * g,
            lambda n, x: n + F.when(x <= F.col(id), 1).otherwise(0),
        ),
        F.lit(0),
    )


def in_ranges(docs: DataFrame, id: str) -> DataFrame:
    """The rows with ``__range``, ids cut into ranges by approximate quantiles, highest last; and once more, with
    ``__extra`` 1, the first row (by descending id) of each range for the range that ends before it."""
    ids = docs.select(id)
    n = ids.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx(id, cuts, max(10_000, 10 * ranges))).first()[0] if cuts else None
    bounds = sorted(set(found or []))
    order = Window.partitionBy().orderBy(F.col("__own").desc())
    heads = ids.select(id, _range_of(id, bounds).alias("__own")).groupBy("__own").agg(F.max(id).alias("__head"))
    needed = F.coalesce(F.lag("__own").over(order), F.min("__own").over(Window.partitionBy()))
    heads = staged(heads.select("__head", "__own", needed.alias("__for")), "range-heads")  # at most RANGES rows of three numbers
    placed = docs.withColumn("__range", _range_of(id, bounds))
    same = (F.col("__range") == F.col("__own")) & F.col(id).eqNullSafe(F.col("__head"))
    extra = placed.join(F.broadcast(heads), same).select(*docs.columns, F.col("__for").alias("__range"), F.lit(1).alias("__extra"))
    return placed.withColumn("__extra", F.lit(0)).unionByName(extra)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their one shuffle, with their fingerprints."""
    for part in slices(batches, "text"):
        texts = part.column("text")
        packed = pa.array([zlib.compress(t.encode(), 1) for t in texts.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("__range"), part.column("__extra"), packed, _halves(texts)], PACKED)


PACKED = ["id", "__range", "__extra", "packed", "print"]


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _edit_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, EDIT_ROWS):
            part = batch.slice(at, EDIT_ROWS)
            both = [[zlib.decompress(b).decode() for b in part.column(c).to_pylist()] for c in ("packed", "next_packed")]
            made = [edited(t, n) for t, n in zip(*both)]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in made]
            columns = [part.column("id"), pa.array([len(t) for t in both[0]], pa.int64()), pa.array(sha), _halves(pa.array(made, pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, part.column("print"), part.column("next_print")], EDITED)


EDIT_ROWS = 512
EDITED = ["id", "n_chars", "edited_sha256", "edited_print", "print", "next_print"]


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, which ends in the beginning of the next text by descending id.

    After the last row comes the first. A window orders one range of ids; texts are shuffled once, compressed.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = in_ranges(docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "id")
    rows = rows.mapInArrow(_pack_texts, f"id {kind}, __range int, __extra int, packed binary, print {PRINT}")
    line = Window.partitionBy("__range").orderBy("__extra", F.col("id").desc_nulls_last(), F.xxhash64("packed"))
    rows = rows.withColumn("next", F.lead(F.struct("packed", "print")).over(line)).filter("__extra = 0")
    rows = rows.select("id", "packed", "print", F.col("next.packed").alias("next_packed"), F.col("next.print").alias("next_print"))
    rows = rows.mapInArrow(
        _edit_texts, f"id {kind}, n_chars long, edited_sha256 string, edited_print {PRINT}, print {PRINT}, next_print {PRINT}"
    )
    return rows.select(
        F.col("id").alias(id), "n_chars", "edited_sha256",
        as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"),
    )
