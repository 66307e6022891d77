"""Quality rules: counts over whole texts, and a logistic regression on hashed n-grams.

The regression sees the shares of hashed words, word pairs and character trigrams (over UTF-8
bytes) in a text. It is trained in numpy on a bounded sample of labelled documents, its
probability is calibrated on a fifth of them that it did not see, and documents are scored in
Arrow batches. A text is kept when it passes the base rules and its probability of good quality
reaches a fixed threshold.

Nulls: a null text has no words, so it fails the base rules; rows without an id are scored
like any other. Repeated rows are scored one by one. Without labelled rows of both kinds the
model says 0.5 and only the base rules decide. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabwright.llm.labelled import labelled_sample
from tabwright.llm.textscan import (
    SPACE, crc_mod, mix, per_text, ragged, range_hashes, scan, share, shared, shingle_hashes, slices, word_hashes,
)
from tabwright.session import ship_with_tasks

ship_with_tasks(__name__)

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
GOOD = 0.5
#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 1500
BITS = 16
ROUNDS = 120

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


@dataclass
class Model:
    weights: np.ndarray  # words, word pairs, trigrams: 2**BITS each
    bias: float
    slope: float  # calibration: p = sigmoid(slope * logit + shift)
    shift: float


# --- counts -----------------------------------------------------------------------------------


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    w = scan(texts)
    raw = w.data[:-8]
    rows = len(texts)

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[w.bounds[1:]] - total[w.bounds[:-1]]

    counted = {
        "n_words": w.count.astype(np.int64),
        "word_chars": bytes_where(~SPACE[raw] & ((raw & 0xC0) != 0x80)),
        "n_symbols": bytes_where(_SYMBOL[raw]),
    }
    breaks = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([w.bounds[:-1][w.bounds[:-1] < w.bounds[1:]], breaks + 1]))
    begin = begin[begin < len(raw)]
    stop = np.minimum(np.searchsorted(breaks, begin), len(breaks))
    text = np.searchsorted(w.bounds, begin, side="right") - 1
    end = np.minimum(np.append(breaks, len(raw))[stop], w.bounds[text + 1])
    worded = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    begin, end, text = begin[worded], end[worded], text[worded]
    key = mix(range_hashes(w.data, begin, end) ^ mix(text.astype(np.uint64)))
    _, firsts = np.unique(key, return_index=True)
    counted["n_dup_lines"] = np.bincount(text, minlength=rows) - np.bincount(text[firsts], minlength=rows)

    windows, first = shingle_hashes(word_hashes(w), w.first, 3)
    key = mix(windows ^ mix(np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found_twice = np.zeros(len(key), bool)
    found_twice[order[1:][same]] = True
    found_twice[order[:-1][same]] = True
    at = ragged(w.first[:-1], np.diff(first))[found_twice]
    covered = np.zeros(len(w.start), bool)
    for j in range(3):
        covered[at + j] = True
    counted["n_repeat_words"] = per_text(covered, w.first)
    return counted


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


# --- features ---------------------------------------------------------------------------------


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(table slots, first slot of each text) of words, word pairs and character trigrams."""
    w = scan(texts)
    hashes = word_hashes(w)
    pairs, pair_first = shingle_hashes(hashes, w.first, 2)
    raw = w.data.astype(np.uint32)
    grams = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
    inside = np.maximum(np.diff(w.bounds) - 2, 0)
    grams = grams[ragged(w.bounds[:-1], inside)] * np.uint32(0x9E3779B1)
    gram_first = np.concatenate([[0], np.cumsum(inside)])
    table = 1 << BITS
    return [
        ((hashes >> np.uint64(64 - BITS)).astype(np.int64), w.first),
        ((pairs >> np.uint64(64 - BITS)).astype(np.int64) + table, pair_first),
        ((grams >> np.uint32(32 - BITS)).astype(np.int64) + 2 * table, gram_first),
    ]


def logits(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for slot, first in features(texts):
        out += per_text(model.weights[slot], first) / np.maximum(np.diff(first), 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def good_probability(texts: pa.Array, model: Model) -> np.ndarray:
    return _sigmoid(model.slope * logits(texts, model) + model.shift)


# --- training ---------------------------------------------------------------------------------


def _share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's feature slots and shares, packed."""
    for part in slices(batches, "text"):
        families = features(part.column("text"))
        slots, shares = [], []
        for i in range(part.num_rows):
            own = [np.unique(slot[f[i] : f[i + 1]], return_counts=True) for slot, f in families]
            slots.append(np.concatenate([s for s, _ in own]).astype(np.int32).tobytes())
            shares.append(np.concatenate([c / max(c.sum(), 1) for _, c in own]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("__label"), pa.array(slots, pa.binary()), pa.array(shares, pa.binary())],
            ["doc_id", "label", "slots", "shares"],
        )


def fit_weights(slot, share, first, y, weight, rounds: int = ROUNDS, rate: float = 1.0, decay: float = 1e-6):
    """Logistic regression by Adam over all rows at once."""
    n = 3 << BITS
    used, place = np.unique(slot, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    row = np.repeat(np.arange(len(y)), np.diff(first))
    total = weight.sum()
    for step in range(1, rounds + 1):
        z = np.bincount(row, share * w[place], minlength=len(y)) + bias
        error = (_sigmoid(z) - y) * weight / total
        grad = np.bincount(place, share * error[row], minlength=len(used)) + decay * w
        grad = np.append(grad, error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    out = np.zeros(n)
    out[used] = w
    return out, bias


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid over logits, by damped Newton steps on smoothed targets."""
    ones, zeros = weight[y == 1].sum(), weight[y == 0].sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g, h = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """Fit on at most ``sample`` documents of each label; labels weigh as often as they occur in the table."""
    rows, counts = labelled_sample(docs.select("doc_id", "text"), labels, "quality", sample, seed)
    got = rows.mapInArrow(_share_rows, "doc_id long, label int, slots binary, shares binary").toPandas()
    got = got.sort_values(["doc_id", "slots"], ignore_index=True)
    y = got["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return Model(np.zeros(3 << BITS), 0.0, 1.0, 0.0)
    slots = [np.frombuffer(b, np.int32) for b in got["slots"]]
    shares = [np.frombuffer(b, np.float32) for b in got["shares"]]
    weight = np.array([counts[int(v)] / max((y == v).sum(), 1) for v in y])
    held = crc_mod(got["doc_id"].tolist(), 5) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)

    def pack(rows):
        first = np.concatenate([[0], np.cumsum([len(slots[i]) for i in rows])])
        return np.concatenate([slots[i] for i in rows]), np.concatenate([shares[i] for i in rows]), first

    seen = np.flatnonzero(~held)
    slot, share, first = pack(seen)
    weights, bias = fit_weights(slot, share, first, y[seen], weight[seen])
    other = np.flatnonzero(held) if held.any() else seen
    slot, share, first = pack(other)
    z = np.bincount(np.repeat(np.arange(len(other)), np.diff(first)), share * weights[slot], minlength=len(other)) + bias
    slope, shift = calibrate(z, y[other], weight[other] * len(other) / weight[other].sum())
    return Model(weights, bias, slope, shift)


# --- the operator -----------------------------------------------------------------------------

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def rate_documents(docs: DataFrame, model: Model, threshold: float = GOOD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, the five counts, base_failed, p_good and kept."""
    sent = share(docs.sparkSession, model)  # a table of fixed size

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for part in slices(batches, "__text"):
            texts = part.column("__text")
            counted = base_counts(texts)
            failed = base_failed(counted["n_words"], counted["n_repeat_words"])
            p = good_probability(texts, model)
            columns = [part.column(id), *[pa.array(counted[c], pa.int64()) for c in COUNTS]]
            columns += [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, [id, *COUNTS, "base_failed", "p_good", "kept"])

    kind = docs.schema[id].dataType.simpleString()
    out = f"{id} {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, p_good double, kept boolean"
    return docs.selectExpr(id, f"{text} AS __text").mapInArrow(rate, out)
