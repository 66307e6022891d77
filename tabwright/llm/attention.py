"""Quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded: the mean of its words'
hashed embeddings (the word, its beginning and its ending) beside a few measures of its form, through
one tanh layer. A gated attention layer weighs the passages, the weighted mean of their codes represents
the document, and a logistic layer scores it. Only documents have labels; which passages speak for
a label is what the attention learns. Trained in numpy on a bounded sample of labelled documents, whole
texts, and calibrated on a seventh of them that the fit did not see. Scored in Arrow batches. Text
is all a score depends on.

Nulls: a null or empty text is one empty passage; rows without an id are scored too. Repeated rows are
scored one by one. A long text has more passages, no other treatment. Ties for the top passage go to the first.
Extra columns are ignored. Without labelled rows of both kinds the score is 0.5 everywhere. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.labelled import labelled_sample
from tabwright.llm.quality import calibrate
from tabwright.llm.textscan import Words, crc_mod, per_text, range_hashes, scan, share, shared, slices, word_hashes
from tabwright.session import ship_with_tasks

ship_with_tasks(__name__)

PASSAGE = 48
DIMS = 12
CODE = 16
GATE = 8
BITS = 16
#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 1500
EPOCHS = 8
LEAST_STEPS = 240
BATCH = 64
#: Training documents that must hold a piece before it gets an embedding.
LEAST_SEEN = 4
SLICE_BYTES = 2 << 20
RATE = 0.02

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
FORM = 9


@dataclass
class Bags:
    """Passages of many documents: ``first[i]:first[i + 1]`` are those of document i."""

    pieces: np.ndarray  # embedding rows of each distinct word
    place: np.ndarray  # the distinct word at each place
    cut: np.ndarray  # first word of each passage, and the end
    form: np.ndarray  # measures of each passage
    first: np.ndarray


@dataclass
class Model:
    embed: np.ndarray  # 2**BITS x DIMS
    layers: dict[str, np.ndarray]
    middle: np.ndarray  # of the measures
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


# --- passages ---------------------------------------------------------------------------------


def word_pieces(w: Words, which: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Embedding rows of words: the word, its first four and its last three bytes."""
    start, end = w.start[which], w.end[which]
    begins = range_hashes(w.data, start, np.minimum(end, start + 4), seed=2)
    ends = range_hashes(w.data, np.maximum(start, end - 3), end, seed=3)
    return (np.stack([hashed, begins, ends], axis=1) >> np.uint64(64 - BITS)).astype(np.int32)


def bags(texts: pa.Array) -> Bags:
    w = scan(texts)
    count = w.count
    passages = np.maximum(-(-count // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(passages)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], passages)
    begin = np.repeat(w.first[:-1], passages) + nth * PASSAGE
    cut = np.append(begin, w.first[-1])
    hashed = word_hashes(w)
    distinct, which, place = np.unique(hashed, return_index=True, return_inverse=True)
    return Bags(word_pieces(w, which, distinct), place, cut, _form(w, cut, place, first), first)


def _form(w: Words, cut: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Measures of each passage: length, distinct words, words said twice running, bytes a word, capitals, digits,
    marks and line ends; and the document's length."""
    words = np.diff(cut)
    some = np.maximum(words, 1)
    rows = len(words)
    passage = np.repeat(np.arange(rows), words)
    kinds = np.unique(passage * np.int64(len(place) + 1) + place)
    distinct = np.bincount(kinds // (len(place) + 1), minlength=rows)
    raw = w.data[:-8]
    size = w.end - w.start

    def summed(mask: np.ndarray) -> np.ndarray:
        """Bytes of a kind from a passage's first word to the next passage's (its text's end)."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        begin = np.append(w.start, len(raw))[cut[:-1]]
        end = np.append(begin[1:], len(raw))
        end[first[1:] - 1] = w.bounds[1:]
        return total[np.maximum(end, begin)] - total[begin]

    again = np.zeros(len(place), bool)
    again[1:] = (place[1:] == place[:-1]) & (passage[1:] == passage[:-1])
    letters = np.maximum(per_text(size, cut), 1)
    starts = per_text(_UPPER[w.data[w.start]] if len(w.start) else np.zeros(0, bool), cut)
    columns = [
        words / PASSAGE, distinct / some, per_text(again, cut) / some, np.log1p(letters / some), starts / some, summed(_DIGIT[raw]) / letters,
        summed(_MARK[raw]) / letters, summed(raw == 10) / some, np.repeat(np.log1p(per_text(words, first)), np.diff(first)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def means(vectors: np.ndarray, place: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The mean word vector of each passage (zero where it is empty)."""
    return per_text(vectors[place], cut) / np.maximum(np.diff(cut), 1)[:, None]


# --- the network ------------------------------------------------------------------------------


def forward(x: np.ndarray, first: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Codes, attention weights, representations and logits of passages ``x`` in documents ``first``."""
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    s = (t * g) @ p["a"]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(s - np.maximum.reduceat(s, first[:-1])[doc]) if len(s) else s
    a = e / np.add.reduceat(e, first[:-1])[doc] if len(s) else s
    z = np.add.reduceat(h * a[:, None], first[:-1], axis=0) if len(s) else np.zeros((0, CODE))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "logit": z @ p["c"] + p["o"][0]}


def backward(x: np.ndarray, first: np.ndarray, p: dict[str, np.ndarray], f: dict[str, np.ndarray], error: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of all layers and of ``x``, for the gradient ``error`` of the logits."""
    doc, a, h, t, g = f["doc"], f["a"], f["h"], f["t"], f["g"]
    dz = error[:, None] * p["c"]
    da = (h * dz[doc]).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, first[:-1])[doc])
    dt = ds[:, None] * p["a"] * g * (1 - t * t)
    dg = ds[:, None] * p["a"] * t * g * (1 - g)
    dh = a[:, None] * dz[doc] + dt @ p["v"].T + dg @ p["u"].T
    dpre = dh * (1 - h * h)
    grads = {
        "w": x.T @ dpre, "b": dpre.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": ((t * g) * ds[:, None]).sum(axis=0),
        "c": f["z"].T @ error, "o": np.array([error.sum()]),
    }
    return grads, dpre @ p["w"].T


def inputs(bag: Bags, model: Model) -> np.ndarray:
    vectors = model.embed[bag.pieces].sum(axis=1) if len(bag.pieces) else np.zeros((0, DIMS), np.float32)
    return np.concatenate([means(vectors, bag.place, bag.cut), (bag.form - model.middle) / model.spread], axis=1)


def attend(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, passages, passage of the largest weight, that weight) of each text."""
    bag = bags(texts)
    f = forward(inputs(bag, model), bag.first, model.layers)
    score = _sigmoid(model.slope * f["logit"] + model.shift)
    passages = np.diff(bag.first)
    if not len(passages):
        return score, passages, passages, score
    top = np.maximum.reduceat(f["a"], bag.first[:-1])
    hit = np.flatnonzero(f["a"] == top[f["doc"]])
    spot = np.zeros(len(passages), np.int64)
    spot[f["doc"][hit[::-1]]] = (hit - bag.first[:-1][f["doc"][hit]])[::-1]
    return score, passages, spot, top


# --- training ---------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as its words' embedding rows, its passages' lengths and measures."""
    for part in slices(batches, "text", SLICE_BYTES):
        bag = bags(part.column("text"))
        words, lengths, forms = [], [], []
        size = np.diff(bag.cut)
        for i in range(part.num_rows):
            a, b = bag.first[i], bag.first[i + 1]
            words.append(bag.pieces[bag.place[bag.cut[a] : bag.cut[b]]].astype(np.uint16).tobytes())
            lengths.append(size[a:b].astype(np.int32).tobytes())
            forms.append(bag.form[a:b].tobytes())
        packed = [pa.array(x, pa.binary()) for x in (words, lengths, forms)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__label"), *packed], ["doc_id", "label", "words", "lengths", "form"])


class _Adam:
    def __init__(self, shape: tuple[int, ...]):
        self.m, self.v = np.zeros(shape, np.float32), np.zeros(shape, np.float32)

    def step(self, g: np.ndarray, n: int, rate: float, at=slice(None)) -> np.ndarray:
        self.m[at] = 0.9 * self.m[at] + 0.1 * g
        self.v[at] = 0.99 * self.v[at] + 0.01 * g * g
        return rate * (self.m[at] / (1 - 0.9**n)) / (np.sqrt(self.v[at] / (1 - 0.99**n)) + 1e-7)


def empty_model() -> Model:
    """One that scores 0.5."""
    sizes = {"w": (DIMS + FORM, CODE), "b": (CODE,), "v": (CODE, GATE), "u": (CODE, GATE), "a": (GATE,), "c": (CODE,), "o": (1,)}
    return Model(np.zeros((1 << BITS, DIMS), np.float32), {k: np.zeros(s) for k, s in sizes.items()}, np.zeros(FORM), np.ones(FORM))


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Model:
    """Train on documents given as (words x pieces, lengths of passages, passages x measures)."""
    rng = np.random.default_rng(seed)
    model = empty_model()
    forms = np.concatenate([d[2] for d in docs])
    model.middle, model.spread = forms.mean(axis=0), forms.std(axis=0) + 1e-3
    seen = np.zeros((2, 1 << BITS))
    for d, label in zip(docs, y):
        seen[int(label), np.unique(d[0])] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    sure = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    model.embed[:] = rng.normal(0, 0.05, model.embed.shape)
    model.embed[:, 0] = np.sign(odds) * np.clip(np.abs(odds) - sure, 0, 4) / 2  # what a piece says of the label, as far as it is sure
    known = seen.sum(axis=0) >= LEAST_SEEN
    model.embed *= known[:, None]
    p = model.layers
    for k in ("w", "v", "u", "a", "c"):
        p[k] = rng.normal(0, 1 / np.sqrt(p[k].shape[0]), p[k].shape)
    adam = {k: _Adam(v.shape) for k, v in p.items()}
    embed_adam = _Adam(model.embed.shape)
    steps = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(len(docs), 1)))):
        order = rng.permutation(len(docs))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            words = np.concatenate([docs[i][0] for i in chosen])
            lengths = np.concatenate([docs[i][1] for i in chosen])
            form = (np.concatenate([docs[i][2] for i in chosen]) - model.middle) / model.spread
            first = np.concatenate([[0], np.cumsum([len(docs[i][1]) for i in chosen])])
            used, inner = np.unique(words, return_inverse=True)
            inner = inner.reshape(words.shape)
            table = model.embed[used]
            cut = np.concatenate([[0], np.cumsum(lengths)])
            vectors = table[inner].sum(axis=1) if len(words) else np.zeros((0, DIMS), np.float32)
            x = np.concatenate([per_text(vectors, cut) / np.maximum(lengths, 1)[:, None], form], axis=1)
            f = forward(x, first, p)
            error = (_sigmoid(f["logit"]) - y[chosen]) * weight[chosen] / weight[chosen].sum()
            grads, dx = backward(x, first, p, f, error)
            steps += 1
            rate = RATE / (1 + steps / LEAST_STEPS)
            back = (dx[:, :DIMS] / np.maximum(lengths, 1)[:, None])[np.repeat(np.arange(len(lengths)), lengths)]
            flat = inner.ravel()
            push = np.stack([np.bincount(flat, np.repeat(back[:, d], words.shape[1]), minlength=len(used)) for d in range(DIMS)], axis=1) if len(used) else np.zeros((0, DIMS))
            model.embed[used] -= embed_adam.step(push, steps, rate, used) * known[used, None]
            for k, v in p.items():
                p[k] = v - adam[k].step(grads[k] + 1e-4 * v, steps, rate)
    return model


def _joined(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Bags:
    """The packed documents as passages, every word a distinct one."""
    words = np.concatenate([d[0] for d in docs])
    cut = np.concatenate([[0], np.cumsum(np.concatenate([d[1] for d in docs]))])
    first = np.concatenate([[0], np.cumsum([len(d[1]) for d in docs])])
    return Bags(words, np.arange(len(words)), cut, np.concatenate([d[2] for d in docs]), first)


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE, seed: int = 13) -> Model:
    """Fit on at most ``sample`` labelled documents of each label, among the ids that ``where`` allows."""
    rows, counts = labelled_sample(docs.select("doc_id", "text"), labels, "quality", sample, seed, where)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(_packed, f"doc_id {kind}, label int, words binary, lengths binary, form binary").toPandas()
    got = got.sort_values(["doc_id", "words"], ignore_index=True)
    y = got["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return empty_model()
    packed = [
        (np.frombuffer(w, np.uint16).reshape(-1, 3).astype(np.int64), np.frombuffer(n, np.int32).astype(np.int64), np.frombuffer(f, np.float32).reshape(-1, FORM))
        for w, n, f in zip(got["words"], got["lengths"], got["form"])
    ]
    weight = np.array([counts[int(v)] / max((y == v).sum(), 1) for v in y])
    held = crc_mod(got["doc_id"].tolist(), 7) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    seen = np.flatnonzero(~held)
    other = np.flatnonzero(held) if held.any() else seen
    model = fit([packed[i] for i in seen], y[seen], np.ones(len(seen)))
    bag = _joined([packed[i] for i in other])
    z = forward(inputs(bag, model), bag.first, model.layers)["logit"]
    model.slope, model.shift = calibrate(z, y[other], weight[other] * len(other) / weight[other].sum())
    return model


# --- the operator -----------------------------------------------------------------------------


def score_documents(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score (0 to 1), n_passages, top_passage (from 0) and top_weight of every document."""
    sent = share(docs.sparkSession, model)  # tables of fixed size

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for part in slices(batches, "__text", SLICE_BYTES):
            found = attend(part.column("__text"), model)
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array(v.astype(k.to_pandas_dtype()), k) for v, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([part.column("__id"), *columns], ["__id", "score", "n_passages", "top_passage", "top_weight"])

    kind = docs.schema[id].dataType.simpleString()
    plain = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    scored = plain.mapInArrow(rate, f"__id {kind}, score double, n_passages long, top_passage long, top_weight double")
    return scored.withColumnRenamed("__id", id)
