"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of hashed embeddings of the whole word and of its beginnings, so
that inflected forms share what their stems have learned. Filters of several widths run over
the word vectors of the whole text, the strongest answer of each filter is kept, and a
logistic layer reads those. It is trained in numpy on a bounded sample of labelled documents;
the score is calibrated, and thresholds by language are set, on a fifth that it did not see.
Text is all the score depends on; the language only picks a threshold.

Nulls: a null text is an empty text, whose score follows from the bias; rows without an id are
scored too. Repeated rows are scored one by one. Without labelled rows of both kinds the score
is 0.5 everywhere. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.labelled import labelled_sample
from tabwright.llm.quality import calibrate
from tabwright.llm.textscan import MASK, Words, crc_mod, mix, scan, share, shared, slices, word_hashes
from tabwright.session import ship_with_tasks

ship_with_tasks(__name__)

WIDTHS = (1, 2, 3)
FILTERS = 8
DIMS = 8
BITS = 16
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 2000
EPOCHS = 10
LEAST_STEPS = 200
#: Training texts that must hold a piece before it gets an embedding.
LEAST_SEEN = 4
BATCH = 128
SLICE_BYTES = 2 << 20


@dataclass
class Model:
    embed: np.ndarray  # 2**BITS x DIMS
    filters: list[np.ndarray]  # per width: width x DIMS x FILTERS
    offsets: list[np.ndarray]
    read: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def pieces(words: Words, which: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Embedding rows of words: the whole word, then each beginning (the whole word again where it is shorter)."""
    eight = np.ndarray((len(words.data) - 7,), "<u8", words.data.data, strides=(1,))
    start = words.start[which]
    length = words.end[which] - start
    head = eight[start] if len(start) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    out = [hashes >> shift]
    for n in BEGINNINGS:
        stem = mix((head & MASK[n]) + np.uint64(n << 56)) >> shift
        out.append(np.where(length >= n, stem, out[0]))
    return np.stack(out, axis=1).astype(np.int32)


def _worded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of the distinct words, the distinct word at each place, first place of each text)."""
    w = scan(texts, lower=True)
    hashes = word_hashes(w)
    distinct, which, place = np.unique(hashes, return_index=True, return_inverse=True)
    return pieces(w, which, distinct), place, w.first


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    rows, place, first = _worded(texts)
    strongest = pooled(model.embed[rows].sum(axis=1) if len(rows) else np.zeros((0, DIMS), np.float32), place, first, model)[0]
    z = strongest @ model.read + model.bias
    return _sigmoid(model.slope * z + model.shift)


def pooled(vectors: np.ndarray, place: np.ndarray, first: np.ndarray, model: Model, where: bool = False):
    """Strongest answer of each filter per text (0 at least), and if asked the places it was given."""
    n, rows = len(place), len(first) - 1
    out = np.zeros((rows, FILTERS * len(WIDTHS)), np.float32)
    spot = np.full(out.shape, -1, np.int64) if where else None
    full = np.flatnonzero(np.diff(first) > 0)
    if not n:
        return out, spot
    last = np.zeros(n, bool)
    last[first[full + 1] - 1] = True
    for i, width in enumerate(WIDTHS):
        answer = (vectors @ model.filters[i][0])[place] + model.offsets[i]
        inside = np.ones(n, bool)
        for j in range(1, width):
            inside[n - j :] = False
            inside[: n - j] &= ~last[j - 1 : n - 1]
            more = (vectors @ model.filters[i][j])[place[j:]]
            answer[: n - j] += more * inside[: n - j, None]
        columns = slice(i * FILTERS, (i + 1) * FILTERS)
        best = np.maximum.reduceat(answer, first[full], axis=0)
        if where:
            for k in range(FILTERS):
                hit = np.flatnonzero(answer[:, k] >= np.repeat(best[:, k], np.diff(first)[full]))
                row = np.searchsorted(first, hit, side="right") - 1
                spot[row[::-1], i * FILTERS + k] = hit[::-1]
        out[full, columns] = np.maximum(best, 0)
    return out, spot


# --- training ---------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as the embedding rows of its words."""
    for part in slices(batches, "text", SLICE_BYTES):
        rows, place, first = _worded(part.column("text"))
        packed = [rows[place[first[i] : first[i + 1]]].astype(np.uint16).tobytes() for i in range(part.num_rows)]
        names = ["doc_id", "label", "lang", "rows"]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("__label"), part.column("lang"), pa.array(packed, pa.binary())], names
        )


def fit(texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """Train on texts given as arrays of embedding rows (words x pieces)."""
    rng = np.random.default_rng(seed)
    rows = 1 << BITS
    seen = np.zeros((2, rows))
    for rows_of, label in zip(texts, y):
        seen[int(label), np.unique(rows_of)] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - y).sum() + 1))
    odds -= 1.6 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))  # as much of it as is sure
    embed = rng.normal(0, 0.02, (rows, DIMS)).astype(np.float32)
    embed[:, 0] = np.clip(odds, 0, 5) / 2  # what each piece says of the label alone
    known = (seen.sum(axis=0) >= LEAST_SEEN)[:, None]
    embed *= known  # rare pieces say nothing, so single documents aren't learned by heart
    filters = [rng.normal(0, 0.2, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 0.5
    model = Model(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1), 0.0)
    params = [model.embed, *model.filters, *model.offsets, model.read]
    first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_m = bias_v = 0.0
    step, rate = 0, 0.01
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(len(texts), 1)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            words = np.concatenate([texts[i] for i in chosen])
            first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])])
            vectors = model.embed[words].sum(axis=1) if len(words) else np.zeros((0, DIMS), np.float32)
            top, spot = pooled(vectors, np.arange(len(words)), first, model, where=True)
            error = (_sigmoid(top @ model.read + model.bias) - y[chosen]) * weight[chosen] / weight[chosen].sum()
            grads = [np.zeros_like(p) for p in params]
            grads[-1] = top.T @ error + 1e-4 * model.read
            back = error[:, None] * model.read * (top > 0)
            for i, width in enumerate(WIDTHS):
                for k in range(FILTERS):
                    column = i * FILTERS + k
                    live = np.flatnonzero((top[:, column] > 0) & (spot[:, column] >= 0))
                    if not len(live):
                        continue
                    g, p = back[live, column], spot[live, column]
                    grads[1 + len(WIDTHS) + i][k] += g.sum()
                    for j in range(width):
                        ok = p + j < first[live + 1]
                        v = vectors[p[ok] + j]
                        grads[1 + i][j, :, k] += g[ok] @ v
                        push = (g[ok, None] * model.filters[i][j][:, k]).astype(np.float32)
                        np.add.at(grads[0], words[p[ok] + j], push[:, None, :])
            grads[0] *= known
            step += 1
            for p, g, m, v in zip(params, grads, first_moment, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(p.dtype)
            bias_m = 0.9 * bias_m + 0.1 * error.sum()
            bias_v = 0.99 * bias_v + 0.01 * error.sum() ** 2
            model.bias -= rate * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.99**step)) + 1e-7)
    return model


def logits_of(texts: list[np.ndarray], model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, words in enumerate(texts):
        vectors = model.embed[words].sum(axis=1) if len(words) else np.zeros((0, DIMS), np.float32)
        out[i] = (pooled(vectors, np.arange(len(words)), np.array([0, len(words)]), model)[0] @ model.read + model.bias)[0]
    return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float = 0.5) -> float:
    """The middle of the score range with the best F1; ``start`` where one label is missing."""
    if len(set(y)) < 2:
        return start
    order = np.argsort(-p, kind="stable")
    hit, all_hits = np.cumsum(weight[order] * y[order]), (weight * y).sum()
    f1 = 2 * hit / (np.cumsum(weight[order]) + all_hits)
    k = int(np.argmax(f1))
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit on at most ``sample`` labelled documents of each label, among the ids that ``where`` allows."""
    rows, counts = labelled_sample(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), labels, "toxic", sample, seed, where)
    got = rows.mapInArrow(_packed, "doc_id long, label int, lang string, rows binary").toPandas()
    got = got.sort_values(["doc_id", "rows"], ignore_index=True)
    y = got["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        zero = [np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS]
        flat = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        return Model(np.zeros((1 << BITS, DIMS), np.float32), zero, flat, np.zeros(FILTERS * len(WIDTHS)), 0.0)
    texts = [np.frombuffer(b, np.uint16).reshape(-1, 1 + len(BEGINNINGS)) for b in got["rows"]]
    weight = np.array([counts[int(v)] / max((y == v).sum(), 1) for v in y])
    held = crc_mod(got["doc_id"].tolist(), 5) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    seen = np.flatnonzero(~held)
    other = np.flatnonzero(held) if held.any() else seen
    model = fit([texts[i] for i in seen], y[seen], np.ones(len(seen)))
    z = logits_of([texts[i] for i in other], model)
    fair = weight[other] * len(other) / weight[other].sum()
    model.slope, model.shift = calibrate(z, y[other], fair)
    p = _sigmoid(model.slope * z + model.shift)
    langs = got["lang"].fillna("").to_numpy()[other]
    model.thresholds = {"": best_threshold(p, y[other], fair)}
    for lang in set(langs):
        own = langs == lang
        model.thresholds[str(lang)] = best_threshold(p[own], y[other][own], fair[own], model.thresholds[""])
    return model


# --- the operator -----------------------------------------------------------------------------


def score_documents(
    docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: list[str] | None = None, score: str = "score"
) -> DataFrame:
    """``keep`` columns of every document (the id alone if not given) with its score, 0 to 1."""
    sent = share(docs.sparkSession, model)  # tables of fixed size
    names = keep or [id]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(sent)
        for part in slices(batches, text, SLICE_BYTES):
            found = scores(part.column(text), model)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(found.astype(float))], [*names, score])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    read = names if text in names else [*names, text]
    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(rate, f"{', '.join(fields)}, `{score}` double")


def threshold_of(lang: Column, model: Model) -> Column:
    """The threshold of a language, that of all languages where it has none."""
    general = model.thresholds.get("", 0.5)
    named = [F.lit(x) for k, v in sorted(model.thresholds.items()) if k for x in (k, v)]
    return F.coalesce(F.create_map(*named)[F.coalesce(lang, F.lit(""))], F.lit(general)) if named else F.lit(general)
