"""The attention classifier: its network against loops, its gradients against differences, and held-out texts."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabwright.llm import attention, textscan
from tabwright.llm.queries import id_remainder


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    model = attention.empty_model()
    model.embed[:] = rng.normal(0, 0.5, model.embed.shape)
    model.layers = {k: rng.normal(0, 0.7, v.shape) for k, v in model.layers.items()}
    model.middle, model.spread = rng.normal(0, 0.1, attention.FORM), rng.uniform(0.5, 2, attention.FORM)
    model.slope, model.shift = 0.8, -0.1
    return model


def one_score(text, model):
    """A single text, passage by passage and word by word."""
    table, p = model.embed.astype(float), model.layers
    words = [w for w in textscan_words(text)]
    cuts = [words[i : i + attention.PASSAGE] for i in range(0, len(words), attention.PASSAGE)] or [[]]
    forms = attention.bags(pa.array([text], pa.string())).form
    codes, gates = [], []
    for part, form in zip(cuts, forms):
        vectors = []
        for w in part:
            raw = w.encode()
            rows = [hashed(raw, 0), hashed(raw[:4], 2), hashed(raw[-3:], 3)]
            vectors.append(sum(table[r] for r in rows))
        mean = sum(vectors) / len(vectors) if vectors else np.zeros(attention.DIMS)
        h = np.tanh(np.concatenate([mean, (form - model.middle) / model.spread]) @ p["w"] + p["b"])
        codes.append(h)
        gates.append(float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]))
    weight = [math.exp(s) for s in gates]
    z = sum(w * h for w, h in zip(weight, codes)) / sum(weight)
    logit = float(z @ p["c"] + p["o"][0])
    return 1 / (1 + math.exp(-(model.slope * logit + model.shift))), len(cuts), max(weight) / sum(weight)


def textscan_words(text):
    w = textscan.scan(pa.array([text], pa.string()))
    raw = w.data.tobytes()
    return [raw[a:b].decode(errors="surrogateescape") for a, b in zip(w.start, w.end)]


def hashed(raw, seed):
    data = np.frombuffer(raw + bytes(8), np.uint8)
    return int(textscan.range_hashes(data, np.array([0]), np.array([len(raw)]), seed)[0] >> np.uint64(64 - attention.BITS))


def test_scores_equal_a_passage_by_passage_reading():
    random.seed(2)
    texts = [" ".join(f"word{random.randrange(50)}{'!' * random.randrange(2)}" for _ in range(n)) for n in (1, 47, 48, 49, 200, 1000)]
    texts += ["", None, " \n ", "x"]
    model = random_model()
    score, passages, _, top = attention.attend(pa.array(texts), model)
    for i, text in enumerate(texts):
        want = one_score(text, model)
        assert (score[i], passages[i], top[i]) == (pytest.approx(want[0], rel=1e-4), want[1], pytest.approx(want[2], rel=1e-4))


def test_measures_of_passages():
    filler = " ".join(["aa"] * attention.PASSAGE)
    form = attention.bags(pa.array([filler + " Bb c4! Bb\n", None])).form
    assert form.shape == (3, attention.FORM)
    assert form[0, :3] == pytest.approx([1, 1 / attention.PASSAGE, 1 - 1 / attention.PASSAGE])
    assert form[1, :3] == pytest.approx([3 / attention.PASSAGE, 2 / 3, 0])
    assert form[1, 3:8] == pytest.approx([np.log1p(7 / 3), 2 / 3, 1 / 7, 1 / 7, 1 / 3])
    assert form[:, 8] == pytest.approx([np.log1p(attention.PASSAGE + 3)] * 2 + [0])


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    p = random_model(1).layers
    first = np.array([0, 3, 4, 9])
    x = rng.normal(0, 1, (9, attention.DIMS + attention.FORM))
    y = np.array([1.0, 0.0, 1.0])

    def loss(x, p):
        z = attention.forward(x, first, p)["logit"]
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    f = attention.forward(x, first, p)
    grads, dx = attention.backward(x, first, p, f, attention._sigmoid(f["logit"]) - y)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            moved = {**p, k: p[k].copy()}
            moved[k][at] += 1e-5
            assert grads[k][at] == pytest.approx((loss(x, moved) - loss(x, p)) / 1e-5, rel=1e-2, abs=1e-4)
    moved = x.copy()
    moved[5, 3] += 1e-5
    assert dx[5, 3] == pytest.approx((loss(moved, p) - loss(x, p)) / 1e-5, rel=1e-2, abs=1e-4)


def labelled(spark, n=500):
    random.seed(8)
    plain = lambda k: " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) + random.choice("abcdefgh") for _ in range(k))
    rows = [(i, plain(150) + (" buy cheap pills now " * 6 if i % 4 == 0 else " ") + plain(150)) for i in range(n)]
    labels = [(i, int(i % 4 != 0)) for i in range(n)] + [(None, 1), (10**6, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_and_the_passages_that_speak(spark, corpus, nothing):
    docs, labels = labelled(spark)
    model = attention.train(docs, labels, where=id_remainder(5) != 0, sample=150)
    got = {r["doc_id"]: r for r in attention.score_documents(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(got[i]["score"] >= 0.5) == (i % 4 != 0) for i in held]) > 0.95
    spam = [got[i]["top_passage"] for i in held if i % 4 == 0]
    assert np.mean([3 <= t <= 4 for t in spam]) > 0.8  # words 150 to 174 of passages of 48
    odd = attention.score_documents(corpus, model).collect()
    assert len(odd) == corpus.count() and all(0 <= r["score"] <= 1 and r["n_passages"] >= 1 for r in odd)
    assert attention.score_documents(nothing, model).count() == 0
    copies = {r["score"] for r in odd if r["doc_id"] in (0, 1)}
    assert len(copies) == 1
    untrained = attention.train(docs, labels.limit(0))
    assert {r["score"] for r in attention.score_documents(docs.limit(3), untrained).collect()} == {0.5}


def test_labels_outside_where_are_not_learned_from(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality")
    a = attention.train(docs, labels, where=id_remainder(5) != 0, sample=60)
    b = attention.train(docs, flipped, where=id_remainder(5) != 0, sample=60)
    assert np.array_equal(a.embed, b.embed) and a.slope == b.slope
