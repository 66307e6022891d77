"""Classes of rare words, and their number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import brown


def test_rare_words_of_one_spelling_get_classes_of_their_own(spark):
    filler = " ".join(f"w{i}" for i in range(1100))
    texts = [filler] * 30 + ["left raxa right up raya down"] * 10 + ["left right up down"] * 30
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(-1, "left raxa right", False), (-2, "left raya right", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seen boolean")
    got = {r["doc_id"]: r for r in brown.score_documents(docs, F.col("seen")).collect()}
    assert got[-1]["base_score"] == pytest.approx(got[-2]["base_score"])
    assert got[-1]["score"] > got[-2]["score"] + 0.1


def test_classes_grow_with_the_vocabulary():
    assert brown.classes_for(1000) == 64 and brown.classes_for(10**6) == 100 and brown.classes_for(10**9) == 1000


def test_a_sweep_is_sent_only_the_words_that_may_move_in_it(spark, monkeypatch):
    sent, keep = [], brown.staged

    def counting(df, label):
        out = keep(df, label)
        if label == "beside":
            blobs = [bytes(r["packed"]) for r in out.filter(out["kind"] == brown.BESIDE).collect()]
            codes = [np.cumsum(brown._unpack(b)[0], dtype=np.int64) for b in blobs]
            sent.append(sum(len(np.unique(c // (2 * (brown.CLASSES + 1)))) for c in codes))
        return out

    monkeypatch.setattr(brown, "staged", counting)
    docs = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(2000)), True)], "doc_id long, text string, seen boolean")
    brown.score_documents(docs, F.col("seen"), sweeps=2).collect()
    assert sum(sent[:2]) == 2000 and 800 < sent[0] < 1200
    assert sent[2:] in ([0], [])  # a sweep that lowers the likelihood is the last


def test_shuffles_are_dropped_before_the_next_table_is_written(spark, monkeypatch):
    calls, written, keep, drop, delete = [], [], brown.staged, brown.drop_shuffles, brown.unstaged

    def staging(df, label):
        calls.append(label)
        out = keep(df, label)
        if label == "classes":
            written.append(out)
        return out

    def deleting(df):
        written[:] = [x for x in written if x is not df]
        delete(df)

    monkeypatch.setattr(brown, "staged", staging)
    monkeypatch.setattr(brown, "drop_shuffles", lambda spark: calls.append("drop") or drop(spark))
    monkeypatch.setattr(brown, "unstaged", deleting)
    docs = spark.createDataFrame([(i, f"a{i} b{i % 7} c", True) for i in range(50)], "doc_id long, text string, seen boolean")
    brown.score_documents(docs, F.col("seen"), sweeps=2).collect()
    after_words = calls[calls.index("words") :]
    assert set(after_words[1::2]) == {"drop"} and "drop" not in after_words[::2]
    assert len(written) == 1  # classes of earlier or worse sweeps are deleted
