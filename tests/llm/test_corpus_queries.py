"""Registered queries of the package against their SQL, and the pipeline stage by stage."""

import os

import pytest

import compare
import corpus_pipeline
from test_operators import cut_by_hand, groups_by_hand, words
from tabwright.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found = compare.spark_result(QUERIES[name](spark, FOLDER))
    assert compare.differences(found, compare.sql_result(compare.connect(FOLDER), SQL[name])) == []


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == before.columns and docs.count() > 0
        if name == "ngram_jaccard_join":
            rows = before.selectExpr("doc_id", "text", "xxhash64(text)").collect()
            kept = [r[0] for r in groups_by_hand(list(map(tuple, rows))) if r[4]]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(kept)
    assert {"doc_id", "ids", "sequence_id"} <= set(docs.columns)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


@pytest.fixture(scope="module")
def awkward(spark, corpus):
    """The corpus, and rows that share an id but not a text, copies of rows, and rows without an id."""
    fresh = [" ".join(f"{p}{j}" for j in range(60)) for p in "pqr"]
    more = [(5, fresh[0]), (5, fresh[1]), (6, fresh[2]), (6, fresh[2]), (7, fresh[2] + " z"), (None, fresh[0]), (None, None)]
    rows = [(i, t, "en", "a", len(t or ""), -1, "x", 7, 0.5) for i, t in more]
    return corpus.unionByName(spark.createDataFrame(rows, corpus.schema)).repartition(3)


def test_near_duplicates_keep_one_row_of_each_group(spark, awkward):
    rows = [tuple(r) for r in awkward.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    judged = [r[0] for r in groups_by_hand(rows) if r[4]]
    in_group = [r for r in rows if r[0] is not None and words(r[1])]
    again = len(in_group) - len(set(in_group))
    kept = corpus_pipeline.drop_near_duplicates(spark, awkward, FOLDER)
    assert kept.columns == awkward.columns
    got = kept.collect()
    assert {str(r["doc_id"]) for r in got} == set(map(str, judged)) and len(got) == len(judged) - again
    assert {r["text"] for r in got if r["doc_id"] == 5} >= {" ".join(f"q{j}" for j in range(60)), " ".join(f"p{j}" for j in range(60))}
    assert sum(r["doc_id"] is None for r in got) == sum(r[0] is None for r in rows)


def test_repeats_are_cut_in_their_own_rows(spark, awkward):
    docs = awkward.selectExpr("doc_id", "text").collect()
    got = corpus_pipeline.cut_repeats(spark, awkward, FOLDER).collect()
    gone = sum(n > 0 and n == removed for _, n, removed, _ in cut_by_hand([tuple(r) for r in docs]))
    assert len(got) == len(docs) - gone
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_the_mix_is_in_the_order_of_its_queue(spark, awkward):
    got = corpus_pipeline.mix_sources(spark, awkward, FOLDER).collect()
    sizes = [(r["source"], len(words(r["text"]))) for r in got]
    total = {s: sum(n for t, n in sizes if t == s) for s in {s for s, _ in sizes}}
    served, last = dict.fromkeys(total, 0), 0.0
    for source, n in sizes:
        served[source] += n
        finish = served[source] / total[source]
        assert finish >= last - 1 / total[source] - 1e-9  # targets end within a word
        last = max(last, finish)


def test_toxic_rows_go_and_others_stay(spark, awkward):
    kept = corpus_pipeline.drop_toxic(spark, awkward, FOLDER)
    assert kept.columns == awkward.columns and 0 < kept.count() <= awkward.count()
