"""Findings of the second advice: whole results where the first code cut them."""

import os
from pathlib import Path
from urllib.parse import urlparse

import __spark_entry__ as contract
from tabwright.llm import jaccard
from tabwright.session import shared_root, staged


def test_a_question_covers_more_users_than_the_gate_returns(spark, tmp_path):
    users = spark.range(60_000).selectExpr("id AS user_id", "IF(id = 59999, 1e9D, CAST(id % 10 AS DOUBLE)) AS value")
    users.write.parquet(str(tmp_path / "events.parquet"))
    found = {r["attribute"]: r for r in contract.queries()["question_result"](spark, str(tmp_path)).collect()}
    assert found["user_id"]["n"] == 60_000 and found["user_id"]["max"] == 59_999
    assert found["total"]["max"] == 1e9 and found["total"]["alert_raised"]


def test_a_scratch_table_is_its_parts_alone(spark):
    """Hadoop may spawn a process for each file on a local disk: no checksums or markers beside the parts."""
    back = staged(spark.range(80, numPartitions=8), "parts-alone")
    files = os.listdir(urlparse(back.inputFiles()[0].rsplit("/", 1)[0]).path)
    assert len(files) == 8 and all(f.startswith("part-") for f in files)
    assert sorted(r["id"] for r in back.collect()) == list(range(80))


def test_few_sets_are_compared_in_few_tasks(spark, monkeypatch):
    """Of the same links, whatever the number of tasks."""
    rows = [(i, " ".join(f"w{i // 3}-{j}" for j in range(60)) + f" end{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = Path(urlparse(shared_root(spark)).path) / "tabwright"
    found = []
    for least in (None, 1):
        if least:
            monkeypatch.setattr(jaccard, "SMALL_BIN_BYTES", least)
        before = set(root.glob("compared-*"))
        found.append((sorted(map(tuple, jaccard.near_rows(docs).collect())), set(root.glob("compared-*")) - before))
    (one, few), (other, many) = found
    assert one == other and {r[4] for r in one} == {2} and {r[2] for r in one} == set(range(0, 60, 3))
    assert len(list(few.pop().glob("part-*"))) < 4 < len(list(many.pop().glob("part-*")))


def test_tasks_that_compare_grow_with_their_sets():
    assert jaccard.bins_for(0) == 1 and jaccard.bins_for(600 << 10) == 3
    assert jaccard.bins_for(100 << 20) == 32 and jaccard.bins_for(16 << 30) == 1024
