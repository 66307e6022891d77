"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabwright.llm import merkle, ordering
from tabwright.llm.queries import id_remainder


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def digest(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def folded(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def by_hand(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], digest(r, r["text"]), digest(r, folded(r["text"]))))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = []
    for k in order:
        own = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append((own, climb([leaf for _, leaf, _ in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for t, (own, levels) in enumerate(trees):
        for i, (id, leaf, other) in enumerate(own):
            steps = way(levels, i) + way(top, t)
            node = other if id is not None and zlib.crc32(str(id).encode()) % 3 == 0 else leaf
            for before, after in steps:
                node = sha(*before, node, *after)
            proof = sha(*(x for before, after in steps for x in before + after))
            out.append((id, leaf, levels[-1][0], top[-1][0], proof, node))
    return sorted(out, key=str)


def proved(df, **kw):
    got = merkle.manifest(df, {"text": merkle.lower_ascii(df["text"])}, id_remainder(3) == 0, **kw).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    return got


def columns(got):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return sorted((tuple(r[c] for c in names) for r in got), key=str)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_equals_a_tree_by_hand(corpus, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(ordering, "RANGE_ROWS", 9)
    docs = corpus.withColumn("lang", F.expr("CASE WHEN doc_id % 20 = 3 THEN NULL WHEN doc_id = 9 THEN 'Zz' WHEN doc_id < 19 THEN 'a' ELSE lang END"))
    docs = docs.unionByName(docs.filter("doc_id IN (0, 101)")).repartition(3)
    got = proved(docs)
    assert columns(got) == by_hand(docs.collect())
    for r in got:  # the proofs themselves lead to the root
        node = r["leaf"]
        for step in r["proof"]:
            siblings = list(step["siblings"])
            node = sha(*siblings[: step["place"]], node, *siblings[step["place"] :])
        assert node == r["root"]
        assert r["proof_sha256"] == sha(*(x for step in r["proof"] for x in step["siblings"]))


def test_manifest_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    rows = [(i, f"Text {i}" if i % 3 else None, f"é{i % 70}" if i % 70 else None, "s", i) for i in range(-5, 700)]
    rows += [(i, "Long", "hot", "s", 4) for i in range(1000, 1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert columns(proved(docs, proofs=False)) == by_hand(docs.collect())


def test_a_lone_row_is_its_own_root(spark, nothing):
    docs = spark.createDataFrame([(4, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = proved(docs)
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha() and r["proof"] == []
    assert proved(nothing) == []


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, "Upper" if i % 2 else "lower", "en", "s", 5) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["verified"] for r in proved(docs, proofs=False)}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(100)}


def test_numbering_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    df = spark.range(100).selectExpr("IF(id < 60, NULL, 'b') AS g", "CAST(1 AS INT) AS v", "id AS copy")
    got = ordering.numbered(df, ["g"], [F.col("v"), F.col("copy")]).collect()
    for g, n in ((None, 60), ("b", 40)):
        own = [r for r in got if r["g"] == g]
        assert sorted(r["rank"] for r in own) == list(range(n)) and {r["total"] for r in own} == {n}
        assert [r["copy"] for r in sorted(own, key=lambda r: r["rank"])] == sorted(r["copy"] for r in own)
