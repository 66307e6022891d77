"""Merkle manifest of a table: a digest for every row, a tree for every group, and a proof for every row.

Each row's digest is a leaf. The leaves of a group, in order, are folded eight at a time into a
subroot, and the subroots of all groups into the root. Leaves are numbered over range partitions
and cut into superblocks of ``8 ** DEPTH`` consecutive leaves of a group. One job reduces every
superblock to its node; the nodes above are few and are folded level by level, and every
superblock's way up (the other nodes it needs, level by level) is handed down from the root, eight
children to a parent. Then leaves and outer nodes are cogrouped by superblock, where the local
reduction, the proofs and the folding from each leaf up to the root happen together.

A row's proof lists, from its leaf to the root, its place among at most eight nodes and the others.
Folding a changed row's digest with the unchanged proof gives another root, which shows the change.

Nulls: each field is written as ``-`` if null, else as its number of UTF-8 bytes, ``:`` and its value;
null groups and null ids come first. Rows with equal ids follow in the order of their digests, and
equal rows are interchangeable. Empty and long texts are fields like any others. Extra columns are
ignored. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.ordering import numbered
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 8
#: Levels of a superblock: it has ``WIDTH ** DEPTH`` leaves.
DEPTH = 3
PATH = "array<struct<place:int,nodes:array<string>>>"


def field_bytes(value: Column) -> Column:
    """A field as it enters the digest."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_bytes(f) for f in fields]), 256)


# --- nodes above the superblocks --------------------------------------------------------------


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Fold (tree, idx, node, m) up, ``m`` the nodes of the tree's level.

    Returns the parents of each level, as (tree, idx, nodes, node, m) with ``nodes`` their children in
    order, and the roots (tree, root, height).
    """
    levels, roots = [], []
    height = 0
    while True:
        roots.append(nodes.filter("m = 1").select("tree", F.col("node").alias("root"), F.lit(height).alias("height")))
        most = nodes.agg(F.max("m")).first()[0] or 0
        if most <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        inner = nodes.filter("m > 1").withColumn("parent", F.expr(f"idx div {WIDTH}"))
        met = F.array_sort(F.collect_list(F.struct("idx", "node")))
        parents = inner.groupBy("tree", "parent").agg(met.alias("met"), F.first("m").alias("m"))
        parents = parents.select(
            "tree", F.col("parent").alias("idx"), F.col("met.node").alias("nodes"),
            F.sha2(F.concat_ws("", "met.node"), 256).alias("node"), F.expr(f"(m + {WIDTH - 1}) div {WIDTH}").alias("m"),
        )
        nodes = staged(parents, "merkle-level")
        levels.append(nodes)
        height += 1


def descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The way up from every node of the lowest level: (tree, idx, path), with what else ``roots`` carries.

    ``roots`` has (tree, height, path) and passes its other columns on.
    """
    rest = [c for c in roots.columns if c not in ("tree", "height", "path")]
    ways = roots.filter(F.col("height") == len(levels)).select("tree", F.lit(0).cast("long").alias("idx"), "path", *rest)
    for i in range(len(levels), 0, -1):
        parents = levels[i - 1].select("tree", "idx", "nodes")
        below = ways.join(parents, ["tree", "idx"]).select("tree", "idx", "nodes", "path", *rest, F.explode(F.sequence(F.lit(0), F.size("nodes") - 1)).alias("place"))
        step = F.array(F.struct("place", "nodes"))
        ways = below.select("tree", (F.col("idx") * WIDTH + F.col("place")).alias("idx"), F.concat(step, "path").alias("path"), *rest)
        ended = roots.filter(F.col("height") == i - 1).select("tree", F.lit(0).cast("long").alias("idx"), "path", *rest)
        ways = staged(ways.unionByName(ended), "merkle-ways")
    return ways


# --- inside a superblock ----------------------------------------------------------------------


def fold(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def local_levels(leaves: list[str], alone: bool) -> list[list[str]]:
    """The nodes of each level: up to one node if the tree has no other block, else up through DEPTH levels."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= DEPTH:
        last = levels[-1]
        levels.append([fold(last[i : i + WIDTH]) for i in range(0, len(last), WIDTH)])
    return levels


def _alone(total: int) -> bool:
    return total <= WIDTH**DEPTH


def _reduced(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
    own = leaves.sort_values("rank")
    node = local_levels(own["leaf"].tolist(), _alone(own["total"].iloc[0]))[-1][0]
    blocks = -(-int(own["total"].iloc[0]) // WIDTH**DEPTH)
    return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "node": [node], "m": [blocks]})


def _proved(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame, proofs: bool) -> pd.DataFrame:
    """Local reduction, proofs and folding of one superblock; ``outer`` is its row of nodes above."""
    own = leaves.sort_values("rank", ignore_index=True)
    above = outer.iloc[0]
    levels = local_levels(own["leaf"].tolist(), _alone(own["total"].iloc[0]))
    steps = [(int(s["place"]), list(s["nodes"])) for s in above["path"]]
    upper = "".join("".join(nodes[:at] + nodes[at + 1 :]) for at, nodes in steps)
    digests, folded, paths = [], [], []
    for i, (leaf, changed) in enumerate(zip(own["leaf"], own["changed"])):
        way, siblings = [], []
        at = i
        for level in levels[:-1]:
            begin = at - at % WIDTH
            run = level[begin : begin + WIDTH]
            way.append((at - begin, run))
            siblings += run[: at - begin] + run[at - begin + 1 :]
            at //= WIDTH
        node = changed if isinstance(changed, str) else leaf
        for place, run in way + steps:
            node = fold([*run[:place], node, *run[place + 1 :]])
        folded.append(node)
        digests.append(hashlib.sha256(("".join(siblings) + upper).encode()).hexdigest())
        if proofs:
            paths.append([{"place": p, "siblings": run[:p] + run[p + 1 :]} for p, run in way + steps])
    out = own[["id", "rank", "leaf"]].assign(tree=key[0], subroot=above["subroot"], root=above["root"])
    out = out.assign(proof_sha256=digests, folded_root=folded)
    return out.assign(proof=paths) if proofs else out


# --- the operator -----------------------------------------------------------------------------


def manifest(
    docs: DataFrame,
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    id: str = "doc_id",
    proofs: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: id, group's tree number, rank in it, leaf, subroot, root,
    proof_sha256, folded_root, verified and, with ``proofs``, proof.

    ``proof`` lists for each level the place among its run and the siblings' digests. The root is folded
    again for every row, from the digest of the row with the columns of ``changed`` in place of the
    table's where ``where`` holds, and with the proofs of the unchanged table.
    """
    plain = [docs[f] for f in fields]
    other = row_digest([(changed or {}).get(f, docs[f]) for f in fields])
    tampered = F.when(F.coalesce(where, F.lit(False)), other) if where is not None else F.lit(None).cast("string")
    leaves = docs.select(
        docs[id].alias("id"), docs[group].alias("group"), row_digest(plain).alias("leaf"), tampered.alias("changed"),
        F.monotonically_increasing_id().alias("copy"),
    )
    leaves = staged(leaves, "merkle-leaves")
    ranked = numbered(leaves, ["group"], [F.col("id"), F.col("leaf"), F.col("copy")])
    groups = staged(leaves.select("group").distinct(), "merkle-groups")
    trees = staged(numbered(groups, [], [F.col("group")], "tree", "trees"), "merkle-trees").withColumnRenamed("group", "of")
    ranked = ranked.join(trees, F.col("group").eqNullSafe(F.col("of")))
    ranked = ranked.select("tree", F.expr(f"rank div {WIDTH**DEPTH}").alias("idx"), "rank", "total", "id", "leaf", "changed")
    reduced = ranked.drop("id", "changed").groupBy("tree", "idx").applyInPandas(_reduced, "tree long, idx long, node string, m long")
    blocks = staged(reduced, "merkle-blocks")
    levels, subroots = climb(blocks)
    subroots = staged(subroots, "merkle-subroots")
    many = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("node"), F.lit(many).cast("long").alias("m"))
    top_levels, root = climb(tops)
    root = staged(root.withColumn("path", F.array().cast(PATH)), "merkle-root")
    ways = descend(top_levels, root).select(F.col("idx").alias("tree"), "path", F.col("root").alias("whole"))
    ways = subroots.join(ways, "tree").select("tree", "height", "path", F.col("root").alias("subroot"), F.col("whole").alias("root"))
    outer = descend(levels, staged(ways, "merkle-outer"))

    def prove(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return _proved(key, leaves, outer, proofs)

    kind = docs.schema[id].dataType.simpleString()
    shape = f"id {kind}, rank long, leaf string, tree long, subroot string, root string, proof_sha256 string, folded_root string"
    shape += ", proof array<struct<place:int,siblings:array<string>>>" if proofs else ""
    proved = ranked.groupBy("tree", "idx").cogroup(outer.groupBy("tree", "idx")).applyInPandas(prove, shape)
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    columns = ["tree", "rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", verified]
    return proved.select(F.col("id").alias(id), *columns, *(["proof"] if proofs else []))


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, upper, upper.lower())
