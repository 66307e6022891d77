"""N-gram Jaccard self-join by chosen paths.

Texts are sets of five-word shingles (of all words, where there are fewer). In each run a set
follows a path of tokens: at every level it goes on with the token of its own that hashes lowest,
so two sets take the same step with a chance equal to their similarity. A bucket of sets with
the same path is split by one token more while it is large, and its sets are compared by brute
force once it is small or the path has its full length; a bucket that is still large then is
compared in tiles of bounded size, one task each. Runs are repeated until a pair at the threshold
is found with the target recall; a pair counts in the first run in which it meets.

Sets that are equal form a class and are one. Links are counted, never listed: comparing yields
one row per set and tile, with its number of linked documents and the smallest member of its
linked set of the tile. Those rows are the edges from which groups (connected components) are
found.

Nulls: a null or empty text has no shingles and no links; a row without an id is its own group
without links. Repeated rows are copies like any others. A class has a number of its own, so rows of
one id with different texts are compared, linked and counted each by its own text. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.textscan import mix, per_text, ragged, scan, shingle_hashes, slices, word_hashes
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
DEPTH = 2
#: Sets of a bucket that one task compares at once.
TILE = 2048
#: Bytes of sets that one task holds; of fewer than LEAST_BINS tasks, each gets SMALL_BIN_BYTES at least.
BIN_BYTES = 16 << 20
SMALL_BIN_BYTES = 256 << 10
LEAST_BINS = 32


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold has met with the wanted chance, on paths of full length."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


# --- sets -------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit shingles, each once and sorted within its text; first of each text)."""
    w = scan(texts)
    hashes = word_hashes(w)
    shingles, first = shingle_hashes(hashes, w.first, k)
    rows = len(w.first) - 1
    text = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    whole = hashes * np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, k - 1):
        inside = w.first[short] + j < w.first[short + 1]
        at = w.first[short[inside]]
        whole[at] = mix(whole[at]) + hashes[at + j]
    keys = np.concatenate([shingles >> np.uint64(16), mix(whole[w.first[short]]) >> np.uint64(16)])
    keys |= np.concatenate([text, short.astype(np.uint64)]) << np.uint64(48)
    keys = np.unique(keys)
    bounds = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(48))
    return keys & np.uint64((1 << 48) - 1), bounds


def set_digests(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = per_text(mix(sets + np.uint64(0x9E37)), first)
    return mix(total ^ np.diff(first).astype(np.uint64)).view(np.int64)


def lowest_tokens(sets: np.ndarray, first: np.ndarray, steps: int) -> np.ndarray:
    """For each text and step the hash of its lowest token under that step's order."""
    draws = mix(np.arange(1, steps + 1, dtype=np.uint64)) | np.uint64(1)
    return np.stack([per_text(sets * a, first, np.minimum) for a in draws], axis=1) if steps else np.zeros((len(first) - 1, 0), np.uint64)


def _signed(runs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets, first = shingle_sets(part.column("text"))
            low = mix(lowest_tokens(sets, first, runs * DEPTH)).view(np.int64)
            paths = pa.ListArray.from_arrays(pa.array(np.arange(0, low.size + 1, max(low.shape[1], 1), dtype=np.int32)), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_hash"), pa.array(set_digests(sets, first)), pa.array(np.diff(first).astype(np.int64)), paths],
                ["id", "text_hash", "digest", "size", "steps"],
            )

    return rows


# --- buckets ----------------------------------------------------------------------------------


def paths(classes: DataFrame, runs: int, tile: int) -> DataFrame:
    """The classes with ``leaves``: per run the bucket their path ends in."""
    step = classes.select("key", F.posexplode(F.expr(f"transform(sequence(0, {runs - 1}), r -> steps[r * {DEPTH}])")).alias("run", "bucket"))
    large = staged(step.groupBy("run", "bucket").count().filter(F.col("count") > tile).select(F.col("run").alias("lr"), F.col("bucket").alias("lb")), "large-buckets")
    split = classes.select("key", "steps", F.posexplode(F.expr(f"transform(sequence(0, {runs - 1}), r -> steps[r * {DEPTH}])")).alias("run", "bucket"))
    split = split.join(large, (F.col("run") == F.col("lr")) & (F.col("bucket") == F.col("lb")), "left")
    deeper = F.xxhash64("bucket", F.expr(f"steps[run * {DEPTH} + 1]"))
    leaf = F.struct("run", F.when(F.col("lr").isNull(), F.col("bucket")).otherwise(deeper).alias("leaf"))
    leaves = split.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["leaf"]).alias("leaves"))
    return leaves


def memberships(leaves: DataFrame, runs: int, tile: int) -> DataFrame:
    """(key, run, leaf, blocks) of the buckets in which some pair meets for the first time."""
    each = leaves.select("key", "leaves", F.posexplode("leaves").alias("run", "leaf"))
    spans = [f(F.col("leaves")[r]).alias(f"{n}{r}") for r in range(runs) for n, f in (("lo", F.min), ("hi", F.max))]
    buckets = each.groupBy("run", "leaf").agg(F.count("*").alias("members"), *spans)
    together = [(F.col("run") > r) & (F.col(f"lo{r}") == F.col(f"hi{r}")) for r in range(runs)]
    met = together[0]
    for t in together[1:]:
        met = met | t
    live = buckets.filter((F.col("members") > 1) & ~met)
    live = staged(live.select(F.col("run").alias("br"), F.col("leaf").alias("bl"), F.ceil(F.col("members") / tile).cast("int").alias("blocks")), "buckets")
    return each.join(live, (F.col("run") == F.col("br")) & (F.col("leaf") == F.col("bl"))).select("key", "leaves", "run", "leaf", "blocks")


def bins_for(size: int) -> int:
    """Tasks that compare ``size`` bytes of sets."""
    return max(min(LEAST_BINS, 1 + size // SMALL_BIN_BYTES), size // BIN_BYTES)


def _tile_rows(bins: int):
    """A row for each tile a set takes part in; a text that comes again in a task is left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for part in slices(batches, "text"):
            sets, first = shingle_sets(part.column("text"))
            digests = set_digests(sets, first)
            out = []
            columns = [part.column(c).to_pylist() for c in ("key", "digest", "copies", "leaves", "buckets")]
            for i, (key, digest, copies, leaves, buckets) in enumerate(zip(*columns)):
                if digest != digests[i] or key in done:
                    continue
                done.add(key)
                packed, known = sets[first[i] : first[i + 1]].tobytes(), np.array(leaves, np.int64).tobytes()
                for b in buckets:
                    own = int(mix(np.array([key], np.int64).view(np.uint64) + np.uint64(b["run"]))[0] >> np.uint64(11)) % b["blocks"]
                    for other in range(b["blocks"]):
                        low, high = min(own, other), max(own, other)
                        name = hash((b["run"], b["leaf"], low, high))
                        out.append((name % bins, b["run"], b["leaf"], low * b["blocks"] + high, own, low == high, key, copies, known, packed))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TILE_TYPES)], TILE_NAMES)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TILE_TYPES)], TILE_NAMES)

    return rows


TILE_NAMES = ["bin", "run", "leaf", "tile", "block", "alone", "key", "copies", "leaves", "tokens"]
TILE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
TILES = "bin long, run int, leaf long, tile long, block int, alone boolean, key long, copies long, leaves binary, tokens binary"


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Tokens that each set of ``a`` shares with each set of ``b``, in steps of bounded size."""
    both = a if a is b else a + b
    size = np.array([len(s) for s in both])
    tokens, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), size)
    common = np.bincount(column, minlength=len(tokens)) > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], place[column[keep]]
    total = np.zeros((len(a), len(b)), np.float32)
    wide = int(place[-1]) + 1 if len(place) else 0
    step = max(1024, (4 << 20) // len(both))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, wide, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(both), min(step, wide - at)), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        total += dense[: len(a)] @ (dense if a is b else dense[len(a) :]).T
    return total


def compare_bin(threshold: float):
    """Links and local groups of the tiles of one bin."""

    def rows(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("run", "leaf", "tile", "key")])
        run, leaf, tile, key = (table.column(c).to_numpy() for c in ("run", "leaf", "tile", "key"))
        block, alone, copies = (table.column(c).to_numpy() for c in ("block", "alone", "copies"))
        leaves = [np.frombuffer(x, np.int64) for x in table.column("leaves").to_pylist()]
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (leaf[1:] != leaf[:-1]) | (tile[1:] != tile[:-1])])
        cuts = np.append(np.flatnonzero(new), len(run))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = lo + np.flatnonzero(np.concatenate([[True], key[lo + 1 : hi] != key[lo : hi - 1]]))
            if alone[lo]:
                left = right = own
            else:
                left, right = own[block[own] == block[own].min()], own[block[own] > block[own].min()]
            if len(left) and len(right) and not (alone[lo] and len(own) < 2):
                out.append(_compare(left, right, alone[lo], run[lo], key, copies, leaves, tokens, threshold))
        names, links, roots = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"key": pa.array(names, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})

    return rows


def _compare(left, right, alone, run, key, copies, leaves, tokens, threshold):
    a = [tokens[i] for i in left]
    shared = intersections(a, a if alone else [tokens[i] for i in right])
    size_a = np.array([len(tokens[i]) for i in left], np.float32)
    size_b = size_a if alone else np.array([len(tokens[i]) for i in right], np.float32)
    near = shared * (1 + threshold) >= threshold * (size_a[:, None] + size_b[None, :]) - 1e-3
    if alone:
        np.fill_diagonal(near, False)
    fresh = near
    if run and near.any():
        fresh = near.copy()
        one, two = np.stack([leaves[i][:run] for i in left]), np.stack([leaves[i][:run] for i in right])
        for r in range(run):
            fresh &= one[:, r][:, None] != two[:, r][None, :]
    links_a, links_b = fresh @ copies[right], fresh.T @ copies[left]
    root_a, root_b = key[left].copy(), key[right].copy()
    top = np.iinfo(np.int64).max
    while True:
        best_a = np.minimum(root_a, np.where(near, root_b[None, :], top).min(axis=1))
        best_b = best_a if alone else np.minimum(root_b, np.where(near, best_a[:, None], top).min(axis=0))
        if (best_a == root_a).all() and (best_b == root_b).all():
            break
        root_a, root_b = best_a, best_b
    if alone:
        return key[left], links_a, root_a
    return np.concatenate([key[left], key[right]]), np.concatenate([links_a, links_b]), np.concatenate([root_a, root_b])


# --- groups -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for nodes with an edge.

    Alternates large-star and small-star steps, each a minimum per node and a join with it, until
    nothing changes. Minima are written before they are joined, so that a join may split a node
    with very many edges.
    """
    edges = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "large-star")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "small-star")
        if edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == sums:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


# --- the operator -----------------------------------------------------------------------------


def near_rows(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, text_hash (xxhash64 of the text), class_id (smallest id of its group of near
    duplicates), copy_of (smallest id with an equal set), n_links (rows whose similarity reaches the threshold, equal
    ones included) and keeper: whether id and text_hash are the smallest of the group."""
    kind = docs.schema[id].dataType
    runs = runs_for(threshold, recall)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    signed = staged(rows.mapInArrow(_signed(runs), "id long, text_hash long, digest long, size long, steps array<long>"), "signed")
    full = signed.filter("id IS NOT NULL AND size > 0")
    least = F.min(F.struct("id", "text_hash")).alias("rep")
    classes = full.groupBy("digest", "size").agg(least, F.count("*").alias("copies"), F.min("steps").alias("steps"))
    classes = staged(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    leaves = staged(paths(classes, runs, tile), "leaves")
    chosen = staged(memberships(leaves, runs, tile), "memberships")
    chosen = chosen.groupBy("key").agg(F.min("leaves").alias("leaves"), F.collect_list(F.struct("run", "leaf", "blocks")).alias("buckets"))
    sets = classes.select("key", "digest", "size", "copies", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    chosen = staged(chosen.join(sets, "key"), "chosen")
    sent = chosen.agg(F.sum(F.expr("size * aggregate(buckets, 0L, (n, b) -> n + b.blocks)"))).first()[0] or 0
    bins = bins_for(8 * sent)
    tiles = rows.join(chosen, (F.col("id") == F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    tiles = tiles.select("key", "digest", "copies", "leaves", "buckets", "text").mapInArrow(_tile_rows(bins), TILES)
    found = tiles.repartition(bins, "bin").groupBy("bin").applyInArrow(compare_bin(threshold), "key long, links long, root long")
    found = staged(found, "compared")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.join(links, "key", "left").select("digest", "size", "key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    groups = _group_names(roots, classes.select("key", "rep"))
    named = named.join(groups, F.col("key") == F.col("node"), "left")
    named = named.select("digest", "size", "rep", F.coalesce("first", "rep").alias("first"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id", "text_hash", "digest", "size").join(staged(named, "named"), ["digest", "size"], "left")
    known = F.col("id").isNotNull()
    own = F.struct("id", "text_hash")
    return out.select(
        F.col("id").cast(kind).alias(id),
        "text_hash",
        F.when(known, F.coalesce("first.id", "id")).cast(kind).alias("class_id"),
        F.when(known, F.coalesce("rep.id", "id")).cast(kind).alias("copy_of"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        (~known | F.coalesce(F.col("first") == own, F.lit(True))).alias("keeper"),
    )


def _group_names(roots: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, first): the smallest representative of each node's group, for the nodes of groups of two or more."""
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = members.join(classes, F.col("node") == F.col("key")).groupBy(F.col("root").alias("of")).agg(F.min("rep").alias("first"))
    return members.join(staged(least, "group-names"), F.col("root") == F.col("of")).select("node", "first")


def near_groups(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, class_id, copy_of and n_links of :func:`near_rows`."""
    return near_rows(docs, threshold, recall, tile, id, text).select(id, "class_id", "copy_of", "n_links")
