"""Isolation forest (Liu, Ting, Zhou 2008): small samples build trees, all rows are scored.

The model has a bounded size (by default 100 trees over about 256 sampled rows each) whatever
the table holds, so it is the only thing that passes through the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.text import name
from tabwright.operators import columns as C
from tabwright.operators.anomaly import CONTAMINATION, column_medians, filled_columns
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

TREES = 100
SAMPLE = 256
SEED = 42
#: Rows a task scores; small tables go to all cores in parts of at least so many rows.
TASK_ROWS, LEAST_ROWS = 50_000, 1_000
#: Cells that the tables of :class:`Steps` may have in all.
CELLS = 1 << 22

_NODES = "tree int, node int, feature int, cut double, below int, above int, path double, size int"


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(tree: int, x: np.ndarray) -> pd.DataFrame:
    """Nodes of one tree; ``path`` is the expected path length below or at a node."""
    rng = np.random.default_rng([SEED, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []

    def split(points: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, depth + float(_average_path(len(points))), len(points)])
        low, high = (points.min(0), points.max(0)) if len(points) else (np.zeros(0), np.zeros(0))
        open_features = np.flatnonzero(high > low)
        if depth < limit and len(points) > 1 and len(open_features):
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            under = points[:, f] <= cut
            below, above = split(points[under], depth + 1), split(points[~under], depth + 1)
            mean = (nodes[below][6] * under.sum() + nodes[above][6] * (~under).sum()) / len(points)
            nodes[me][2:7] = [f, cut, below, above, float(mean)]
        return me

    split(x, 0)
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


def drawn_rows(features: DataFrame, names: list[str], rows: int, trees: int, sample: int) -> DataFrame:
    """(tree, x, order): for every tree about ``sample`` rows, each with a hash that puts them in order.

    Every copy of a row has for every tree a number from a hash of its values, the tree and the number of the
    copy; a tree takes the copies with the smallest numbers. Equal rows are counted first, map-side, so a hot row is
    one record, and only its numbers below the bound are made, in ascending order. The draw depends on
    the rows and on nothing else: neither on their order nor on how they are partitioned.
    """
    bound = min(1.0, (sample + 6 * np.sqrt(sample) + 10) / rows)  # fewer than ``sample`` numbers are below it once in 10**8 draws
    x = F.array(*[C.col(c).cast("double") + F.lit(0.0) for c in names])  # adding 0 makes one zero of both
    counted = features.select(x.alias("x")).groupBy("x").agg(F.count("*").alias("copies"))
    digest = F.xxhash64(F.lit(SEED), "x")
    # The first tree a row joins, by one number: most rows of a large table join none.
    none = float(np.log1p(-bound)) if bound < 1 else float("-inf")
    uniform = (F.pmod(digest, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = F.floor(F.log(uniform) / (F.col("copies") * F.lit(none))) if bound < 1 else F.lit(0)
    joined = counted.select("x", "copies", digest.alias("digest"), F.least(first, F.lit(trees)).cast("int").alias("first")).filter(F.col("first") < trees)
    # These are few and small, but every number costs a generator of its own: all cores share them.
    joined = joined.repartition(joined.sparkSession.sparkContext.defaultParallelism, "digest")

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values, copies, digest, first in zip(batch["x"], batch["copies"], batch["digest"], batch["first"]):
                for tree in range(first, trees):
                    rng = np.random.default_rng([SEED, digest & (1 << 64) - 1, tree])
                    out += [(tree, values, u) for u in _lowest(rng, copies, bound, tree == first)]
            yield pd.DataFrame(out, columns=["tree", "x", "order"])

    return joined.mapInPandas(numbers, "tree int, x array<double>, order double")


def _lowest(rng: np.random.Generator, copies: int, bound: float, some: bool) -> Iterator[float]:
    """The numbers below ``bound`` of so many uniform ones, ascending; with ``some``, given that there is one."""
    below = 0.0
    for left in range(copies, 0, -1):
        # The smallest of ``left`` uniform numbers above ``below``.
        u = rng.random()
        if some and left == copies and bound < 1:
            u *= -np.expm1(left * np.log1p(-bound))
        below = below - (1 - below) * float(np.expm1(np.log1p(-u) / left))
        if below >= bound:
            return
        yield below


def fit(features: DataFrame, names: list[str], rows: int, trees: int = TREES, sample: int = SAMPLE) -> dict[int, pd.DataFrame]:
    """Grow the trees in parallel, one group of sampled rows per tree."""

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        chosen = group.nsmallest(sample, "order", keep="all").iloc[:sample]
        return _grow(int(group["tree"].iloc[0]), np.stack(chosen["x"].to_numpy()))

    drawn = drawn_rows(features, names, rows, trees, sample)
    tasks = min(trees, drawn.sparkSession.sparkContext.defaultParallelism)
    nodes = drawn.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    return {int(t): part.sort_values("node") for t, part in nodes.groupby("tree")}


def _walkable(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Arrays of one tree in which a leaf leads to itself, so all rows take equally many steps."""
    feature = part["feature"].to_numpy(np.int64)
    leaf = feature < 0
    me = np.arange(len(part))
    below = np.where(leaf, me, part["below"].to_numpy(np.int64))
    above = np.where(leaf, me, part["above"].to_numpy(np.int64))
    return np.where(leaf, 0, feature), part["cut"].to_numpy(float), below, above, part["path"].to_numpy(float)


# --- attribution -------------------------------------------------------------------------------


@dataclass
class Leaves:
    """Leaves whose paths split on the same columns."""

    columns: tuple[int, ...]
    low: np.ndarray  # a row is on the path where low < value <= high
    high: np.ndarray
    credit: np.ndarray  # leaf x 2**d x d: what each column adds, by which of the conditions a row meets


def _leaf_boxes(part: pd.DataFrame) -> Iterator[tuple[float, dict[int, list[float]]]]:
    """(path length, column -> [low, high, share]) of each leaf; the share is that of the sampled rows which
    the splits on the column let through."""
    rows = part.set_index("node")
    stack: list[tuple[int, dict[int, list[float]]]] = [(0, {})]
    while stack:
        node, box = stack.pop()
        r = rows.loc[node]
        f = int(r["feature"])
        if f < 0:
            yield float(r["path"]), box
            continue
        for child, side in ((int(r["below"]), 1), (int(r["above"]), 0)):
            low, high, share = box.get(f, [-np.inf, np.inf, 1.0])
            share *= rows.at[child, "size"] / r["size"]
            inner = [low, min(high, r["cut"]), share] if side else [max(low, r["cut"]), high, share]
            stack.append((child, {**box, f: inner}))


def _shapley(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Exact Shapley values of games ``v(S) = value * prod(met in S) * prod(share outside S)`` for every pattern of
    conditions met: leaf x 2**d x d."""
    leaves, d = share.shape
    met = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
    out = np.zeros((leaves, 1 << d, d))
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    for f in range(d):
        # Coefficients by size of the products over the other columns.
        sums = np.zeros((d, leaves, 1 << d))
        sums[0] = 1.0
        for n, s in enumerate(x for x in range(d) if x != f):
            for k in range(n + 1, -1, -1):
                sums[k] = sums[k] * share[:, s, None] + (sums[k - 1] * met[:, s] if k else 0.0)
        total = sum(w * c for w, c in zip(weight, sums))
        out[:, :, f] = value[:, None] * total * (met[:, f] - share[:, f, None])
    return out


def leaves_of(model: dict[int, pd.DataFrame], scale: float) -> tuple[list[Leaves], float]:
    """All leaves of the forest, by the columns of their paths, and the score (log2) expected when no column is known.

    A leaf's value is its part of the score's logarithm, so the credits of a row add up to
    log2(score) less that expectation.
    """
    found: dict[tuple[int, ...], list] = {}
    expected = 0.0
    for part in model.values():
        for path, box in _leaf_boxes(part):
            value = -path / max(len(model), 1) / scale
            expected += value * math.prod(b[2] for b in box.values())
            found.setdefault(tuple(sorted(box)), []).append((value, box))
    out = []
    for columns, leaves in sorted(found.items()):
        if columns:
            ends = np.array([[box[f] for f in columns] for _, box in leaves], dtype=float)
            out.append(Leaves(columns, ends[..., 0], ends[..., 1], _shapley(np.array([v for v, _ in leaves]), ends[..., 2])))
    return out, expected


def shapley_values(x: np.ndarray, leaves: list[Leaves]) -> np.ndarray:
    """Path-dependent tree SHAP values of every row and column: each leaf's conditions are looked up in its table."""
    out = np.zeros(x.shape)
    for group in leaves:
        count, d = group.low.shape
        table = group.credit.reshape(count << d, d)
        place = (np.arange(count) << d).astype(np.int32)
        step = max(16, (1 << 20) // (count * d))
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            spot = np.repeat(place[None, :], len(rows), axis=0)
            for j, f in enumerate(group.columns):
                cell = rows[:, f, None]
                spot += ((cell > group.low[:, j]) & (cell <= group.high[:, j])).astype(np.int32) << j
            out[at : at + step, group.columns] += table[spot].sum(axis=1)
    return out


@dataclass
class Steps:
    """What the forest expects of a row of which only some columns are known, as step functions of these.

    Credits are sums of these expectations over all subsets of the columns, so a row costs a look-up for each tree
    and subset in place of one for each leaf. That of one column is a single function for all trees; that of
    all columns is the score itself and has no table.
    """

    cuts: list[np.ndarray]  # per column the cuts of all trees, ascending
    alone: list[np.ndarray]  # per column the expectation when only it is known, by step
    trees: list[tuple[list[np.ndarray], list[tuple[int, tuple[int, ...], np.ndarray]]]]  # step of the tree by step of all; (subset, columns, table)
    weights: np.ndarray  # subset (as bits) x column: its share in the column's credit
    expected: float


def _subset_weights(d: int) -> np.ndarray:
    """Shapley's weights by subset (as bits) and column: those with the column count for it, the others against it."""
    out = np.zeros((1 << d, d))
    for s in range(1 << d):
        k = s.bit_count()
        for f in range(d):
            if s >> f & 1:
                out[s, f] = math.factorial(k - 1) * math.factorial(d - k) / math.factorial(d)
            else:
                out[s, f] = -math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
    return out


def steps_of(model: dict[int, pd.DataFrame], scale: float, columns: int, most: int = CELLS) -> Steps | None:
    """The forest's step functions, or None where their tables would have more than ``most`` cells."""
    cuts = []
    for part in model.values():
        split = part["feature"].to_numpy()
        cuts.append([np.unique(part["cut"].to_numpy(float)[split == f]) for f in range(columns)])
    if columns > 8:
        return None
    several = [s for k in range(2, columns) for s in itertools.combinations(range(columns), k)]
    if sum(math.prod(len(own[f]) + 1 for f in s) for own in cuts for s in several) > most:
        return None
    every = [np.unique(np.concatenate([own[f] for own in cuts] or [np.zeros(0)])) for f in range(columns)]
    alone = [np.zeros(len(c) + 1) for c in every]
    trees, expected = [], 0.0
    for part, own in zip(model.values(), cuts):
        tables = [(sum(1 << f for f in s), s, np.zeros([len(own[f]) + 1 for f in s])) for s in several]
        for path, box in _leaf_boxes(part):
            value = -path / max(len(model), 1) / scale
            share = [box[f][2] if f in box else 1.0 for f in range(columns)]
            expected += value * math.prod(b[2] for b in box.values())
            inside = [_steps_between(own[f], box.get(f)) for f in range(columns)]
            for f in range(columns):
                alone[f][_steps_between(every[f], box.get(f))] += value * math.prod(share[g] for g in range(columns) if g != f)
            for _, s, table in tables:
                table[tuple(inside[f] for f in s)] += value * math.prod(share[g] for g in range(columns) if g not in s)
        places = [np.searchsorted(own[f], np.concatenate([[-np.inf], every[f]]), "right").astype(np.int32) for f in range(columns)]
        trees.append((places, tables))
    return Steps(every, alone, trees, _subset_weights(columns), expected)


def _steps_between(cuts: np.ndarray, ends: list[float] | None) -> slice:
    """The steps a path's condition on a column lets through: low < value <= high."""
    low, high = ends[:2] if ends else (-np.inf, np.inf)
    first = np.searchsorted(cuts, low, "right") if low > -np.inf else 0
    return slice(first, np.searchsorted(cuts, high, "left") + 1 if high < np.inf else len(cuts) + 1)


def credits_by_steps(x: np.ndarray, steps: Steps, whole: np.ndarray) -> np.ndarray:
    """Path-dependent tree SHAP values of every row and column; ``whole`` is the score's logarithm to base 2."""
    d = x.shape[1]
    at = [np.searchsorted(cuts, x[:, f], "left") for f, cuts in enumerate(steps.cuts)]
    known = np.zeros((1 << d, len(x)))  # by subset
    known[0] = steps.expected
    for f in range(d):
        known[1 << f] = steps.alone[f][at[f]]
    known[-1] = whole
    for places, tables in steps.trees if d > 2 else []:
        here = [place[i] for place, i in zip(places, at)]
        for subset, columns, table in tables:
            spot = here[columns[0]]
            for f, size in zip(columns[1:], table.shape[1:]):
                spot = spot * size + here[f]
            known[subset] += table.ravel()[spot]
    out = np.zeros(x.shape)
    for subset in range(1 << d):  # one after the other, so that a row's sums do not depend on its batch
        out += known[subset][:, None] * steps.weights[subset]
    return out


def _scorer(model: dict[int, pd.DataFrame], credit: Steps | list[Leaves], names: list[str], scale: float):
    trees = [_walkable(part) for part in model.values()]
    depth = max(int(np.ceil(np.log2(max(part["size"].max(), 2)))) for part in model.values()) + 1 if model else 0

    @F.pandas_udf("score double, contributions array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(names)))
            values, start = x.ravel(), np.arange(len(x)) * len(names)
            total = np.zeros(len(x))
            for feature, cut, below, above, path in trees:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    at = np.where(values[start + feature[at]] <= cut[at], below[at], above[at])
                total += path[at]
            whole = -total / max(len(trees), 1) / scale
            found = credits_by_steps(x, credit, whole) if isinstance(credit, Steps) else shapley_values(x, credit)
            credits = np.round(found, 12) + 0.0  # sums of products end differently in batches of other sizes
            yield pd.DataFrame({"score": np.exp2(whole), "contributions": list(credits)})

    return score


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt out for costly work on each, by their number: a file of many rows may be small or come as one split."""
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS))
    return df.repartition(max(tasks, -(-rows // TASK_ROWS)))


def isolation_forest(
    df: DataFrame, columns: list[str] | None = None, contamination: float = CONTAMINATION, min_rows: int = 10,
    trees: int = TREES, sample: int = SAMPLE,
) -> DataFrame:
    """Every row with ``anomaly_score``, ``is_anomaly``, three ``drivers``, ``contributions`` and ``expected_score``.

    The contributions are exact path-dependent SHAP values of the score's logarithm to base 2: they add up to
    log2(anomaly_score) - log2(expected_score). ``trees`` and ``sample`` (rows a tree) bound the model, which passes through the driver.
    """
    names = columns or C.numeric_columns(df)
    medians = column_medians(df, names)
    names = [c for c in names if c in medians]
    rows = df.count()
    if not names or rows < min_rows:
        return df.select(
            "*",
            F.lit(None).cast("double").alias("anomaly_score"),
            F.lit(False).alias("is_anomaly"),
            F.array().cast("array<string>").alias("drivers"),
            F.array().cast("array<double>").alias("contributions"),
            F.lit(None).cast("double").alias("expected_score"),
        )
    filled = filled_columns(names, medians)
    model = fit(df.selectExpr(*[f"{x} AS {name(c)}" for c, x in filled.items()]), names, rows, trees, sample)
    scale = float(_average_path(min(sample, rows))) or 1.0
    credit = steps_of(model, scale, len(names))
    credit, expected = (credit, credit.expected) if credit else leaves_of(model, scale)
    score = _scorer(model, credit, names, scale)
    features = F.expr(f"array({', '.join(filled.values())})")
    # Scored once and written: the threshold and the result both read it.
    scored = staged(_dealt(df, rows).select("*", score(features).alias("__s")), "scored")
    cut = exact_quantiles(
        scored.select(F.lit(1).alias("all"), F.col("__s.score").alias("score")), ["all"], "score", [1 - contamination]
    ).first()["quantiles"][0]
    flagged = F.col("__s.score") > cut
    parts = F.array(
        *[
            F.struct((-F.abs(F.col("__s.contributions")[i])).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("c"))
            for i, c in enumerate(names)
        ]
    )
    top = F.transform(F.slice(F.array_sort(parts), 1, 3), lambda s: s["c"])
    return scored.select(
        *[C.col(c) for c in df.columns],
        F.col("__s.score").alias("anomaly_score"),
        flagged.alias("is_anomaly"),
        F.when(flagged, top).otherwise(F.array().cast("array<string>")).alias("drivers"),
        F.col("__s.contributions").alias("contributions"),
        F.lit(2.0**expected).alias("expected_score"),
    )


def attribution(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute contribution per column over all rows, strongest first."""
    per_row = scored.select(
        F.posexplode(F.transform("contributions", lambda v: F.abs(v))).alias("position", "contribution")
    )
    names = F.array(*[F.lit(c) for c in columns])
    return (
        per_row.groupBy("position")
        .agg(F.avg("contribution").alias("mean_contribution"))
        .select(F.get(names, F.col("position")).alias("attribute"), "mean_contribution")
        .orderBy(F.desc("mean_contribution"), "attribute")
    )
