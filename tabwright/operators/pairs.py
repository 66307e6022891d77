"""Correlations of all column pairs at once: a blocked matrix of co-moments, one scan for any number of columns.

Every task multiplies its rows' columns block by block (numpy) and keeps eight numbers for each pair over
the rows in which both are present: their number, both means, both sums of squared deviations, the
sum of products of deviations, and how large either sum of squares may be by rounding alone. Blocks of two tasks merge pair by pair, so sums stay exact around
the data's own middle, and are merged in two steps over the cluster. The plan has the same size for
ten columns and for a thousand. Only the last step names pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.functions.text import name
from tabwright.session import ship_with_tasks, spread

ship_with_tasks(__name__)

#: Columns of a block.
BLOCK = 64
#: Parts that a block's partial results are merged in first.
PARTS = 64
#: Rows multiplied at once.
ROWS = 8192
ROUNDING = 4 * float(np.finfo(float).eps)

_PARTIAL = "a int, b int, part int, moments binary"


def co_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Eight matrices for the columns of ``x`` by those of ``y`` (NaN is missing): pairs, means, squares, products, rounding."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    a, b = here.astype(float), there.astype(float)
    shift_x, shift_y = _middle(x, here), _middle(y, there)
    x, y = np.where(here, x - shift_x, 0.0), np.where(there, y - shift_y, 0.0)
    n = a.T @ b
    some = np.maximum(n, 1)
    mean_x, mean_y = (x.T @ b) / some, (a.T @ y) / some
    whole_x, whole_y = (x * x).T @ b, a.T @ (y * y)
    square_x, square_y = np.maximum(whole_x - n * mean_x**2, 0), np.maximum(whole_y - n * mean_y**2, 0)
    product = x.T @ y - n * mean_x * mean_y
    return np.stack([n, mean_x + shift_x[:, None], mean_y + shift_y, square_x, square_y, product, whole_x * ROUNDING, whole_y * ROUNDING])


def _middle(x: np.ndarray, here: np.ndarray) -> np.ndarray:
    return np.where(here, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The co-moments of two sets of rows together."""
    n = one[0] + two[0]
    some = np.maximum(n, 1)
    dx, dy = two[1] - one[1], two[2] - one[2]
    share, weight = two[0] / some, one[0] * two[0] / some
    out = np.stack([
        n, one[1] + dx * share, one[2] + dy * share,
        one[3] + two[3] + dx * dx * weight, one[4] + two[4] + dy * dy * weight, one[5] + two[5] + dx * dy * weight,
        one[6] + two[6], one[7] + two[7],
    ])
    empty = one[0] == 0
    return np.where(empty, two, out)


def _blocks(columns: int) -> list[tuple[int, int]]:
    count = -(-columns // BLOCK)
    return [(a, b) for a in range(count) for b in range(a, count)]


def _partials(columns: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        part = 0
        for batch in batches:
            part = batch.column(columns)[0].as_py() if batch.num_rows else part
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = np.stack([piece.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(columns)], axis=1)
                x[~np.isfinite(x)] = np.nan
                for a, b in _blocks(columns):
                    new = co_moments(x[:, a * BLOCK : (a + 1) * BLOCK], x[:, b * BLOCK : (b + 1) * BLOCK])
                    held[a, b] = merged(held[a, b], new) if (a, b) in held else new
        for (a, b), moments in held.items():
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b, "part": part % PARTS, "moments": moments.tobytes()}], schema=_schema)

    return gather


_schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("part", pa.int32()), ("moments", pa.binary())])


def _merge(columns: int):
    width = lambda a: min(BLOCK, columns - a * BLOCK)

    def merge(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        total = None
        for raw in table.column("moments"):
            one = np.frombuffer(raw.as_buffer(), float).reshape(8, width(a), width(b))
            total = one if total is None else merged(total, one)
        return pa.Table.from_pylist([{"a": a, "b": b, "part": 0, "moments": total.tobytes()}], schema=_schema)

    return merge


def _pairs(columns: int):
    width = lambda a: min(BLOCK, columns - a * BLOCK)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw in zip(*(batch.column(c) for c in ("a", "b", "moments"))):
                a, b = a.as_py(), b.as_py()
                n, mean_x, mean_y, xx, yy, xy, ex, ey = np.frombuffer(raw.as_buffer(), float).reshape(8, width(a), width(b))
                # Deviations that rounding alone explains are those of a constant.
                flat = (xx <= ex + n * (8 * ROUNDING * mean_x) ** 2) | (yy <= ey + n * (8 * ROUNDING * mean_y) ** 2) | (n < 2)
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = np.where(flat, np.nan, np.clip(xy / np.sqrt(xx) / np.sqrt(yy), -1, 1))
                i, j = np.nonzero(np.ones_like(n) if a != b else np.triu(np.ones_like(n), 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((i + a * BLOCK).astype(np.int32)), pa.array((j + b * BLOCK).astype(np.int32)),
                        pa.array(n[i, j].astype(np.int64)), pa.array(r[i, j], mask=np.isnan(r[i, j])),
                    ],
                    ["i", "j", "n", "r"],
                )

    return rows


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, r) for every pair of the columns, i before j: Pearson's r over the n rows that have both.

    Nulls, NaN and infinities are missing. Null where a column is constant in those rows, or n < 2.
    """
    numbers = spread(df.selectExpr(*[f"double({name(c)}) AS c{i}" for i, c in enumerate(columns)]))
    partial = numbers.select("*", F.spark_partition_id().alias("part")).mapInArrow(_partials(len(columns)), _PARTIAL)
    merge = _merge(len(columns))
    once = partial.groupBy("a", "b", "part").applyInArrow(merge, _PARTIAL)
    whole = once.groupBy("a", "b").applyInArrow(merge, _PARTIAL)
    return whole.mapInArrow(_pairs(len(columns)), "i int, j int, n long, r double")
