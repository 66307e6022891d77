"""Identifier rules for columns and tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions import ordered
from tabwright.session import staged

_SEPARATORS = r"[\W_]+"


def _prefixed(stem: str, prefix: str, empty: str) -> str:
    if not stem:
        return empty
    return f"{prefix}_{stem}" if stem[0].isdigit() else stem


def snake_name(name: str) -> str:
    """Snake-case form of one schema name (schema names live on the driver)."""
    stem = "_".join(part for part in re.split(_SEPARATORS, name) if part).lower()
    return _prefixed(stem, "col", "col")


def unique_names(names: Iterable[str]) -> list[str]:
    """Snake-case every name; a taken name gets the first free suffix _2, _3, ..."""
    taken: set[str] = set()
    result = []
    for base in map(snake_name, names):
        candidate, n = base, 2
        while candidate in taken:
            candidate, n = f"{base}_{n}", n + 1
        taken.add(candidate)
        result.append(candidate)
    return result


def table_name(filename: str, existing: Iterable[str] = ()) -> str:
    """Table name for a file; avoids names (and raw twins) that already exist."""
    stem = filename.rsplit(".", 1)[0]
    stem = "_".join(part for part in re.split(_SEPARATORS, stem) if part).lower()
    base = _prefixed(stem, "tbl", "uploaded_table")
    taken = set(existing)
    candidate, n = base, 2
    while candidate in taken or f"{candidate}__raw" in taken:
        candidate, n = f"{base}_{n}", n + 1
    return candidate


def _squashed(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)[\W_]+", "_"), "^_|_$", ""))


def _prefixed_expr(stem: Column, prefix: str, empty: str) -> Column:
    return (
        F.when(stem == "", empty)
        .when(stem.rlike(r"(?U)^\d"), F.concat(F.lit(prefix + "_"), stem))
        .otherwise(stem)
    )


def identifier(c: Column) -> Column:
    """:func:`snake_name` for a column of names."""
    return _prefixed_expr(_squashed(c), "col", "col")


def table_identifier(c: Column) -> Column:
    """:func:`table_name` without the collision check, for a column of file names; see :func:`free_table_names`."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    return _prefixed_expr(_squashed(stem), "tbl", "uploaded_table")


def _numbered(df: DataFrame, by: str, order: list[Column], number: str) -> DataFrame:
    """Numbers rows from 1 within ``by``; no task holds more than a range of rows."""
    return ordered.running_total(df.withColumn("__one", F.lit(1)), [by], order, "__one", number, "__rows").drop("__one")


def free_table_names(files: DataFrame, file: str, existing: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``table_name``: :func:`table_name` for one after the other along ``order``, none taken twice.

    ``existing`` has a column table_name; a name is taken if it or its raw twin is there. Names are held as
    data: rows that want one name are numbered, every suffixed name is checked against the taken ones, and as many
    later suffixes are tried as were lost, until none is. Where a suffix would make a name that
    other files have by themselves, it is theirs. ``order`` must tell rows apart.
    """
    taken = existing.select(F.regexp_replace("table_name", "__raw$", "").alias("table_name")).distinct()
    base = files.withColumn("__base", table_identifier(F.col(file)))
    wanted = staged(_numbered(base, "__base", [F.col(c) for c in order], "__n"), "wanted-names")
    wishes = wanted.select("__base", F.col("__n").alias("__s"), F.col("__rows").alias("__upto"))
    granted = None
    while True:
        name = F.when(F.col("__s") == 1, F.col("__base")).otherwise(F.concat_ws("_", "__base", F.col("__s").cast("string")))
        wishes = wishes.withColumn("__name", name)
        longest = wishes.groupBy("__name").agg(F.max(F.struct(F.length("__base").alias("l"), F.col("__base").alias("b")))["b"].alias("__winner"))
        judged = wishes.join(taken.withColumnRenamed("table_name", "__name").withColumn("__lost", F.lit(True)), "__name", "left").join(longest, "__name")
        judged = staged(judged.withColumn("__won", F.col("__lost").isNull() & (F.col("__winner") == F.col("__base"))), "judged-names")
        won = judged.filter("__won").select("__base", "__s", "__name")
        granted = won if granted is None else granted.unionByName(won)
        lost = judged.filter("NOT __won").select("__base", "__s", "__upto")
        if not lost.head(1):
            break
        taken = staged(taken.unionByName(won.select(F.col("__name").alias("table_name"))), "taken-names")
        again = _numbered(lost, "__base", [F.col("__s")], "__k")
        wishes = staged(again.select("__base", (F.col("__upto") + F.col("__k")).alias("__s"), (F.col("__upto") + F.col("__rows")).alias("__upto")), "wishes")
    free = _numbered(granted, "__base", [F.col("__s")], "__n").select("__base", "__n", F.col("__name").alias("table_name"))
    return wanted.join(free, ["__base", "__n"]).select(*files.columns, "table_name")


# Fixed value: similarity (0-100) from which a requested name counts as meant.
MIN_NAME_SCORE = 60.0


def similarity(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence in percent of both lengths (100: equal, 0: nothing in common)."""
    total = F.length(a) + F.length(b)
    # One row of the table of common lengths, carried over the letters of the first name.
    letters = F.filter(F.split(a, ""), lambda c: c != "")
    others = F.filter(F.split(b, ""), lambda c: c != "")
    empty = F.transform(F.concat(others, F.array(F.lit(""))), lambda _: F.lit(0))

    def step(row: Column, letter: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(others)),
            F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(F.when(F.get(others, j - 1) == letter, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(done, -1)))),
            ),
        )

    common = F.element_at(F.aggregate(letters, empty, lambda row, letter: F.when(F.size(others) > 0, step(row, letter)).otherwise(row)), -1)
    return F.when(total == 0, 100.0).otherwise(common * 200.0 / total)


def closest_name(requested: Column, known: list[str], default: str) -> Column:
    """The most similar known name by :func:`similarity`, or the default below the minimum score.

    The known names come from schemas, so they travel inside the expression; any number
    of requests is matched without a join.
    """

    def scored(name: Column) -> Column:
        return F.struct((-similarity(requested, name)).alias("loss"), name.alias("name"))

    best = F.array_min(F.transform(F.array(*[F.lit(k) for k in known]), scored))
    return F.when(best["loss"] <= -MIN_NAME_SCORE, best["name"]).otherwise(default)
