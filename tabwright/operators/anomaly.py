"""Outlier scores over numeric columns: deviation scores, drivers, summary and alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.functions import parse, stats
from tabwright.functions.quantiles import exact_quantiles
from tabwright.functions.text import name, quoted
from tabwright.operators import columns as C

CONTAMINATION = 0.05
MIN_ROWS = 10
MIN_Z = 2.5


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median of the finite values per column; columns without any are left out."""
    finite = df.selectExpr(*[f"{parse.finite(name(c))} AS {name(c)}" for c in columns])
    cuts = exact_quantiles(C.long_numbers(finite, columns), ["attribute"], "value", [0.5])
    found = {r["attribute"]: r["quantiles"][0] for r in cuts.collect()}
    return {c: found[c] for c in columns if c in found}


def filled_columns(columns: list[str], medians: dict[str, float]) -> dict[str, str]:
    """Per column the SQL text of its value, or its median (else 0) where that is missing."""
    return {c: f"coalesce({parse.finite(name(c))}, {float(medians.get(c, 0.0))!r}D)" for c in columns}


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Infinite and missing numbers take their column's median, or 0 when it has none."""
    names = columns or C.numeric_columns(df)
    medians = column_medians(df, names)
    filled = filled_columns(names, medians)
    return df.selectExpr(*[f"{filled[c]} AS {name(c)}" if c in filled else name(c) for c in df.columns])


def zscore(
    df: DataFrame,
    columns: list[str] | None = None,
    contamination: float = CONTAMINATION,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Every row with ``anomaly_score`` (largest |z|), ``is_anomaly`` and its three ``drivers``.

    Three small jobs fix the medians, the moments and the threshold; scoring itself is
    one pass of plain expressions.
    """
    names = columns or C.numeric_columns(df)
    medians = column_medians(df, names)
    names = [c for c in names if c in medians]
    nothing = df.select(
        "*",
        F.lit(None).cast("double").alias("anomaly_score"),
        F.lit(False).alias("is_anomaly"),
        F.array().cast("array<string>").alias("drivers"),
    )
    if not names:
        return nothing
    filled = filled_columns(names, medians)
    moments = df.selectExpr(
        "count(*) AS n",
        f"array({', '.join(f'avg({x})' for x in filled.values())}) AS mean",
        f"array({', '.join(f'stddev_samp({x})' for x in filled.values())}) AS std",
    ).first()
    if moments["n"] < min_rows:
        return nothing
    # Means and deviations of very large numbers may be infinite; such a column then says nothing.
    z = [f"nanvl(abs(({filled[c]} - double('{m!r}')) / double('{s or 1.0!r}')), 0D)" for c, m, s in zip(names, moments["mean"], moments["std"])]
    ranked = [f"struct(-{e} AS z, {i} AS i, {quoted(c)} AS c)" for i, (e, c) in enumerate(zip(z, names))]
    scored = df.selectExpr(
        "*", f"array_max(array({', '.join(z)})) AS anomaly_score", f"array({', '.join(ranked)}) AS __z"
    )
    cut = exact_quantiles(
        scored.select(F.lit(1).alias("all"), "anomaly_score"), ["all"], "anomaly_score", [1 - contamination]
    ).first()["quantiles"][0]
    flagged = F.col("anomaly_score") >= max(MIN_Z, cut)
    top = F.transform(F.slice(F.array_sort("__z"), 1, 3), lambda s: s["c"])
    return scored.select(
        *[C.col(c) for c in df.columns],
        "anomaly_score",
        flagged.alias("is_anomaly"),
        F.when(flagged, top).otherwise(F.array().cast("array<string>")).alias("drivers"),
    )


def driver_columns(scored: DataFrame) -> DataFrame:
    """The columns that drove any flagged row, with how often."""
    drivers = scored.filter("is_anomaly").select(F.explode("drivers").alias("attribute"))
    return drivers.groupBy("attribute").agg(F.count("*").alias("flagged_rows")).orderBy("attribute")


def summary(scored: DataFrame) -> DataFrame:
    """One row: rows, flagged rows and share, the driving columns, highest score."""
    counts = scored.selectExpr(
        "count(*) AS row_count",
        "count_if(is_anomaly) AS anomaly_count",
        f"{stats.percent('count_if(is_anomaly)', 'count(*)', 1)} AS anomaly_pct",
        "count_if(is_anomaly) > 0 AS has_anomaly",
        "max(anomaly_score) AS max_score",
    )
    # At most one entry per column.
    names = scored.filter("is_anomaly").select(F.explode("drivers").alias("d"))
    return C.with_row(counts, names.selectExpr("array_sort(collect_set(d)) AS anomaly_columns"))


def alert(scored: DataFrame, query: str) -> DataFrame:
    """Alert header for an anomalous result; no row when nothing was flagged.

    The flagged rows themselves may be a share of a very large table, so they travel as
    rows of their own, see :func:`alert_rows`.
    """
    named = F.array_join("anomaly_columns", ", ")
    text = F.when(
        F.size("anomaly_columns") > 0, F.concat(F.lit("Column "), named, F.lit(" drove the anomaly."))
    ).otherwise("No contributing columns were identified.")
    return summary(scored).filter("has_anomaly").select(
        F.lit(query).alias("query"), "anomaly_count", named.alias("anomaly_columns"), text.alias("explanation")
    )


def alert_rows(scored: DataFrame, query: str) -> DataFrame:
    """Every flagged row as one JSON record of the alert."""
    kept = [c for c in scored.columns if c not in ("is_anomaly", "drivers")]
    record = F.to_json(F.struct(*[C.col(c) for c in kept]), {"ignoreNullFields": "false"})
    return scored.filter("is_anomaly").select(F.lit(query).alias("query"), record.alias("record"))
