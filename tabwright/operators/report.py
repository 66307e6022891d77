"""Report parts: key numbers, limitations, result description and the assembled long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.operators import columns as C


def key_metrics(roles: DataFrame, quality: DataFrame) -> DataFrame:
    """One row of headline numbers with their display text.

    ``roles``: profile with one row per column; ``quality``: one row with score and duplicates.
    """
    counted = roles.agg(F.max("row_count").alias("total_records"), F.count("*").alias("total_columns"))
    found = quality.select(
        F.col("score").alias("data_quality_score"), F.col("duplicate_rows").alias("duplicate_row_count")
    )
    return C.with_row(counted, found).select(
        "*",
        F.format_number("total_records", 0).alias("records_text"),
        F.concat(F.col("data_quality_score").cast("string"), F.lit("/100")).alias("quality_text"),
    )


def limitations(
    roles: DataFrame, duplicates: DataFrame, entity_column: str | None = None, most: int | None = None
) -> DataFrame:
    """(position, limitation): what the data does not allow, as sentences.

    All sparse columns are named, or the first ``most`` followed by the number of the others.
    """
    missing = F.col("missing_pct") > 5
    facts = roles.agg(
        F.max("row_count").alias("rows"),
        F.count_if(F.col("role") == "datetime").alias("dates"),
        F.count_if(F.col("role") == "id").alias("ids"),
        # One entry per column of the table.
        F.array_sort(F.collect_list(F.when(missing, F.struct("position", "attribute", "missing_pct")))).alias("sparse"),
    )
    facts = C.with_row(facts, duplicates.select("duplicate_rows"))
    listed = F.array_join(
        F.transform(
            F.slice("sparse", 1, most) if most else F.col("sparse"),
            lambda s: F.concat(s["attribute"], F.lit(" ("), s["missing_pct"].cast("string"), F.lit("%)")),
        ),
        ", ",
    )
    if most:
        others = F.size("sparse") - most
        listed = F.when(others > 0, F.concat(listed, F.format_string(" and %d more", others))).otherwise(listed)
    # The sentences, each after the condition that calls for it.
    without_entity = F.lit(entity_column is None) & (F.col("ids") == 0)
    rules: list[tuple[Column, Column]] = [
        (F.size("sparse") > 0,
         F.concat(F.lit("Columns with >5% missing values detected: "), listed, F.lit("."))),
        (F.col("duplicate_rows") > 0,
         F.concat(F.format_number("duplicate_rows", 0), F.lit(" duplicate rows detected prior to cleaning step."))),
        (F.col("dates") == 1,
         F.lit("Only one datetime column present, limiting complex multi-event temporal analysis.")),
        (F.col("dates") == 0,
         F.lit("No datetime columns detected; longitudinal and cohort retention analyses were skipped.")),
        (without_entity, F.lit("No unique entity ID column identified; entity-level aggregation was skipped.")),
        (F.col("rows") < 50,
         F.format_string("Small dataset sample size (%d rows); statistical findings should be interpreted with caution.",
                         F.col("rows"))),
    ]
    found = F.array_compact(
        F.array(
            *[
                F.when(when, F.struct(F.lit(i).alias("position"), text.alias("limitation")))
                for i, (when, text) in enumerate(rules, start=1)
            ]
        )
    )
    return facts.select(F.inline(found))


def section(name: str, position: int, table: DataFrame) -> DataFrame:
    """Rows of one section as JSON records."""
    return table.select(
        F.lit(position).alias("position"),
        F.lit(name).alias("section"),
        F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("record"),
        F.lit(None).cast("string").alias("skip_reason"),
    )


def skipped_section(like: DataFrame, name: str, position: int, reason: str) -> DataFrame:
    """The single row that keeps a section which could not run, with the reason."""
    return like.sparkSession.createDataFrame(
        [(position, name, None, reason)], "position int, section string, record string, skip_reason string"
    )


def build(sections: list[DataFrame]) -> DataFrame:
    """All sections in long form: (position, section, record, skip_reason)."""
    result = sections[0]
    for part in sections[1:]:
        result = result.unionByName(part)
    return result


def title(dataset_type: str, key_entity: str) -> str:
    return f"Auto-Analysis Report: {dataset_type.title()} Data ({key_entity.title()} Level)"


def describe_result(df: DataFrame) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per numeric column of a result."""
    from tabwright.operators.profile import numeric_summary

    return numeric_summary(df).select("attribute", "n", "mean", "std", "min", "p25", "median", "p75", "max")
