"""Readers by file kind. Text kinds get null tokens resolved before types are inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions import parse
from tabwright.functions.text import name, one_of, pattern
from tabwright.operators import columns as C
from tabwright.session import spread
from tabwright.sources import quoted
from tabwright.sources.workbook import read_workbooks

_INTEGER_TEXT = r"^[+-]?\d{1,38}$"

#: Kinds of text columns, narrowest first: long numbers stay whole numbers.
_KINDS = {"bigint": "bigint", "whole": "decimal(38,0)", "double": "double", "boolean": "boolean"}


def typed_from_text(df: DataFrame) -> DataFrame:
    """Null tokens to null, then integer / double / boolean where every value allows it."""
    text = C.string_columns(df)
    if not text:
        return df
    cleared = df.selectExpr(
        *[
            f"if({one_of(name(c), parse.NA_TOKENS)}, NULL, {name(c)}) AS {name(c)}" if c in text else name(c)
            for c in df.columns
        ]
    )
    verdicts = C.per_column(
        spread(cleared),
        text,
        lambda c: {
            "filled": f"count({name(c)})",
            "bigint": f"count_if({name(c)} RLIKE {pattern(_INTEGER_TEXT)} AND try_cast({name(c)} AS BIGINT) IS NOT NULL)",
            "whole": f"count_if({name(c)} RLIKE {pattern(_INTEGER_TEXT)})",
            "double": f"count_if({name(c)} RLIKE {pattern(parse.NUMBER_TEXT)})",
            "boolean": f"count_if(lower({name(c)}) IN ('true', 'false'))",
        },
    ).collect()
    types = {}
    for v in verdicts:
        fitting = [kind for kind in _KINDS if v["filled"] and v[kind] == v["filled"]]
        if fitting:
            types[v["attribute"]] = _KINDS[fitting[0]]
    return cleared.selectExpr(
        *[f"CAST({name(c)} AS {types[c]}) AS {name(c)}" if c in types else name(c) for c in df.columns]
    )


def read_csv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Delimited text with a header. A schema skips the inference scan.

    Records with line breaks inside quotes are kept whole, and a large file is read by many tasks
    (see :mod:`tabwright.sources.quoted`). ``multiLine=False`` says that there are none; options that the
    splitting reader doesn't know (encodings, comments) leave each file to one task of Spark's own.
    """
    if str(options.get("multiLine", "")).lower() == "false" or set(options) - quoted.OPTIONS:
        options.setdefault("multiLine", True)
        reader = spark.read.options(header=True, escape='"', **options)
        read = (reader.schema(schema) if schema is not None else reader).csv(path)
    else:
        read = quoted.read_quoted(spark, path, schema, **options)
    return read if schema is not None else typed_from_text(read)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An array of objects, or one object per line; each file's first line tells which."""
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("place")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place)
    first = lines.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "place").alias("line"))
    found = first.select("file", F.ltrim("line").startswith("[").alias("whole")).collect()  # a row per file
    if len({r["whole"] for r in found}) < 2:
        return _json(spark, schema, bool(found and found[0]["whole"])).json(path)
    parts = [_json(spark, schema, whole).json([r["file"] for r in found if r["whole"] == whole]) for whole in (True, False)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def _json(spark: SparkSession, schema, whole: bool):
    reader = spark.read.option("multiLine", whole)
    return reader.schema(schema) if schema is not None else reader


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of every workbook below the path, read in parallel, one task per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return typed_from_text(read_workbooks(files))


_BY_SUFFIX = {"csv": read_csv, "json": read_json, "xlsx": read_excel, "parquet": read_parquet}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by suffix; the path may be a file, a folder or a glob."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in _BY_SUFFIX:
        raise ValueError(f"Unsupported file type: {suffix or path!r}")
    return _BY_SUFFIX[suffix](spark, path)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in the library; make it null once, at the edge."""
    floats = {c for c, t in df.dtypes if t in ("float", "double")}
    return df.selectExpr(
        *[f"{parse.nan_to_null(name(c))} AS {name(c)}" if c in floats else name(c) for c in df.columns]
    )
