"""Delimited text with line breaks inside quotes, read by many tasks.

Whether a line starts inside a quote depends on all lines before it. Each line is a step between two
states, outside and inside a quote, and is worked out for either start by Spark's own string
functions. A first pass sums up each split of a file to one such step; the splits are few, and
following them from the start of each file gives the state every split begins in. A second pass
joins the lines of each split to records; the piece of a record that begins in one split and ends
in a later one is put together by a shuffle of those pieces alone. The records are then parsed by
Spark's CSV reader, record by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tabwright.functions.text import name
from tabwright.session import ship_with_tasks, staged

ship_with_tasks(__name__)

#: Options that this reader understands; files that need others are read by one task each.
OPTIONS = {"sep", "delimiter", "header", "escape", "multiLine", "nullValue", "dateFormat", "timestampFormat", "mode", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"}


def _escaped(sep: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in sep)


def opens_quote(line: Column, sep: str = ",") -> Column:
    """Whether a line that starts outside quotes ends inside one.

    A quote opens at the start of a field only and is doubled inside; other quotes are text.
    """
    start = f"(^|{_escaped(sep)})"
    plain = F.regexp_replace(line, '""', "")
    closed = F.regexp_replace(plain, f'{start}"[^"]*"', "$1")
    return closed.rlike(f'{start}"[^"]*$')


def lines_of(spark: SparkSession, path, sep: str) -> DataFrame:
    """(file, start, line, cr, out, into): each line's split, whether it ends in a carriage return, and the state
    after it from either start."""
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    quotes = F.contains("line", F.lit('"'))
    body = F.regexp_replace("line", "\r$", "")
    return rows.select(
        "file", "start", "line", F.endswith("line", F.lit("\r")).alias("cr"),
        (quotes & opens_quote(body, sep)).alias("out"),
        (~quotes | opens_quote(F.concat(F.lit('"'), body), sep)).alias("into"),
    )


def _states(out: np.ndarray, into: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before each line of a run if it begins outside, and if it begins inside; ``begin`` marks where runs begin."""
    n = len(out)
    fixed, swap = out == into, out & ~into
    # From the last line that leads to one state whatever the start, or from the run's begin, only swaps count.
    swaps = np.concatenate([[0], np.cumsum(swap)])
    anchor = np.maximum.accumulate(np.where(np.concatenate([[False], fixed[:-1]]) | begin, np.arange(n), 0)) if n else np.zeros(0, int)
    odd = (swaps[:-1] - swaps[anchor]) % 2 == 1
    known = ~begin[anchor]
    last = np.where(known, out[np.maximum(anchor - 1, 0)], False)
    return np.where(known, last ^ odd, odd), np.where(known, last ^ odd, ~odd)


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the rows of another split begin."""
    file, start = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column("start").to_numpy()
    begin = np.ones(batch.num_rows, bool)
    begin[1:] = (file[1:] != file[:-1]) | (start[1:] != start[:-1])
    return begin


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out", "into"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, opens, cr of the first line, out, into) of each split; its lines follow one another through the batches."""
    held: dict[tuple, list[bool]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = _runs(batch)
        out, into = _flags(batch)
        from_out, from_in = _states(out, into, begin)
        ends = np.append(np.flatnonzero(begin)[1:], batch.num_rows) - 1
        for b, e in zip(np.flatnonzero(begin), ends):
            key = (batch.column("file")[int(e)].as_py(), batch.column("start")[int(e)].as_py())
            step = [bool(into[e] if state[e] else out[e]) for state in (from_out, from_in)]
            opens, cr, *before = held.get(key, [False, batch.column("cr")[int(b)].as_py(), False, True])
            held[key] = [opens or bool(out[b : e + 1].any()), cr, *(step[1] if inside else step[0] for inside in before)]
    if held:
        names = ["file", "start", "opens", "cr", "out", "into"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*k, *v))) for k, v in held.items()], schema=_SUMMARY)


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("opens", pa.bool_()), ("cr", pa.bool_()), ("out", pa.bool_()), ("into", pa.bool_())])


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, opens, inside, cr): whether a line of the split leaves a quote open (if read from outside one),
    the state the split begins in, and whether its file's lines end in carriage returns. One row per split."""
    steps = lines.select("file", "start", "cr", "out", "into").mapInArrow(_summaries, "file string, start long, opens boolean, cr boolean, out boolean, into boolean")
    steps = staged(steps, "csv-splits")
    order = Window.partitionBy("file").orderBy("start")
    # A split whose end does not depend on its begin settles the state; after it only swaps count.
    swap = (F.col("out") & ~F.col("into")).cast("int")
    steps = steps.withColumn("swaps", F.sum(swap).over(order))
    settled = F.when(F.col("out") == F.col("into"), F.struct(F.col("out"), F.col("swaps")))
    before = F.last(settled, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("known", before).withColumn("earlier", F.col("swaps") - swap)
    odd = (F.col("earlier") - F.coalesce("known.swaps", F.lit(0))) % 2 == 1
    inside = F.coalesce("known.out", F.lit(False)) != odd
    return steps.select("file", "start", "opens", inside.alias("inside"), F.first("cr").over(order).alias("cr"))


_RECORDS = "file string, start long, piece long, cr boolean, first boolean, last boolean, record string"
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("piece", pa.int64()), ("cr", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_()), ("record", pa.string())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, in order. ``first``: the record begins here; ``last``: it ends here."""
    key, inside, held, piece, cr = None, False, [], 0, False

    def flush(last: bool):
        # A piece whose record began in an earlier split is number 0 of its split.
        return {"file": key[0], "start": key[1], "piece": piece, "cr": cr, "first": piece > 0, "last": last, "record": "\n".join(held)}

    for batch in batches:
        rows = []
        begin = _runs(batch)
        out, into = _flags(batch)
        lines = batch.column("line").to_pylist()
        cuts = np.append(np.flatnonzero(begin), batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = (batch.column("file")[int(a)].as_py(), batch.column("start")[int(a)].as_py())
            if own != key:
                if key is not None and held:
                    rows.append(flush(False))
                key, held, inside = own, [], batch.column("inside")[int(a)].as_py()
                piece, cr = (0 if inside else 1), batch.column("cr")[int(a)].as_py()
            run = np.zeros(b - a, bool)
            run[0] = True
            states = _states(out[a:b], into[a:b], run)[1 if inside else 0]
            ends = np.where(states, into[a:b], out[a:b])
            for i, still in enumerate(ends.tolist()):
                held.append(lines[a + i])
                if not still:
                    rows.append(flush(True))
                    held, piece = [], piece + 1
            inside = bool(ends[-1])
        yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)
    if key is not None and held:
        yield pa.RecordBatch.from_pylist([flush(False)], schema=_PIECES)


def records_of(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file, start, piece, record): every record of the files, its line breaks kept; ``piece`` 1 of start 0 is a file's first."""
    states = states.select(F.col("file").alias("f"), F.col("start").alias("s"), "inside", "cr")
    placed = lines.drop("cr").join(F.broadcast(states), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))  # a row per split
    pieces = placed.select("file", "start", "line", "out", "into", "inside", "cr").mapInArrow(_joined, _RECORDS)
    whole = pieces.filter("first AND last").select("file", "start", "piece", "cr", "record")
    # Pieces of records that cross splits: an opening piece, middles and an end, in the order of splits.
    broken = pieces.filter("NOT (first AND last)")
    order = Window.partitionBy("file").orderBy("start", "piece")
    broken = broken.withColumn("record_no", F.sum(F.col("first").cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "piece", "record")))
    mended = broken.groupBy("file", "record_no", "cr").agg(parts.alias("parts"))
    mended = mended.select("file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["piece"].alias("piece"), "cr", F.array_join("parts.record", "\n").alias("record"))
    body = F.regexp_replace("record", "\r$", "")
    # Where a file's lines end in both characters, those inside its records become what Spark's reader makes of them.
    body = F.when(F.col("cr"), F.replace(body, F.lit("\r\n"), F.lit("\n"))).otherwise(body)
    return whole.unionByName(mended).select("file", "start", "piece", body.alias("record"))


def read_quoted(spark: SparkSession, path, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """The rows of CSV files with a header, records with line breaks in quotes whole; many tasks read one file."""
    sep = options.get("sep") or options.get("delimiter") or ","
    own = {**options, "header": "true", "escape": '"', "multiLine": "true"}
    lines = lines_of(spark, path, sep)
    states = staged(split_states(lines), "csv-states")
    if not states.filter("opens").head(1):  # every line is a record, as Spark's reader takes it
        plain = spark.read.options(**{**own, "multiLine": "false"})
        return (plain.schema(schema) if schema is not None else plain).csv(path)
    # Only the first record of one file is read for the names.
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or spark.read.options(**own).csv(path).schema
    told = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in {**options, "escape": '"', "multiLine": "true"}.items() if k != "header"}
    fields = ", ".join(f"{name(f.name)} {f.dataType.simpleString()}" for f in shape)
    records = records_of(lines, states).filter("record <> '' AND NOT (start = 0 AND piece = 1)")
    return records.select(F.from_csv("record", fields, told).alias("row")).select("row.*")
