"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a seeded shuffle, pass after pass. A document's virtual
finish time is the words its source has queued up to and with it, divided by the source's
target. Documents are served in the order of that time over all sources and the queue is cut
at the total budget, which is virtual time 1; a document that is being served then gives the
words it has served. So every source ends within one word of its target.

Everything is DataFrame work on narrow rows; texts are read once and not shuffled.
Nulls: a null text has no words, null is a source of its own (sorted last). Repeated rows queue
one by one. A source without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.llm.ranking import bucket_count, key_bucket, running, shuffled_key
from tabwright.session import staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: str, words: str) -> Column:
    """The text up to the end of its n-th word, n a column."""
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int")), "")


def source_targets(sizes: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """Words each source should give: shares by weight, none above ``repeats`` times its own words.

    One row per source goes through one window task, never a row per document. Sources reach
    their limit in the order of limit by weight, so the level all others share is a running sum.
    """
    weight = F.expr(f"element_at(array({', '.join(map(str, map(float, weights)))}), 1 + int((n - 1) % {len(weights)}))")
    named = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    fill = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = sizes.withColumn("n", F.row_number().over(named)).withColumn("weight", weight)
    t = t.withColumn("limit", F.col("source_size") * repeats).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    sharing = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / sharing)
    # All above this source in the order can take the level, so none of them reaches its limit.
    t = t.withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
    t = t.withColumn("level", F.min("open").over(whole)["level"])
    target = F.least(F.col("weight") * F.coalesce("level", F.lit(0.0)), F.col("limit").cast("double"))
    return t.select(F.col("source").alias("of"), "source_size", target.alias("target"))


def fair_queue(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    repeats: int = 3,
    seed: int = 23,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, served). ``row`` is a column that tells input rows apart, else they are numbered.

    documents: row (a number for each input row), id, source, size, source_size, target.
    served: row, pass, taken (words), finish (virtual time), through (words served so far), in which
    ``finish`` orders the mix.
    """
    narrow = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(id).alias("id"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        shuffled_key(seed, id).alias("key"),
    )
    rows = staged(narrow, "mix-rows")
    n = rows.count()
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    targets = staged(targets, "mix-targets")
    queued = running(rows, ["source"], key_bucket("key", bucket_count(n)), ["key", "id", "size"], {"end": "size"})
    queued = staged(
        queued.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of", "key", "end_all"), "mix-queue"
    )
    served = (
        queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("end", F.col("end") + F.col("pass") * F.col("source_size"))
        .withColumn("begin", F.col("end") - F.col("size"))
        .filter("size > 0 AND begin < target")
        .withColumn("taken", F.floor(F.least(F.col("end").cast("double"), F.col("target")) - F.col("begin")))
        .withColumn("finish", F.least(F.col("end").cast("double"), F.col("target")) / F.col("target"))
        .filter("taken > 0")
        .select("row", "source", "pass", "size", "taken", "finish")
    )
    buckets = bucket_count(repeats * n)
    slot = F.least(F.floor(F.col("finish") * buckets), F.lit(buckets - 1))
    order = ["finish", F.col("source").asc_nulls_last(), "pass", "row"]
    served = running(served, [], slot, order, {"through": "taken"})
    budget = rows.agg(F.sum("size")).first()[0] or 0
    served = served.filter(F.col("through") <= budget).drop("through_all")
    return queued.drop("end"), served
