"""Who was active when, as bitmaps by day: any period's different entities come from unions of its days.

Entities get dense numbers once. A day's entities are bitmaps of 32,768 numbers each, so a
stored day costs at most an eighth of a byte per entity, and weeks, months or any other span of days
are counted without going back to the rows. Numbers of entities that come later follow the known ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions import ordered
from tabwright.operators import columns as C
from tabwright.session import staged


def entity_numbers(df: DataFrame, entity: str, known: DataFrame | None = None) -> DataFrame:
    """(entity, number): numbers from 1 without gaps; those of ``known`` stay and new entities follow."""
    found = df.select(C.col(entity).alias("entity")).filter("entity IS NOT NULL").distinct()
    start = F.lit(0).cast("long")
    if known is not None:
        found = found.join(known.select("entity"), "entity", "left_anti")
        start = F.lit(int(known.agg(F.max("number")).first()[0] or 0))
    new = ordered.running_total(found.withColumn("one", F.lit(1).cast("long")), [], [F.col("entity")], "one", "number", "entities")
    new = new.select("entity", (F.col("number") + start).alias("number"))
    return new if known is None else known.select("entity", "number").unionByName(new)


def daily_bitmaps(df: DataFrame, entity: str, date: str, numbers: DataFrame) -> DataFrame:
    """(day, bucket, bitmap): the numbers of each day's entities. Rows without a date or an entity don't count."""
    active = df.select(C.col(date).cast("date").alias("day"), C.col(entity).alias("entity")).filter("day IS NOT NULL AND entity IS NOT NULL")
    placed = active.distinct().join(numbers, "entity")
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return placed.groupBy("day", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))


def merged_days(*parts: DataFrame) -> DataFrame:
    """Days of several loads together; they must share their numbers."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("day", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def active_entities(days: DataFrame, period: Column, label: str = "period") -> DataFrame:
    """(period, entities): different entities of each period, ``period`` a label made from ``day``."""
    union = days.groupBy(period.alias(label), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return union.groupBy(label).agg(F.sum(F.bitmap_count("bitmap")).alias("entities"))


def returning(days: DataFrame, period: Column, following: Column) -> DataFrame:
    """(period, entities, returned): of a period's entities those also active in the one that ``following`` names.

    Both sets' sizes and that of their union give the size of their overlap.
    """
    own = staged(days.groupBy(period.alias("period"), following.alias("next"), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")), "periods")
    later = own.select(F.col("period").alias("next"), "bucket", F.col("bitmap").alias("later"))
    pairs = own.join(later, ["next", "bucket"], "left")
    both = pairs.select("period", "bucket", "bitmap", "later", F.explode(F.array("bitmap", F.coalesce("later", "bitmap"))).alias("each"))
    union = both.groupBy("period", "bucket", "bitmap", "later").agg(F.bitmap_count(F.bitmap_or_agg("each")).alias("either"))
    here, there = F.bitmap_count("bitmap"), F.bitmap_count("later")
    shared = F.when(F.col("later").isNull(), F.lit(0)).otherwise(here + there - F.col("either"))
    return union.groupBy("period").agg(F.sum(here).alias("entities"), F.sum(shared).alias("returned"))
