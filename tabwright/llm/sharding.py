"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded key within their source, ranked there, and put in the order of
their fractional rank ``(2 rank - 1) / (2 rows of the source)``. Any stretch of that order
holds every source in its share, so cutting it into equal stretches gives shards that match
the mixture. All of it is DataFrame work on narrow rows: texts are read once and not shuffled.

Nulls: a null text has no bytes, a null source is a source of its own, null ids are shuffled
together. Repeated rows each take a place. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.llm.ranking import bucket_count, key_bucket, running, shuffled_key
from tabwright.session import staged


def stratified_shards(
    docs: DataFrame, shards: int, seed: int = 17, id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """One row per document: id, source, size (UTF-8 bytes + 1), text_crc32, shard, slot (0, 1, ... in its shard)."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id).alias("id"),
        F.col(source).alias("source"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shuffled_key(seed, id).alias("key"),
        F.lit(1).alias("one"),
    )
    rows = staged(narrow, "shard-rows")
    n = rows.count()
    buckets = bucket_count(n)
    ranked = running(
        rows, ["source"], key_bucket("key", buckets), ["key", "size", "text_crc32"], {"rank": "one"}
    )
    odd = 2 * F.col("rank") - 1
    ranked = staged(
        ranked.withColumn("place", odd / F.col("rank_all"))
        .withColumn("stretch", F.floor(odd * buckets / (2 * F.col("rank_all"))).cast("long")),
        "shard-ranks",
    )
    order = ["place", "source", "key", "size", "text_crc32"]
    placed = running(ranked.drop("rank", "rank_all"), [], F.col("stretch"), order, {"at": "one"})
    at = F.col("at") - 1
    shard = F.expr(f"int(((at - 1) * {shards}L) div {max(n, 1)}L)")
    return placed.select("id", "source", "size", "text_crc32", shard.alias("shard"), at.alias("at")).select(
        F.col("id").alias(id),
        F.col("source").alias(source),
        "size",
        "text_crc32",
        "shard",
        F.expr(f"at - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"),
    )
