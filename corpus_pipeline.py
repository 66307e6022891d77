"""From raw documents to packed sequences: five stages, each a Spark job over all its predecessor kept.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last
return the columns of documents. A stage's result is written and read again before the next.
Rows without an id pass the near-duplicate and substring stages untouched, and rows that share an id are
judged each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.llm import jaccard, mixing, packing, substrings, toxicity
from tabwright.llm.queries import tokenizer_file
from tabwright.session import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold of their language."""
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score_documents(docs, model, keep=docs.columns, score="__score")
    return scored.filter(F.col("__score") < toxicity.threshold_of(F.col("lang"), model)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id and, for one id, the smallest hash of its text.

    Rows without an id or without words are in no group. Of rows equal in id and text one stays.
    """
    rows = staged(jaccard.near_rows(docs).filter("doc_id IS NOT NULL"), "near-rows")
    removed = rows.groupBy("doc_id").agg(F.bool_or("keeper").alias("some"), F.bool_and("keeper").alias("all"))
    # Ids that lose all their rows go by id alone; only ids that share texts and lose some are looked up by text.
    gone = staged(removed.filter("NOT some").select("doc_id"), "near-duplicates")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    mixed = removed.filter("some AND NOT all").select("doc_id")
    judged = rows.join(mixed.withColumn("part", F.lit(True)), "doc_id", "left").groupBy("doc_id", "text_hash")
    judged = judged.agg(F.first("keeper").alias("__keeper"), F.max("n_links").alias("links"), F.count("*").alias("n"), F.first("part").alias("part"))
    judged = judged.filter("(part AND NOT __keeper) OR (__keeper AND n > 1 AND links > 0)")
    judged = staged(judged.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__keeper"), "judged-texts")
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = kept.join(judged, same, "left")
    single = kept.filter("__keeper IS NULL")
    again = kept.filter("__keeper").dropDuplicates(["__id", "__hash"])
    return single.unionByName(again).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; those with nothing left go."""
    cut = substrings.deduplicated(docs).filter("copy OR n_removed > 0")
    cut = cut.select("doc_id", F.col("digest").alias("__digest"), "kept_text", (F.col("n_removed") == F.col("n_words")).alias("__gone"))
    cut = staged(cut.dropDuplicates(["doc_id", "__digest"]).withColumnRenamed("kept_text", "__kept"), "cut-documents")
    out = docs.withColumn("__digest", substrings.digest_of("text")).join(cut, ["doc_id", "__digest"], "left")
    out = out.filter(~F.coalesce("__gone", F.lit(False)))
    return _with_text(out, F.coalesce("__kept", "text"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix in the order of its virtual finish times: a row for each time a document is taken, its text cut where
    its source's target ends."""
    numbered = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    _, served = mixing.fair_queue(numbered, row=F.col("__row"))
    taken = served.select(F.col("row").alias("__row"), *[F.col(c).alias(f"__{c}") for c in ("size", "taken", "finish", "pass")])
    out = numbered.join(staged(taken, "served"), "__row")
    text = F.when(F.col("__taken") < F.col("__size"), mixing.first_words("text", "__taken")).otherwise(F.col("text"))
    return _with_text(out.orderBy("__finish", "__row", "__pass"), text, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences, neighbours along the curve together."""
    return packing.pack_documents(docs, tokenizer_file(), with_ids=True)


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of documents with another text and its length."""
    docs = docs.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
