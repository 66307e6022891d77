"""Stored tables and their append-only metadata (reports, mappings, query log)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwright.functions import mentions
from tabwright.operators import sketches
from tabwright.session import shared_root, spread, staged

RAW_SUFFIX = "__raw"
WORKING_VIEW = "user_data"


# --- logic on plain DataFrames ---------------------------------------------------


def next_versions(reports: DataFrame) -> DataFrame:
    """Per table the version its next report gets."""
    return reports.groupBy("table_name").agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version")
    )


def append_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (table_name, report) rows numbered after what is stored; one report per table."""
    numbered = incoming.join(next_versions(existing), "table_name", "left")
    return numbered.select(
        "table_name", F.coalesce("version", F.lit(1)).cast("int").alias("version"),
        *[c for c in incoming.columns if c != "table_name"],
    )


def report_get(reports: DataFrame, version: int | None = None) -> DataFrame:
    """The given version per table, or the latest. An aggregate, so no group is ever gathered."""
    if version is not None:
        return reports.filter(F.col("version") == version)
    return latest_per_key(reports, ["table_name"], "version")


def latest_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The row with the greatest order value for every key; combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else order[0])
    return df.groupBy(*keys).agg(newest.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def report_summaries(tables: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per user table, newest load first; tables without a report get defaults.

    ``tables``: (table_name, loaded_at). ``reports``: (table_name, version, rows_clean,
    domain, clean_score).
    """
    user = tables.filter(~F.col("table_name").startswith("_") & ~F.col("table_name").endswith(RAW_SUFFIX))
    found = user.join(report_get(reports), "table_name", "left")
    return found.select(
        "table_name",
        F.coalesce("version", F.lit(1)).alias("version"),
        F.coalesce("rows_clean", F.lit(0)).alias("rows_clean"),
        F.coalesce("domain", F.lit("Unknown")).alias("domain"),
        F.coalesce("clean_score", F.lit(0)).alias("clean_score"),
        "loaded_at",
    ).orderBy(F.desc_nulls_last("loaded_at"), "table_name")


def query_log_latest(log: DataFrame) -> DataFrame:
    """Latest (question, intent, sql) per question of an append-only log."""
    return latest_per_key(log, ["question"], "logged_at", "intent", "sql")


def query_log_lookup(log: DataFrame, entities: list[str], k: int = 5) -> DataFrame:
    """The first k questions, by text, that mention any of the entities."""
    mentions = F.lit(False)
    for entity in entities:
        mentions = mentions | F.col("question").contains(entity)
    return log.filter(mentions).orderBy("question").limit(k)


def query_log_search(log: DataFrame, entities: DataFrame) -> DataFrame:
    """The different questions of a log that mention any of the entities (a column entity), however many there are.

    Each question is cut into its pieces as long as the entities are, those that a filter of the entities' hashes
    lets through are joined with them, so no question is ever paired with an entity it does not hold.
    Empty and null entities match nothing.
    """
    questions = log.select("question").filter("question <> ''").distinct()
    numbered = staged(questions.select("question", F.monotonically_increasing_id().alias("id")), "questions")
    asked = staged(entities.select("entity").filter("entity <> ''").distinct(), "entities")
    lengths = sorted(r[0] for r in asked.select(F.length("entity")).distinct().collect())
    if not lengths:
        return numbered.select("question").limit(0)
    pieces = spread(numbered.select("id", "question")).mapInArrow(mentions.pieces(mentions.entity_filter(asked), lengths), "id long, piece string")
    found = pieces.join(asked, F.col("piece") == F.col("entity")).select("id").distinct()
    return numbered.join(found, "id", "left_semi").select("question")


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, position, attribute, dtype, row_count) over several tables."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("position"), F.lit(c).alias("attribute"), F.lit(t).alias("dtype"))
                        for i, (c, t) in enumerate(df.dtypes)
                    ]
                )
            ),
            "row_count",
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def export_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON record; missing values are written as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


# --- storage ---------------------------------------------------------------------


class Files:
    """Small files of a store, by the file system its path names."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _open(self, path: str):
        path = self._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self._conf), path

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none where there is no such folder."""
        system, path = self._open(folder)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def move_parts(self, source: str, target: str) -> None:
        """Move the part files of a written table, whose names nobody else uses, into another folder."""
        system, into = self._open(target)
        system.mkdirs(into)
        for part in self.names(source):
            if part.startswith("part-") and not system.rename(self._open(f"{source}/{part}")[1], self._open(f"{target}/{part}")[1]):
                raise OSError(f"{source}/{part} was not moved to {target}")
        system.delete(self._open(source)[1], True)

    def create(self, path: str) -> bool:
        """Create an empty file; false if it is there already. Of several callers one is told true."""
        system, path = self._open(path)
        system.mkdirs(path.getParent())
        plain = system.makeQualified(path).toUri()
        if plain.getScheme() == "file":  # Hadoop's own create first looks and then creates
            return bool(self._jvm.java.io.File(plain.getPath()).createNewFile())
        try:
            system.create(path, False).close()
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True


class Store:
    """Parquet tables below one shared folder. Every write goes to a path of its own or appends."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_root(spark)}/tabwright/store").rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, mode: str = "overwrite", **options) -> DataFrame:
        df.write.mode(mode).options(**options).parquet(self._path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def write_raw(self, name: str, raw: DataFrame) -> DataFrame:
        """Store the untouched twin; everything after reads it instead of the source."""
        return self.write(name + RAW_SUFFIX, raw)

    def write_clean(self, name: str, clean: DataFrame) -> DataFrame:
        """Store the clean table and make it the working view."""
        stored = self.write(name, clean)
        stored.createOrReplaceTempView(name)
        stored.createOrReplaceTempView(WORKING_VIEW)
        return stored

    def append(self, log: str, df: DataFrame) -> None:
        """Add rows to a log. They are written to a folder of their own first: jobs that write to one folder at the same
        time share Spark's temporary files there, and the first to end deletes them."""
        own = self._path(f"_appends/{uuid.uuid4().hex}")
        df.withColumn("logged_at", F.current_timestamp()).write.parquet(own)
        Files(self.spark).move_parts(own, self._path(log))

    def read_log(self, log: str, like: DataFrame | None = None) -> DataFrame:
        """The log, or an empty one of the given shape when nothing was written yet."""
        try:
            return self.spark.read.parquet(self._path(log))
        except Exception as error:
            if like is None or "PATH_NOT_FOUND" not in str(error):
                raise
            return like.limit(0).withColumn("logged_at", F.current_timestamp())

    def save_metadata(self, table: str, report: DataFrame, mapping: Mapping[str, str]) -> None:
        """Cleaning report and column mapping of a table; reading takes the newest."""
        named = F.lit(table).alias("table_name")
        self.append("_cleaning_reports", report.select(named, F.to_json(F.struct(*report.columns)).alias("report")))
        pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        self.append("_column_mappings", self.spark.range(1).select(named, pairs.alias("mapping")))

    def metadata(self, log: str) -> DataFrame:
        return latest_per_key(self.read_log(log), ["table_name"], "logged_at")

    def append_report(self, reports: DataFrame) -> None:
        """Number and append (table_name, ...) report rows.

        Each number is claimed in the store before a report with it is written, so two writers never share one;
        a writer that dies between the two leaves a number without a report.
        """
        claimed = [(name, self.claim_version(name)) for name in sorted(r[0] for r in reports.select("table_name").distinct().collect())]
        numbers = self.spark.createDataFrame(claimed, "table_name string, version int")
        self.append("_dataset_reports", reports.join(F.broadcast(numbers), "table_name"))  # a row per reported table

    def claim_version(self, table: str) -> int:
        """The next version number of a table, taken by creating a file that nobody else can create as well."""
        folder = f"{self._path('_claims')}/{hashlib.md5(table.encode()).hexdigest()}"
        files = Files(self.spark)
        version = max([int(n) for n in files.names(folder) if n.isdigit()], default=0)
        if not version:  # reports from before the first claim
            like = self.spark.createDataFrame([], "table_name string, version int")
            last = self.read_log("_dataset_reports", like).filter(F.col("table_name") == table).agg(F.max("version")).first()[0]
            version = int(last or 0)
        while not files.create(f"{folder}/{(version := version + 1)}"):
            pass
        return version

    def append_sketches(self, table: str, part: DataFrame) -> int:
        """Sketch a new part of a table and store it; returns the version it was given."""
        version = self.claim_version(f"{table}/sketches")
        named = sketches.sketch_table(part).select(F.lit(table).alias("table_name"), F.lit(version).alias("version"), *sketches.COLUMNS)
        self.append("_column_sketches", named)
        return version

    def sketched_profile(self, table: str, versions: Sequence[int] | None = None, k: int = 5) -> DataFrame:
        """The profile of all parts of a table (or of some versions) from their stored sketches; no part is read again."""
        stored = self.read_log("_column_sketches").filter(F.col("table_name") == table)
        if versions is not None:
            stored = stored.filter(F.col("version").isin(list(versions)))
        return sketches.read_sketches(sketches.merge_sketches(stored.select(*sketches.COLUMNS)), k)
