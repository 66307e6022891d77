"""Session helpers: one place that knows about settings and shared scratch space."""

from __future__ import annotations

import sys
import gc
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Inputs beyond this size have splits enough for all cores.
SMALL_BYTES = 64 * 1024 * 1024

#: How scratch tables are written. Without its native library Hadoop spawns a process for the permissions of each folder and
#: file on a local disk, one more for each checksum file; executors that spawn are counted twice until the child runs its own
#: program. Scratch tables have neither checksum files nor a success marker.
SCRATCH = {
    "compression": "zstd",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}

_local_roots: dict[str, str] = {}


def build_session(app: str = "tabwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_roots.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tabwright-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_root(spark)}/tabwright/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage without relying on executor-local blocks."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**SCRATCH).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Delete what :func:`staged` wrote; the table can't be read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table needs any more, between the rounds of an iteration."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Estimated size of everything a plan reads. Joins do not inflate it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores before costly work on them.

    A small file arrives as one split, however many cores wait. Large inputs have more
    splits than cores and stay as they are.
    """
    size = input_bytes(df)
    if size > SMALL_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 1 + size // (256 * 1024)))


def ship_with_tasks(module: str) -> None:
    """Send a module's functions to Python workers by value: executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
