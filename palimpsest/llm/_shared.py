"""Helpers shared by the operators: the shared folder, table access and per-batch column access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
#: Words of the contracts, as a Java regular expression: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of this machine only if that is unset and
    Spark runs on this machine alone."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        root = sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends at files that survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of stages whose results are already written, before the next begin.

    The cleaner learns of them from the JVM's collector, and that from Python's, each a moment later.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of BATCH_ROWS rows, unless the session has a bound of its own: texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def held_out(name: str = "doc_id") -> Column:
    """True for rows whose labels are never learnt from."""
    return (F.crc32(F.col(name).cast("string")) % 3) == 1


def trimmed() -> None:
    """Give memory that this worker has freed back to the system, as far as its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What one operator keeps in a worker process from task to task.
KEPT: dict = {}


def kept(name, make):
    """The memo of this name in this worker, made if need be. Only the last operator's stays, so that an executor that
    runs one operator after the other doesn't hold the memos of all."""
    if name not in KEPT:
        if KEPT:
            KEPT.clear()
            trimmed()
        KEPT[name] = make()
    return KEPT[name]
