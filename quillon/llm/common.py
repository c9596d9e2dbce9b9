"""What the operators share: table access, the shared folder, ASCII folding."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Where it is unset a temporary one is set, if driver and
    executors are one process (a local test), and else it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Spark's own file system layer."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone when the driver ends
        return


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, for Spark to remove the shuffle files of plans that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the
    lineage, and survives lost executors. Shuffle files of earlier steps are of
    no more use then; the driver's garbage collection, before a new step, lets
    Spark remove them."""
    spark = df.sparkSession
    path = scratch(spark, label)
    tidy(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove what ``materialize`` has written for these, which nothing reads any more."""
    for df in frames:
        discard(df.sparkSession, df._scratch)


def give_back() -> None:
    """In a worker process at the end of a task: hand free memory back to the
    system, as the process waits for other tasks, of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Text of ASCII alone takes the fast way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
