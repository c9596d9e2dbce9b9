"""Small text files and folders, by any path that Spark's file systems know."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def qualified(path: str) -> str:
    """The whole path, with its file system."""
    fs, target = _path(SparkSession.active(), path)
    return fs.makeQualified(target).toString()


def exists(path: str) -> bool:
    fs, target = _path(SparkSession.active(), path)
    return fs.exists(target)


def read(path: str) -> str:
    spark = SparkSession.active()
    fs, target = _path(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write(path: str, text: str) -> None:
    """Write a file whole: beside its place first, then renamed into it."""
    spark = SparkSession.active()
    fs, target = _path(spark, path)
    _, beside = _path(spark, path + ".new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} cannot be written")


def remove(path: str) -> None:
    fs, target = _path(SparkSession.active(), path)
    fs.delete(target, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or
    a temporary one where they are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
