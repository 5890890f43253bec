"""The two file operations Spark's readers and writers do not offer: a rename
that never replaces, and removing a folder. Both go through the session's
Hadoop file system, so any shared store the cluster mounts will do."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = hadoop.FileContext.getFileContext(at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri())
    return files, at, hadoop


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False, with nothing changed, if ``target`` exists."""
    files, at, hadoop = _context(spark, source)
    no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        files.rename(at, hadoop.Path(target), no_options)
    except Py4JJavaError:
        if files.util().exists(hadoop.Path(target)):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds, if it is there."""
    files, at, _ = _context(spark, path)
    if files.util().exists(at):
        files.delete(at, True)
