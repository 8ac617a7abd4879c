"""Files of any store: on executors by pyarrow, on the driver by Hadoop's file systems."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path as Spark understands it, not encoded."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder or file, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
