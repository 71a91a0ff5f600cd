"""Numbered folders as commits: a folder counts once its writer has set the end mark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def finished(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Names of the finished folders ``<kind>-<number>`` in order of their numbers, and the next free number.

    A folder that a crash left without an end mark keeps its number and is not read.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return [], 0
    names = sorted((s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()), key=number)
    done = [n for n in names if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return done, 1 + max(map(number, names), default=-1)


def number(name: str) -> int:
    return int(name.rsplit("-", 1)[1])
