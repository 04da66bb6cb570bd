"""Numbered generations of stored tables: a failed write is never seen, and old ones go."""

from __future__ import annotations

from pyspark.sql import SparkSession

COMPLETE = "_COMPLETE"


def file_system(spark: SparkSession, folder: str):
    """(file system, path) of a folder, by Hadoop's own classes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def children(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers n of the sub-folders ``prefix=n``, in order."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def complete(spark: SparkSession, folder: str) -> list[int]:
    """The generations that were written to the end."""
    return [n for n in children(spark, folder, "generation") if exists(spark, f"{folder}/generation={n}/{COMPLETE}")]


def commit(spark: SparkSession, folder: str, generation: int, keep: int = 2) -> None:
    """Mark a generation as whole, and delete all but the last ``keep`` whole ones."""
    fs, path = file_system(spark, f"{folder}/generation={generation}/{COMPLETE}")
    fs.create(path, True).close()
    for old in complete(spark, folder)[:-keep]:
        delete(spark, f"{folder}/generation={old}")
