"""Where intermediate files go, a folder that all machines share; and in how many partitions rows go there."""

from __future__ import annotations

import gc
import math
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a partition that a task groups, sorts and joins in memory.
ROWS = 1 << 18


def enough_partitions(stored: DataFrame, factor: float = 1.0) -> int:
    """Partitions for ``factor`` times the rows of a stored table, which its files count: ``ROWS`` each, and no fewer than Spark's setting."""
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(stored.count() * factor / ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or beside the warehouse; it goes when the application ends.

    The warehouse may be a folder of one machine, so it serves only where there is one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared}/{name}-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)  # only existing paths can be marked
    return f"{folder.toString()}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that what reads it several times computes it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove the files of a table that ``cut`` made."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffles of DataFrames that are no longer held: its cleaner acts on what both collectors have found."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
