"""Streaming forms of the keyed state: windowed progress, deduplicated caches, idempotent ingestion.

Event time needs a timestamp with zone; tables that hold none are cast, with the session in UTC. State is bounded
by the watermark, and a restart goes on from the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.operators.state import upsert
from scholium.sources import generations


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of events."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_progress(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events per task and tumbling window; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """The first event of each key; a key may come again after ``ttl``."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Replay charges in order of arrival: one that does not fit costs nothing."""
    spent, accepted, ceiling = state.get if state.exists else (0, 0, None)
    rows = pd.concat(list(batches)).sort_values("event_id")
    for cost, limit in zip(rows["cost"], rows["ceiling"]):
        if spent + cost <= limit:
            spent, accepted = spent + int(cost), accepted + 1
        ceiling = int(limit)
    state.update((spent, accepted, ceiling or 0))
    yield pd.DataFrame({"budget": [key[0]], "spent": [spent], "accepted": [accepted]})


def budget(charges: DataFrame) -> DataFrame:
    """Running spend per budget as updates, by custom state."""
    return charges.groupBy("budget").applyInPandasWithState(
        _fold, "budget long, spent long, accepted long", "spent long, accepted long, ceiling long", "update", "NoTimeout"
    )


BUCKETS = 32


def upsert_sink(path: str, keys: list[str], seq: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that folds each batch into a table by key.

    The table is cut into buckets by a hash of the key; a batch rewrites the buckets it touches, each from its last
    state of a smaller batch number, so a replay writes the same states again and nothing is counted twice. Of each
    bucket the last two states stay.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # ``buckets`` rows at most
        states = _states(spark, path, epoch)
        older = [f"{path}/epoch={states[b][-1]}/_bucket={b}" for b in touched if b in states]
        if older:
            kept = spark.read.schema(batch.schema).option("basePath", path).parquet(*older)
            kept = kept.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            rows = rows.unionByName(kept.select(rows.columns))
        new = upsert(rows, ["_bucket", *keys], seq).select(*batch.columns, "_bucket").repartition("_bucket")
        new.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/epoch={epoch}")
        held.unpersist()
        for b in touched & states.keys():
            for old in states[b][:-1]:
                generations.delete(spark, f"{path}/epoch={old}/_bucket={b}")

    return write


def _states(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """Numbers of the batches that hold each bucket, in order, of whole batches before the given one."""
    out: dict[int, list[int]] = {}
    for epoch in generations.children(spark, path, "epoch"):
        if (before is None or epoch < before) and generations.exists(spark, f"{path}/epoch={epoch}/_SUCCESS"):
            for bucket in generations.children(spark, f"{path}/epoch={epoch}", "_bucket"):
                out.setdefault(bucket, []).append(epoch)
    return out


def read_generation(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_sink`` wrote: the last state of each bucket."""
    folders = [f"{path}/epoch={epochs[-1]}/_bucket={b}" for b, epochs in _states(spark, path).items()]
    return spark.read.parquet(*folders)
