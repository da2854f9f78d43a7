"""Incremental paths as streams: turns become memories, each micro-batch a new version of the table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import memory
from siltstone.session import shared_root


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def merge_memories(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known memories with fresh ones merged in: first id and time, greatest importance, last update, counts added."""
    both = known.unionByName(fresh)
    return both.groupBy("namespace", "content_hash").agg(
        F.min(F.struct("created_at", "id")).alias("first"), F.max("importance").alias("importance"), F.max("updated_at").alias("updated_at"), F.min("kind").alias("kind"), F.min("content").alias("content"), F.sum("times").alias("times")
    ).select("namespace", "content_hash", F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at"), "importance", "updated_at", "kind", "content", "times")


def versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of the table, in order; one that is still written, or was given up, isn't complete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and _exists(spark, f"{target}/{n}/_SUCCESS"))


def read_memories(spark: SparkSession, target: str) -> DataFrame:
    """The latest complete version of the table."""
    return spark.read.parquet(f"{target}/v{versions(spark, target)[-1]}")


def stream_memories(spark: SparkSession, turns_path: str, target: str, checkpoint: str) -> None:
    """Read what is new under turns_path, extract memories and merge them into the table at target.

    A batch is written as the version of its number; its commit - the marker of the finished job - is both the data
    and the note that the batch is in, so a batch repeated after a failure finds itself done or starts afresh, and
    readers never see a part. A turn delivered again in the same batch counts once. The last two versions are kept.
    """
    schema = spark.read.parquet(turns_path).schema

    def apply(batch: DataFrame, number: int) -> None:
        done = versions(spark, target)
        if done and done[-1] >= number:
            return
        fresh = memory.upsert(memory.extract_memories(batch.dropDuplicates(["id"])))
        merged = merge_memories(spark.read.parquet(f"{target}/v{done[-1]}"), fresh) if done else fresh
        merged.write.mode("overwrite").parquet(f"{target}/v{number}")
        jvm = spark.sparkContext._jvm
        for old in done[:-1]:
            at = jvm.org.apache.hadoop.fs.Path(f"{target}/v{old}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    # A file source watches folders or patterns; a single file is watched as a pattern that only it matches.
    watched = turns_path if _is_folder(spark, turns_path) else turns_path[:-1] + f"[{turns_path[-1]}]"
    query = spark.readStream.schema(schema).parquet(watched).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, value): tumbling windows with a watermark; works on streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the session's shared folder."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")
