"""JSON-lines scans and sinks, staged so that readers never see a part of a file set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON-lines files under an explicit schema; a line that isn't such an object fails the scan."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def replace_jsonl(df: DataFrame, path: str) -> None:
    """Write df beside `path`, then put it in the path's place by renaming in the same file system."""
    _replace(df, path, lambda writer, to: writer.json(to))


def replace_parquet(df: DataFrame, path: str) -> None:
    _replace(df, path, lambda writer, to: writer.parquet(to))


def _replace(df: DataFrame, path: str, write) -> None:
    context = df.sparkSession.sparkContext
    staged, old = (f"{path.rstrip('/')}.{tag}-{uuid.uuid4().hex}" for tag in ("staged", "old"))
    write(df.write, staged)
    jvm = context._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(context._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"can't put {staged} in the place of {path}")
    fs.delete(at(old), True)


def complete_or_fail(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """df, if it holds every wanted key; else an error that names some of the missing ones."""
    missing = wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"missing: {[r[0] for r in missing]}")
    return df
