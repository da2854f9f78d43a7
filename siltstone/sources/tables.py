"""Scans of the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `order`, nulls counting as least.

    Repeated rows collapse; ties in `order` go to the greatest value of `keep`, so the result doesn't depend on
    partitioning. Rows with a null key are dropped. The maximum is taken per partition before the shuffle, so a
    key that holds a third of all rows costs one row per partition.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    best = df.groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._k{i}").alias(c) for i, c in enumerate(keep)])
