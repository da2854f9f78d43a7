"""Filling containers of fixed capacity: best-fit over the histogram of lengths, then documents take the slots.

The plan is made from counts per length, of which there are at most `capacity`, so it is made on the driver
whatever the number of documents. Items then find their slot by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.encoding import count_tokens
from siltstone.session import cut

CAPACITY = 2048
#: Items of one length that one task ranks.
RANKED = 50_000


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over counts: ([(length, first rank, items per container, first container)], containers).

    The items of one length take ranks 0, 1, ...; those from a row's first rank on go, `items per container` at a
    time, to consecutive containers from its first container on, up to the next row of that length. Containers
    alike are one group: placing a length either uses a group up or the length, so the groups stay few.
    """
    groups: dict[int, list[list[int]]] = {}  # room -> [first container, containers]
    rooms: list[int] = []
    plan: list[tuple[int, int, int, int]] = []
    made = 0

    def add(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append([first, many])

    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    plan.append((length, rank, each, made))
                    add(capacity - each * length, made, full)
                    made, rank = made + full, rank + full * each
                if rest:
                    plan.append((length, rank, rest, made))
                    add(capacity - rest * length, made, 1)
                    made, rank = made + 1, rank + rest
                left = 0
                continue
            room = rooms[at]
            first, many = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // length
            whole = min(many, left // each)
            if whole:
                plan.append((length, rank, each, first))
                add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
                add(room, first + whole, many - whole)
            else:
                plan.append((length, rank, left, first))
                add(room - left * length, first, 1)
                add(room, first + 1, many - 1)
                rank, left = rank + left, 0
    return plan, made


def cut_items(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length): one item per document, or several where it exceeds the capacity.

    Only the pieces of a divided document have a piece number above 0; all but its last are of full capacity.
    """
    pieces = F.when(F.col("n_tokens") > capacity, F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    items = sizes.select(key, "n_tokens", F.explode(pieces).alias("piece"))
    start = F.col("piece") * capacity
    return items.select(key, "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("length"))


def pack_items(items: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, container): every item with its container; an item of length 0 has none (null).

    `items` is read more than once and should be cheap to read. (key, piece) tells items apart; repeated items are
    all packed. An empty table gives an empty result.
    """
    counts = {int(r[0]): int(r[1]) for r in items.filter("length > 0").groupBy("length").count().collect()}  # at most `capacity` rows
    plan, _ = plan_containers(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // RANKED))
    spread = items.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    # Rank within a length: within (length, bucket), plus what the buckets before hold. A length that a third of all
    # items have is ranked in many tasks.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = spread.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(key, "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "bucket"]).withColumn("rank", (F.col("place") + F.col("offset")).cast("long"))
    table = np.array(sorted(plan), np.int64).reshape(-1, 4)
    stride = np.int64(1) << 40
    starts = table[:, 0] * stride + table[:, 1]

    @F.pandas_udf("long")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        own, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(starts):
            return pd.Series([None] * len(length), dtype="Int64")
        row = np.maximum(np.searchsorted(starts, own * stride + at, "right") - 1, 0)
        found = table[row, 3] + (at - table[row, 1]) // table[row, 2]
        return pd.Series(found, dtype="Int64").where(pd.Series(own > 0))

    return ranked.select(key, "piece", "start", "length", container("length", "rank").alias("container"))


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pack the whole texts, measured in tokens of a public tokenizer, into containers of `capacity` tokens.

    Null and empty texts have no tokens and no container. Only a text longer than the capacity is divided.
    """
    items = cut(cut_items(count_tokens(documents, key, text, path), key, capacity))
    return pack_items(items, key, capacity)


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused, fewest): one row; `fewest` is the number below which no packing can be."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum(F.lit(capacity) - F.col("used")), F.lit(0)).cast("long").alias("unused"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).cast("long").alias("fewest"),
    )
