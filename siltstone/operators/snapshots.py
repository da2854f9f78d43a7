"""What changed between full snapshots: persistent ordinals, compressed bitmaps and ordinal-aligned columns.

Keys are spread over blocks by hash. Within a block every key has an ordinal that it keeps for good: a table of
ordinals from an earlier run can be handed in, new keys are appended after the ones known. A snapshot is a bitmap
over a block's ordinals, held as runs or as packed bits, whichever is smaller; `next AND NOT previous` gives what
was added, the reverse what was removed. Among the keys in both, the ordinal-aligned vectors of content hashes are
compared. A block holds a bounded number of keys, so no task grows with the data; the number of blocks does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.files import exists, replace_parquet
from siltstone.sources.tables import latest

#: States (keys times versions) that one block holds, so that neither more keys nor more deliveries make tasks grow.
BLOCK_STATES = 160_000


def pack_bits(ordinals: np.ndarray, size: int) -> tuple[str, np.ndarray]:
    """A bitmap over 0..size-1 as ('runs', starts and lengths) or ('bits', packed), whichever is smaller."""
    ordinals = np.unique(ordinals)
    if not len(ordinals):
        return "runs", np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(ordinals) != 1)
    starts = ordinals[np.r_[0, breaks + 1]]
    ends = ordinals[np.r_[breaks, len(ordinals) - 1]]
    if len(starts) * 16 <= (size + 7) // 8:
        return "runs", np.stack([starts, ends - starts + 1], 1)
    bits = np.zeros(size, bool)
    bits[ordinals] = True
    return "bits", np.packbits(bits)


Bitmap = tuple[str, np.ndarray]
NOTHING: Bitmap = ("runs", np.zeros((0, 2), np.int64))


def words(bitmap: Bitmap, size: int) -> np.ndarray:
    """The packed bits of a bitmap; the few runs of one held as runs are written into them."""
    kind, data = bitmap
    if kind == "bits":
        return data
    packed = np.zeros((size + 7) // 8, np.uint8)
    for start, length in data:
        first, last = start >> 3, (start + length - 1) >> 3
        head, tail = 0xFF >> (start & 7), (0xFF << (7 - ((start + length - 1) & 7))) & 0xFF
        if first == last:
            packed[first] |= head & tail
        else:
            packed[first] |= head
            packed[first + 1 : last] = 0xFF
            packed[last] |= tail
    return packed


def _sweep(a: np.ndarray, b: np.ndarray, wanted) -> Bitmap:
    """The runs where wanted(in a, in b) holds, from the ends of the runs of both alone."""
    edges = np.unique(np.concatenate([a[:, 0], a.sum(1), b[:, 0], b.sum(1)]))
    if not len(edges):
        return NOTHING
    inside = [np.searchsorted(r[:, 0], edges, "right") > np.searchsorted(r.sum(1), edges, "right") for r in (a, b)]
    held = wanted(*inside)[:-1]
    return "runs", np.stack([edges[:-1][held], np.diff(edges)[held]], 1)


def and_not(a: Bitmap, b: Bitmap, size: int) -> Bitmap:
    """What is in a and not in b, without unpacking either: run by run, or word by word."""
    if a[0] == b[0] == "runs":
        return _sweep(a[1], b[1], lambda x, y: x & ~y)
    return "bits", words(a, size) & ~words(b, size)


def in_both(a: Bitmap, b: Bitmap, size: int) -> Bitmap:
    if a[0] == b[0] == "runs":
        return _sweep(a[1], b[1], lambda x, y: x & y)
    return "bits", words(a, size) & words(b, size)


def ordinals_of(bitmap: Bitmap, size: int) -> np.ndarray:
    """The ordinals that a bitmap holds, in order."""
    kind, data = bitmap
    if kind == "bits":
        return np.flatnonzero(np.unpackbits(data, count=size))
    return np.concatenate([np.arange(s, s + n) for s, n in data]) if len(data) else np.zeros(0, np.int64)


def normal_hash(column: str = "text_hash"):
    """Hashes are equal but for letter case, outer blanks and a label of the hash function; blank counts as null."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))), r"^(sha-?(1|224|256|384|512)|md5|blake2[bs]?|xxh\d*)\s*[:=]\s*", "")
    return F.when(bare != "", bare)


def snapshot_states(df: DataFrame) -> DataFrame:
    """(version_no, key, hash, source_id): one row per chunk and version, the latest loaded one.

    Outer blanks of chunk_id don't count; rows without version_no or chunk_id (or with a blank one) are no state.
    """
    clean = df.select(
        "version_no",
        F.regexp_replace("chunk_id", r"^\s+|\s+$", "").alias("key"),
        "loaded_at",
        normal_hash().alias("hash"),
        "source_id",
    ).filter((F.col("key") != "") & F.col("version_no").isNotNull())
    return latest(clean, ["version_no", "key"], ["loaded_at"], ["hash", "source_id"])


def assign_ordinals(keys: DataFrame, blocks: int, known: DataFrame | None = None) -> DataFrame:
    """(key, block, ordinal) for every distinct key: known keys keep theirs, others follow in key order.

    `known` is an earlier result with the same number of blocks. The ranking runs within a block of bounded size.
    """
    found = keys.select("key").distinct().withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    if known is not None:
        ends = known.groupBy("block").agg(F.max("ordinal").alias("end"))
        found = found.join(known.select("key", F.col("ordinal").alias("kept")), "key", "left").join(ends, "block", "left")
    else:
        found = found.withColumns({"kept": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    fresh = Window.partitionBy("block").orderBy(F.col("kept").isNotNull(), "key")
    following = F.coalesce("end", F.lit(-1)) + F.row_number().over(fresh)
    return found.select("key", "block", F.coalesce("kept", following).cast("int").alias("ordinal"))


def stored_ordinals(keys: DataFrame, blocks: int, store: str) -> DataFrame:
    """(key, block, ordinal) of every key ever seen, kept as a table at `store` and extended by the new keys.

    The number of blocks is that of the first run, unless the table has outgrown it: more than four times the blocks
    are asked for. Then the table starts anew with the number asked for.
    """
    spark = keys.sparkSession
    known = spark.read.parquet(store) if exists(spark, store) else None
    if known is not None:
        of = known.select(F.max("of")).first()[0]
        known, blocks = (known.drop("of"), of) if of and blocks <= 4 * of else (None, blocks)
    found = assign_ordinals(keys, blocks, known)
    every = found if known is None else found.unionByName(known.join(found.select("key"), "key", "left_anti"))
    replace_parquet(every.withColumn("of", F.lit(blocks)), store)
    return spark.read.parquet(store).drop("of")


def _diff_block(pdf: pd.DataFrame, delivered: list[int]) -> pd.DataFrame:
    """All versions of one block: bitmaps per version, AND-NOT of neighbours, vectors of the keys in both."""
    size = int(pdf["ordinal"].max()) + 1
    keys = np.full(size, None, object)
    keys[pdf["ordinal"].to_numpy()] = pdf["key"].to_numpy(object)
    # Values become numbers, alike where the values are; -1 is null.
    hashes, sources = pd.factorize(pdf["hash"])[0], pd.factorize(pdf["source_id"])
    names = np.append(np.asarray(sources[1], object), None)
    pdf = pdf.assign(hash=hashes, source=sources[0])
    bitmaps: dict[int, Bitmap] = {}
    vectors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for version, rows in pdf.groupby("version_no", sort=True):
        at = rows["ordinal"].to_numpy()
        bitmaps[version] = pack_bits(at, size)
        vectors[version] = tuple(np.full(size, -1, np.int64) for _ in range(2))
        for vector, column in zip(vectors[version], ("hash", "source")):
            vector[at] = rows[column].to_numpy()
    absent = (np.full(size, -1, np.int64),) * 2
    parts: list[pd.DataFrame] = []
    for before, after in zip(delivered, delivered[1:]):
        old, new = bitmaps.get(before, NOTHING), bitmaps.get(after, NOTHING)
        (a, earlier), (b, later) = vectors.get(before, absent), vectors.get(after, absent)
        both = ordinals_of(in_both(old, new, size), size)
        changed = both[(a[both] != b[both]) & (a[both] >= 0) & (b[both] >= 0)]
        for kind, at, source in (("added", ordinals_of(and_not(new, old, size), size), later), ("removed", ordinals_of(and_not(old, new, size), size), earlier), ("changed", changed, later)):
            if len(at):
                parts.append(pd.DataFrame({"version_no": np.int32(after), "chunk_id": keys[at], "change_type": kind, "source_id": names[source[at]]}))
    if parts:
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame({"version_no": pd.Series([], dtype="int32"), **{c: pd.Series([], dtype=object) for c in ("chunk_id", "change_type", "source_id")}})


def snapshot_changes(df: DataFrame, block_states: int = BLOCK_STATES, known: DataFrame | None = None, blocks: int | None = None, store: str | None = None) -> DataFrame:
    """(version_no, chunk_id, change_type, source_id) from each delivered version to the next delivered one.

    version_no is the later version; change_type is added, removed or changed. A null hash means present and is
    never changed against its neighbours. source_id is the later state's (the earlier one's for a removal) and may
    be null. An empty table and a single version give no rows. Extra columns are ignored.

    Ordinals come from the table at `store`, which is made or extended, or from `known` (with `blocks`, its number of
    blocks); without either they hold for this call only.
    """
    states = snapshot_states(df)
    # One small aggregate: the versions are as many as the deliveries, whatever the number of rows.
    facts = df.filter(F.regexp_replace("chunk_id", r"^\s+|\s+$", "") != "").agg(F.sort_array(F.collect_set("version_no")), F.approx_count_distinct("chunk_id", 0.05)).first()
    delivered = list(facts[0] or [])
    if blocks is None:
        blocks = max(1, -(-int(facts[1]) * len(delivered) // block_states))
    if store is not None:
        spread = states.join(stored_ordinals(states.select("key"), blocks, store), "key")
    elif known is not None:
        spread = states.join(assign_ordinals(states, blocks, known), "key")
    else:
        # Without earlier ordinals the block itself can rank its keys: one shuffle less.
        spread = states.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))

    def diff(pdf: pd.DataFrame) -> pd.DataFrame:
        if "ordinal" not in pdf:
            pdf["ordinal"] = np.unique(pdf["key"].to_numpy(object), return_inverse=True)[1]
        return _diff_block(pdf, delivered)

    return spread.groupBy("block").applyInPandas(diff, "version_no int, chunk_id string, change_type string, source_id string")


def change_counts(changes: DataFrame) -> DataFrame:
    """(version_no, source_id, added, removed, changed): one row per version and source that changed."""
    return changes.groupBy("version_no", "source_id").agg(*[F.count_if(F.col("change_type") == kind).alias(kind) for kind in ("added", "removed", "changed")])
