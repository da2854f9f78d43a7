"""Snapshot changes against brute force, and every odd case."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import snapshots as S

SCHEMA = "version_no int, chunk_id string, text_hash string, source_id string, loaded_at timestamp"
T0 = dt.datetime(2026, 1, 1)


def found(df):
    return sorted((r.version_no, r.chunk_id, r.change_type) for r in S.snapshot_changes(df).collect())


def test_bitmaps_round_trip():
    rng = np.random.default_rng(2)
    for size in (1, 7, 64, 1000):
        for many in (0, 1, size // 2, size):
            at = np.sort(rng.choice(size, many, replace=False))
            assert (S.ordinals_of(S.pack_bits(at, size), size) == at).all()
            assert (np.flatnonzero(np.unpackbits(S.words(S.pack_bits(at, size), size), count=size)) == at).all()
    assert S.pack_bits(np.arange(5000), 5000)[0] == "runs" and S.pack_bits(np.arange(0, 5000, 2), 5000)[0] == "bits"


def test_bitmap_operations_equal_sets():
    rng = np.random.default_rng(3)
    made = []
    for size in (1, 9, 600):
        runs = [np.arange(a, min(size, a + n)) for a, n in ((0, size), (0, 0), (size // 3, size // 2), (size // 2, 1))]
        mixed = np.unique(np.concatenate([np.arange(20, 300), np.arange(310, 311), np.arange(400, 555)]))
        made += [(size, x, y) for x in [*runs, np.flatnonzero(rng.random(size) < 0.5), mixed[mixed < size]] for y in [*runs, np.flatnonzero(rng.random(size) < 0.2), mixed[mixed < size]]]
    kinds = set()
    for size, x, y in made:
        a, b = S.pack_bits(x, size), S.pack_bits(y, size)
        kinds.add((a[0], b[0]))
        assert S.ordinals_of(S.and_not(a, b, size), size).tolist() == sorted(set(x.tolist()) - set(y.tolist()))
        assert S.ordinals_of(S.in_both(a, b, size), size).tolist() == sorted(set(x.tolist()) & set(y.tolist()))
    assert len(kinds) == 4


def test_stored_ordinals_go_on(spark, tmp_path):
    store = str(tmp_path / "ordinals")
    rows = [(v, f"k{i}", f"h{i + v * (i % 3 == 0)}", "s", T0) for v in (1, 2) for i in range(v * 5, 60)]
    want = found(spark.createDataFrame(rows, SCHEMA))
    first = S.snapshot_changes(spark.createDataFrame(rows, SCHEMA), store=store)
    assert sorted((r.version_no, r.chunk_id, r.change_type) for r in first.collect()) == want
    before = {r.key: (r.block, r.ordinal) for r in spark.read.parquet(store).collect()}
    rows += [(3, f"k{i}", "h", None, T0) for i in range(50, 90)]
    again = S.snapshot_changes(spark.createDataFrame(rows, SCHEMA), store=store)
    assert sorted((r.version_no, r.chunk_id, r.change_type) for r in again.collect()) == found(spark.createDataFrame(rows, SCHEMA))
    after = {r.key: (r.block, r.ordinal) for r in spark.read.parquet(store).collect()}
    assert all(after[k] == v for k, v in before.items()) and len(set(after.values())) == len(after) == 85


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows, state = [], {}
    for version in (1, 2, 4, 5):
        state[version] = {f"c{i}": rng.choice(["h1", "h2", None]) for i in range(80) if rng.random() < 0.7}
        for key, value in state[version].items():
            rows.append((version, f" {key} ", value and f"SHA256:{value.upper()}" if rng.random() < 0.5 else value, "s", T0))
            rows += [rows[-1]] * rng.randint(0, 2)
    want = []
    for a, b in ((1, 2), (2, 4), (4, 5)):
        old, new = state[a], state[b]
        want += [(b, k, "added") for k in new.keys() - old.keys()] + [(b, k, "removed") for k in old.keys() - new.keys()]
        want += [(b, k, "changed") for k in old.keys() & new.keys() if old[k] and new[k] and old[k] != new[k]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "block", "ordinal", "hash", "versions")})
    assert found(frame) == sorted(want)
    one = S.snapshot_changes(frame, blocks=1).count()
    assert one == S.snapshot_changes(frame, blocks=17).count() == len(want)


def test_odd_cases(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, None, None, None, None)] * 2, SCHEMA)) == []
    assert found(spark.createDataFrame([(3, "a", "h", "s", T0)], SCHEMA)) == []
    late = T0 + dt.timedelta(days=9)
    rows = [(1, "a", "h", "s", T0), (1, "a", "g", "s", late), (2, "a", "g ", "s", T0), (2, "", "x", "s", T0), (2, None, "x", "s", T0), (2, "b", None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(2, "b", "added")]
    counts = S.change_counts(S.snapshot_changes(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [tuple(r) for r in counts] == [(2, None, 1, 0, 0)]


def test_ordinals_persist(spark):
    first = S.assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string"), 4)
    known = {r.key: (r.block, r.ordinal) for r in first.collect()}
    assert len(set(known.values())) == 50
    more = S.assign_ordinals(spark.createDataFrame([(f"k{i}",) for i in range(25, 90)], "key string"), 4, first)
    after = {r.key: (r.block, r.ordinal) for r in more.collect()}
    assert all(after[k] == known[k] for k in known if k in after)
    assert len(set(after.values()) | set(known.values())) == 90
