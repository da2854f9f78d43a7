"""Exact vector search of a stated query set against all vectors, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.session import cut

#: Bytes of query vectors that go to the executors at once, and queries that a task holds against its vectors at once.
PASS_BYTES, BLOCK = 1 << 26, 1024


def squared_distance(a: str, b: str):
    """Squared Euclidean distance of two array columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str):
    """Cosine similarity; 0 where a norm is 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def l2_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest vectors of every query, ties to the smaller vec_id.

    queries are (query_id, embedding) and optionally (label): then only vectors of that label compete. A pass over the
    vectors takes PASS_BYTES of query vectors; a task holds its vectors against them by matrix products, settles the
    nearest ones by exact distances and keeps k per query; nothing else is shuffled. Null vectors take no part.
    """
    filtered = "label" in queries.columns
    queries = queries.filter("embedding is not null")
    first = queries.select(F.size("embedding").alias("n")).first()
    size = max(1, first.n if first else 1)
    passes = max(1, -(-queries.count() * size * 8 // PASS_BYTES))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(passes)))
    arrow = to_arrow_type(queries.schema["query_id"].dataType)
    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((queries, "query_id"), (vectors, "vec_id"))) + ", distance double"

    def one(block: int) -> DataFrame:
        rows = numbered.filter(F.col("_b") == block).collect()  # about PASS_BYTES
        ids = np.array([r.query_id for r in rows] or [0])
        points = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), size)
        labels = np.array([r.label for r in rows], object) if filtered else None

        def nearest(at: np.ndarray, place: np.ndarray, theirs: np.ndarray | None, begin: int) -> tuple[np.ndarray, ...]:
            """(query, row, distance) of the k nearest rows of the queries from begin on; place orders equal distances."""
            some = points[begin : begin + BLOCK]
            far = (at**2).sum(1)[:, None] - 2 * at @ some.T + (some**2).sum(1)[None, :]
            if theirs is not None:
                far[theirs[:, None] != labels[None, begin : begin + BLOCK]] = np.inf
            last = np.partition(far, min(k, len(at)) - 1, axis=0)[min(k, len(at)) - 1]
            row, query = np.nonzero((far <= last + 1e-6 * (1 + np.abs(np.where(np.isfinite(last), last, 0)))) & np.isfinite(far))
            exact = np.round(((at[row] - some[query]) ** 2).sum(1), 6)
            order = np.lexsort((place[row], exact, query))
            row, query, exact = row[order], query[order], exact[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query)
            return query[nth < k] + begin, row[nth < k], exact[nth < k]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(points) or not batch.num_rows:
                    continue
                at = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                place = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)[1]
                theirs = batch.column(2).to_numpy(zero_copy_only=False).astype(object) if filtered else None
                for begin in range(0, len(points), BLOCK):
                    query, row, exact = nearest(at, place, theirs, begin)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query].tolist(), arrow), batch.column(0).take(pa.array(row)), pa.array(exact)], names=["query_id", "vec_id", "distance"])

        columns = ["vec_id", "embedding"] + ["label"] * filtered
        made = vectors.filter("embedding is not null").select(*columns).mapInArrow(search, schema)
        return cut(made) if passes > 1 else made

    found = reduce(DataFrame.unionByName, [one(b) for b in range(passes)]).withColumn("distance", F.round("distance", 6))
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
