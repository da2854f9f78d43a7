"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import encoder_of, rank_file

#: Texts per Arrow step inside a worker, so that the ids of one step stay small whatever the batch.
STEP = 256


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The contents of a rank file as a broadcast: executors need no copy of the file. A public one is about 1 MB."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens.

    Null and empty texts give an empty list; a blank text is encoded like any other. Repeated rows stay repeated
    and a null key is kept. Only the two columns are read, whatever others the table has. Nothing is shuffled.
    """
    ranks = shipped(df.sparkSession, path or rank_file())
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder_of(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids = [tokens.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    coded = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(encode, f"k {kind}, ids array<int>")
    return coded.withColumnRenamed("k", key)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text of each row's ids; null and empty lists give an empty text."""
    ranks = shipped(df.sparkSession, path or rank_file())
    kind = df.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder_of(ranks.value)
        for batch in batches:
            texts = [tokens.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(decode, f"k {kind}, text string").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): the number of tokens of each row's whole text; 0 for null and empty texts."""
    ranks = shipped(df.sparkSession, path or rank_file())
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder_of(ranks.value)
        for batch in batches:
            sizes = [len(tokens.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(count, f"k {kind}, n_tokens int").withColumnRenamed("k", key)
