"""The shapes in which the operators take the engine's tables: one row per chunk, question, pair and turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import latest, table

CHUNK = ["text", "title", "category", "heading_path", "source_id", "doc_id", "url", "text_hash"]


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "chunks"), ["chunk_id"], ["loaded_at"], CHUNK)


def questions(spark: SparkSession, root: str) -> DataFrame:
    keep = ["question", "split", "intended_route", "stratum", "persona", "scenario", "topics", "information_needs", "generation_batch", "generator", "critic", "semantic_similarity_to_seen"]
    return latest(table(spark, root, "natural_queries"), ["id"], ["created_at"], keep)


def asked(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, question): every question whose number is divisible by 50, the query set of the searches."""
    one = latest(table(spark, root, "natural_queries"), ["id"], ["created_at"], ["question"])
    return one.filter(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 50 == 0).select(F.col("id").alias("query_id"), "question")


def grades(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, chunk_id, grade): the highest usable grade of each pair."""
    return table(spark, root, "qrels").filter(F.col("relevance").between(0, 3)).groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("grade"))


def turns(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "turns"), ["id"], ["created_at"], ["user_text", "answer", "namespace", "session_id", "source_titles_json", "created_at"])
