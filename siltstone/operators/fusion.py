"""Fusion of ranked runs, lexical reranking, boosts and coverage-aware selection, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.fixed import EVIDENCE_TERMS, TERM_ALIASES

K = 60


def reciprocal_rank_fusion(runs: DataFrame, k: int = K) -> DataFrame:
    """Fuse runs (query_id, run_ord, rank, chunk_id, distance, aspect, channel, weight) into one ranking per query.

    score is the sum of weight / (k + rank). The representative of a chunk is the occurrence with the least distance,
    the earliest among equals; its aspect is that of the last occurrence that became representative and had one,
    else the first one seen. channels are the sorted distinct ones. Ranked by score, then distance, then chunk_id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    seen = Window.partitionBy("query_id", "chunk_id").orderBy("run_ord", "rank")
    before = F.min("distance").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("order", F.struct("run_ord", "rank")).withColumn("leads", before.isNull() | (F.col("distance") < before))
    fused = marked.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"),
        F.min("distance").alias("distance"),
        F.coalesce(F.max_by("aspect", F.when(F.col("leads") & F.col("aspect").isNotNull(), F.col("order"))), F.min_by("aspect", F.when(F.col("aspect").isNotNull(), F.col("order")))).alias("aspect"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),
    )
    return ranked(fused)


def ranked(df: DataFrame) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "chunk_id")
    return df.withColumn("rank", F.row_number().over(best))


def run_violations(runs: DataFrame) -> DataFrame:
    """(query_id, run_ord, problem): runs with a negative or missing weight, or two weights."""
    facts = runs.groupBy("query_id", "run_ord").agg(F.countDistinct("weight").alias("weights"), F.min("weight").alias("least"), F.count_if(F.col("weight").isNull()).alias("missing"))
    problem = F.when(F.col("missing") > 0, "missing weight").when(F.col("least") < 0, "negative weight").when(F.col("weights") > 1, "several weights")
    return facts.withColumn("problem", problem).filter("problem is not null").select("query_id", "run_ord", "problem")


def base_score(score: Column, distance: Column) -> Column:
    return F.when(score > 0, score).otherwise(1 / (1 + F.greatest(F.lit(0.0), F.coalesce(distance, F.lit(0.0)))))


def min_max(value: Column) -> Column:
    """Scaled to 0..1 within the query; 1 where all are equal."""
    query = Window.partitionBy("query_id")
    low, high = F.min(value).over(query), F.max(value).over(query)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def rerank_tokens(question: Column | str) -> Column:
    """The question's distinct tokens and the aliases of the words it holds, of two characters or more."""
    q = F.col(question) if isinstance(question, str) else question
    low = F.lower(q)
    extra = [F.when(low.contains(key), F.array(*map(F.lit, aliases))).otherwise(F.array().cast("array<string>")) for key, aliases in TERM_ALIASES.items()]
    return F.filter(F.array_distinct(F.concat(T.search_tokens(q, folded=False), *extra)), lambda t: F.char_length(t) >= 2)


def matched_share(tokens: Column, text: Column) -> Column:
    """Share of the tokens that the text contains, as substrings; 0 for no tokens or no text."""
    hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    return F.when((F.size(tokens) == 0) | (text == ""), 0.0).otherwise(hits / F.size(tokens))


def lexical_rerank(candidates: DataFrame) -> DataFrame:
    """Rerank (query_id, question, chunk_id, score, distance, title, category, heading_path, text) within each query.

    0.50 base + 0.30 text + 0.15 heading + 0.05 category, where base is the min-max scaled retrieval score.
    """
    empty = lambda c: F.lower(F.coalesce(c, F.lit("")))
    head = F.concat_ws(" ", empty("title"), empty("category"), empty("heading_path"))
    whole = F.concat_ws("\n", empty("title"), empty("category"), empty("heading_path"), empty("text"))
    scored = (
        candidates.withColumn("tokens", rerank_tokens("question"))
        .withColumn("raw", base_score(F.col("score"), F.col("distance")))
        .withColumn("base", min_max(F.col("raw")))
        .withColumn("lexical", matched_share(F.col("tokens"), whole))
        .withColumn("heading", matched_share(F.col("tokens"), head))
        .withColumn("fits", matched_share(F.col("tokens"), empty("category")))
    )
    blended = F.round(0.5 * F.col("base") + 0.3 * F.col("lexical") + 0.15 * F.col("heading") + 0.05 * F.col("fits"), 6)
    reason = F.format_string("base=%.3f; lexical=%.3f; heading=%.3f; category=%.3f", "base", "lexical", "heading", "fits")
    return ranked(scored.withColumn("score", blended).withColumn("reason", reason)).drop("tokens", "raw", "question", "text")


def rank_fusion(df: DataFrame, first: str, second: str, weight: float = 0.5) -> DataFrame:
    """Blend two rankings: weight / (60 + first) + (1 - weight) / (60 + second)."""
    return ranked(df.withColumn("score", F.round(weight / (K + F.col(first)) + (1 - weight) / (K + F.col(second)), 9)))


def plan_boosts(candidates: DataFrame, most: float = 0.24) -> DataFrame:
    """Raise the score of candidates by the evidence terms of their aspect: most / 6 per term, at most `most`."""
    text = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("heading_path", F.lit("")), F.coalesce("text", F.lit(""))))
    hits = F.lit(0)
    for aspect, terms in EVIDENCE_TERMS.items():
        hits = F.when(F.col("aspect") == aspect, sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))).otherwise(hits)
    boosted = candidates.withColumn("boost", F.least(F.lit(most), most / 6 * hits))
    return ranked(boosted.withColumn("score", F.round(F.col("score") + F.col("boost"), 6)))


def cover_categories(candidates: DataFrame, required: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, place): the best first, then the first of each required category not yet covered, then by rank."""
    order = {c: i for i, c in enumerate(required)}
    place = F.lit(None).cast("int")
    for c, i in order.items():
        place = F.when(F.col("category") == c, i).otherwise(place)
    query = Window.partitionBy("query_id")
    top = F.max(F.when(F.col("rank") == 1, F.col("category"))).over(query)
    first = F.row_number().over(Window.partitionBy("query_id", "category").orderBy("rank")) == 1
    covers = first & place.isNotNull() & (F.col("rank") > 1) & ~F.col("category").eqNullSafe(top)
    kind = F.when(F.col("rank") == 1, -1).when(covers, place).otherwise(len(required) + F.col("rank"))
    chosen = candidates.withColumn("kind", kind).withColumn("place", F.row_number().over(query.orderBy("kind")))
    return chosen.filter(F.col("place") <= k).select("query_id", "chunk_id", "place")


def cover_aspects(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, place): the best of each aspect, filled up by rank to k, then in order of rank."""
    query = Window.partitionBy("query_id")
    first = F.col("aspect").isNotNull() & (F.row_number().over(Window.partitionBy("query_id", "aspect").orderBy("rank")) == 1)
    chosen = candidates.withColumn("take", F.row_number().over(query.orderBy(F.when(first, 0).otherwise(1), "rank"))).filter(F.col("take") <= k)
    return chosen.withColumn("place", F.row_number().over(query.orderBy("rank"))).select("query_id", "chunk_id", "place")
