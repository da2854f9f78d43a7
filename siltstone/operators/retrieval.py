"""Whole retrieval paths over many questions at once: direct, hybrid and planned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.embedding import profile
from siltstone.operators import dense, fusion, planning, sparse
from siltstone.operators import fixed as X
from siltstone.session import cut

FIELDS = ["chunk_id", "title", "category", "heading_path", "text", "source_id"]


def direct_retrieve(questions: DataFrame, chunks: DataFrame, k: int = 7, pool: int = 16, rerank: str = "lexical", scorer: Callable | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best `pool` by BM25, reranked, cut to k."""
    hits = sparse.as_candidates(sparse.bm25_search(questions, chunks, max(k, pool)))
    return rerank_candidates(hits.drop("rank"), questions, chunks, k, rerank, scorer)


def dense_candidates(questions: DataFrame, chunks: DataFrame, k: int, category: str | None = None, embed: Callable[[Column], Column] = profile) -> DataFrame:
    """(query_id, rank, chunk_id, distance, channel): the k nearest chunks of each question by the vectors of `embed`.

    embed turns a text column into a column of arrays; chunks are embedded by their index text, as BM25 reads them.
    """
    held = chunks if category is None else chunks.filter(F.col("category") == category)
    vectors = held.select(F.col("chunk_id").alias("vec_id"), embed(sparse.index_text()).alias("embedding"))
    hits = dense.l2_search(questions.select("query_id", embed(F.col("question")).alias("embedding")), vectors, k)
    return hits.select("query_id", "rank", F.col("vec_id").alias("chunk_id"), "distance", F.lit("dense").alias("channel"))


def hybrid_candidates(questions: DataFrame, chunks: DataFrame, k: int, category: str | None = None, embed: Callable[[Column], Column] = profile) -> DataFrame:
    """The k nearest and the k best by BM25, fused by reciprocal rank with equal weights, the nearest as the first run."""
    near = dense_candidates(questions, chunks, k, category, embed)
    best = sparse.as_candidates(sparse.bm25_search(questions, chunks, k, category))
    columns = ["query_id", "rank", "chunk_id", "distance", "channel"]
    runs = near.select(*columns, F.lit(1).alias("run_ord")).unionByName(best.select(*columns, F.lit(2).alias("run_ord")))
    return fusion.reciprocal_rank_fusion(runs.withColumn("aspect", F.lit(None).cast("string")).withColumn("weight", F.lit(1.0)))


def retrieve(questions: DataFrame, chunks: DataFrame, strategy: str = "dense", k: int = 5, pool: int | None = None, category: str | None = None, rerank: str = "none", embed: Callable[[Column], Column] = profile, scorer: Callable | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of the max(k, pool) candidates of a strategy, reranked.

    The strategy is dense, hybrid or bm25; another one is an error. Dense candidates have no score of their own: a
    rerank starts from 1 / (1 + distance).
    """
    depth = max(k, pool or k)
    if strategy == "hybrid":
        hits = hybrid_candidates(questions, chunks, depth, category, embed)
    elif strategy == "dense":
        hits = dense_candidates(questions, chunks, depth, category, embed).withColumn("score", F.round(1 / (1 + F.col("distance")), 9))
    elif strategy == "bm25":
        hits = sparse.as_candidates(sparse.bm25_search(questions, chunks, depth, category))
    else:
        raise ValueError(f"strategy must be dense, hybrid or bm25, not {strategy}")
    return rerank_candidates(hits.drop("rank"), questions, chunks, k, rerank, scorer)


def rerank_candidates(hits: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, mode: str, scorer: Callable | None = None) -> DataFrame:
    """Rerank by none, lexical or model; texts join the few candidates last, never the other way round."""
    if mode == "none":
        return fusion.ranked(hits).filter(F.col("rank") <= k)
    full = hits.join(questions, "query_id").join(chunks.select(*FIELDS), "chunk_id")
    if mode == "lexical":
        return fusion.lexical_rerank(full).filter(F.col("rank") <= k)
    if mode == "model" and scorer is not None:
        return model_rerank(full, scorer).filter(F.col("rank") <= k)
    raise ValueError("mode must be none, lexical or model, the last with a scorer")


def model_rerank(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Order by a model's score of question and document; the model is called once per Arrow batch."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, documents in batches:
            yield pd.Series(scorer(list(asked), list(documents)), dtype="float64")

    def score(asked: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return run(asked)

    score.__annotations__ = {"asked": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    parts = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in (("Title", "title"), ("Category", "category"), ("Section", "heading_path"))]
    document = F.concat_ws("\n", *parts, F.coalesce("text", F.lit("")))
    return fusion.ranked(candidates.withColumn("score", F.pandas_udf(score, "double")("question", document))).drop("text")


def planned_retrieve(questions: DataFrame, chunks: DataFrame, k: int = 7, pool: int = 16, conservative: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, aspect, rank): all runs of all plans in one search, fused by weight, covered.

    Every run is searched once as its own query; runs that ask the same text share one search. The anchor gives k
    rows, every other run `pool`; both grow with the plan's aspects. All fused candidates are boosted and may cover.
    """
    # Plans and runs are a few rows per question but large expressions, used several times.
    plans = cut(plan_limits(planning.plan(questions, 3 if conservative else 2), k, pool, conservative).select("query_id", "question", "aspects", "categories", "sub_queries", "k", "pool", "slots"))
    specs = planning.run_specs(plans, conservative).join(plans.select("query_id", "k", "pool"), "query_id")
    specs = cut(specs.withColumn("depth", F.when(F.col("run_group") == "anchor", F.col("k")).otherwise(F.col("pool"))).drop("k", "pool"))
    fused = fuse_runs(specs, chunks, deepest(k, pool))
    boosted = boost_fused(fused, chunks, 0.006)
    chosen = cover_plan_bounded(boosted, plans)
    return boosted.select("query_id", "chunk_id", "score", "aspect").join(chosen, ["query_id", "chunk_id"]).withColumnRenamed("place", "rank")


def legacy_retrieve(questions: DataFrame, chunks: DataFrame, k: int = 7, pool: int = 16) -> DataFrame:
    """(query_id, chunk_id, score, aspect, rank): unweighted fusion of all aspect and sub-query runs, boosts of 0.24, plan coverage.

    Runs of an aspect within a category are half as deep as the others.
    """
    plans = cut(plan_limits(planning.plan(questions), k, pool).select("query_id", "aspects", "categories", "sub_queries", "k", "pool"))
    specs = planning.legacy_run_specs(plans).join(plans.select("query_id", "pool"), "query_id")
    half = F.greatest(F.lit(3), F.floor(F.col("pool") / 2).cast("int"))
    depth = F.when(F.col("aspect").isNotNull() & F.col("category").isNotNull(), half).otherwise(F.col("pool"))
    fused = fuse_runs(cut(specs.withColumn("depth", depth).drop("pool")), chunks, deepest(k, pool))
    boosted = boost_fused(fused, chunks, 0.24)
    chosen = cover_plan(boosted, plans, None, by_rank=True)
    return boosted.select("query_id", "chunk_id", "score", "aspect").join(chosen, ["query_id", "chunk_id"]).withColumnRenamed("place", "rank")


def plan_limits(plans: DataFrame, k: int, pool: int, conservative: bool = False) -> DataFrame:
    """Adds k, pool and slots: plans with aspects (conservative: two or more) get more places, deeper runs, coverage."""
    n = F.size("aspects")
    several = n >= (2 if conservative else 1)
    places = F.when(several, F.greatest(F.lit(k), F.least(F.lit(10), 2 * n + 4))).otherwise(k)
    covering = F.least(F.lit(2), F.floor(F.col("k") / 4)).cast("int")
    slots = F.when(several, covering).otherwise(0) if conservative else F.greatest(F.lit(1), covering)
    return plans.withColumn("k", places).withColumn("pool", F.when(several, F.greatest(F.lit(pool), 2 * F.col("k"))).otherwise(pool)).withColumn("slots", slots)


def deepest(k: int, pool: int) -> int:
    """The most rows a run of plan_limits can ask for."""
    return max(k, pool, 2 * max(k, 10))


def fuse_runs(specs: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """The fused candidates of (query_id, run_ord, query, category, aspect, weight, depth), each run cut to its depth.

    No depth exceeds `most`, which bounds what a search keeps.
    """
    # Runs that ask the same text within the same category share one search.
    searches = cut(specs.select(F.col("query").alias("question"), "category").distinct().withColumn("query_id", F.monotonically_increasing_id()))
    hits = sparse.search_index(searches, sparse.term_index(chunks), most)
    same = [specs["query"] == searches["question"], specs["category"].eqNullSafe(searches["category"])]
    runs = specs.join(searches.withColumnRenamed("query_id", "search_id"), same).drop("query", "question", "category")
    found = runs.join(hits.withColumnRenamed("query_id", "search_id"), "search_id").filter(F.col("rank") <= F.col("depth"))
    return fusion.reciprocal_rank_fusion(found.select("query_id", "run_ord", "rank", "chunk_id", (1 / (1 + F.col("score"))).alias("distance"), "aspect", F.lit("bm25").alias("channel"), "weight"))


def boost_fused(fused: DataFrame, chunks: DataFrame, most: float) -> DataFrame:
    """All candidates ranked by boosted score; only boosted scores are rounded to six places, the others stay apart.

    Made once, as selection reads them twice; of a chunk only what selection needs is kept.
    """
    full = fused.join(chunks.select(*FIELDS), "chunk_id").withColumn("plain", F.col("score"))
    boosted = fusion.plan_boosts(full, most).select("query_id", "chunk_id", "distance", "aspect", "category", "source_id", F.when(F.col("boost") > 0, F.col("score")).otherwise(F.col("plain")).alias("score"))
    return cut(fusion.ranked(boosted))


def preferred(name: str, categories: list[str]) -> list[str]:
    return categories if name == "classification" else [c for c in categories if c not in ("RAG overview", "RAG paper")] or categories


def cover_plan_bounded(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, chunk_id, place): rank 1 stays, at most `slots` places cover the plan, the rest follows rank to k.

    Slots go to the plan's aspects in order, each from its own categories if they hold one, then to categories in order
    of priority that nothing chosen has. plans are (query_id, aspects, categories, k, slots).
    """
    limits = plans.select("query_id", F.transform("aspects", lambda a: F.struct(a["name"].alias("name"), a["categories"].alias("categories"))).alias("aspects"), F.col("categories").alias("plan_categories"), "k", "slots")
    joined = candidates.select("query_id", "chunk_id", "rank", "aspect", "category").join(limits, "query_id")

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        k, slots = int(rows[0]["k"]), int(rows[0]["slots"])
        wanted = [(a["name"], list(a["categories"])) for a in rows[0]["aspects"]]
        chosen, left = rows[: min(1, k)], rows[1:]

        def take(test) -> bool:
            at = next((i for i, r in enumerate(left) if test(r)), None) if len(chosen) < k else None
            if at is not None:
                chosen.append(left.pop(at))
            return at is not None

        for name, categories in wanted:
            if slots > 0:
                narrow = preferred(name, categories)
                slots -= take(lambda r: r["aspect"] == name and r["category"] in narrow) or take(lambda r: r["aspect"] == name)
        asked = set(rows[0]["plan_categories"]) | {c for _, cs in wanted for c in cs}
        for category in X.CATEGORY_PRIORITY:
            if slots > 0 and category in asked and all(r["category"] != category for r in chosen):
                slots -= take(lambda r: r["category"] == category)
        chosen += left[: k - len(chosen)]
        return pd.DataFrame({"query_id": rows[0]["query_id"], "chunk_id": [r["chunk_id"] for r in chosen], "place": range(1, len(chosen) + 1)}).astype({"place": "int32"})

    return joined.groupBy("query_id").applyInPandas(select, "query_id string, chunk_id string, place int")


def cover_plan(candidates: DataFrame, plans: DataFrame, k: int | None, by_rank: bool = False) -> DataFrame:
    """(query_id, chunk_id, place): coverage of a plan's aspects and categories, then by rank.

    First one candidate per aspect, from its own categories if there is one; then more from other sources up to the
    number the aspect should have; then categories in order of priority; then by rank. Selection depends on what was
    selected before, so it runs per query over its candidates, of which there are at most a few hundred. With by_rank
    an aspect takes the best of all its categories, not of the first that has one, and a plan without aspects keeps
    rank 1, then covers its categories in order, as the reference does. k is that of the plan where None is given.
    """
    aspects = plans.select("query_id", F.transform("aspects", lambda a: F.struct(a["name"].alias("name"), a["categories"].alias("categories"))).alias("aspects"), "categories", (F.col("k") if k is None else F.lit(k)).alias("k"))
    joined = candidates.select("query_id", "chunk_id", "rank", "aspect", "category", "source_id").join(aspects.withColumnRenamed("categories", "plan_categories"), "query_id")

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        wanted = [(a["name"], list(a["categories"])) for a in rows[0]["aspects"]]
        k, chosen = int(rows[0]["k"]), []

        def take(test) -> bool:
            row = next((r for r in rows if r not in chosen and test(r)), None) if len(chosen) < k else None
            if row is not None:
                chosen.append(row)
            return row is not None

        def best(name: str, categories: list[str], barred: set) -> bool:
            narrow = preferred(name, categories)
            for group in [narrow] if by_rank else [[c] for c in narrow]:
                if take(lambda r: r["aspect"] == name and r["category"] in group and r["source_id"] not in barred):
                    return True
            return take(lambda r: r["aspect"] == name and r["source_id"] not in barred)

        for name, categories in wanted:
            best(name, categories, set())
        for name, categories in wanted:
            while sum(r["aspect"] == name for r in chosen) < X.LEAST_SOURCES.get(name, 1):
                if not best(name, categories, {r["source_id"] for r in chosen if r["aspect"] == name}):
                    break
        asked = set(rows[0]["plan_categories"]) | {c for _, cs in wanted for c in cs}
        if by_rank and not wanted:
            take(lambda r: True)
        for category in X.CATEGORY_PRIORITY if wanted or not by_rank else rows[0]["plan_categories"]:
            if category in asked and all(r["category"] != category for r in chosen):
                take(lambda r: r["category"] == category)
        while take(lambda r: True):
            pass
        return pd.DataFrame({"query_id": rows[0]["query_id"], "chunk_id": [r["chunk_id"] for r in chosen], "place": range(1, len(chosen) + 1)}).astype({"place": "int32"})

    return joined.groupBy("query_id").applyInPandas(select, "query_id string, chunk_id string, place int")
