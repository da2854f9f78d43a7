"""Rule-based query planning and routing as one narrow projection over all questions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import fixed as X

EMPTY = "array<string>"


def has_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w.lower())
    return out


def normalized(question: Column | str) -> Column:
    q = F.col(question) if isinstance(question, str) else question
    return F.regexp_replace(F.lower(T.strip(q)), r"\s+", " ")


def category_scores(n: Column) -> Column:
    """[(-score, ordinal, category)] sorted: by score, then by order of declaration."""
    scored = []
    for i, (category, hints) in enumerate(X.CATEGORY_HINTS.items()):
        score = sum((F.when(n.contains(h), 2 if len(h) > 4 else 1).otherwise(0) for h in hints), F.when(n.contains(category.lower()), 2).otherwise(0))
        scored.append(F.struct((-score).cast("int").alias("s"), F.lit(i).alias("i"), F.lit(category).alias("c")))
    return F.array_sort(F.array(*scored))


def confidence(scores: Column) -> Column:
    top, second = -F.get(scores, 0)["s"], -F.get(scores, 1)["s"]
    return F.when(top <= 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), (2 * top - second) / 8), 2))


def intent(n: Column, categories: Column) -> Column:
    out = F.lit("answer")
    for name, words in reversed(X.INTENTS):
        test = has_any(n, words)
        out = F.when(test | F.array_contains(categories, "evaluation") if name == "evaluate" else test, name).otherwise(out)
    return out


def _techniques(n: Column) -> tuple[Column, Column]:
    """Which narrower form the techniques aspect takes: (categories, search text)."""
    # The words that narrow the aspect.
    metadata = n.contains("chroma") & has_any(n, ["metadata", "filter", "where", "过滤"])
    rerank = has_any(n, ["rerank", "重排"]) & ~has_any(n, ["hybrid", "混合检索", "metadata"])
    hybrid = (has_any(n, ["hybrid", "混合检索"]) | has_any(n, ["only vector", "single vector", "vector similarity", "向量相似度", "只做一次"])) & has_any(n, ["metadata", "filter", "过滤", "rerank", "重排"])
    plain = X.ASPECTS["techniques"]
    categories, search = F.array(*map(F.lit, plain[2])), F.lit(plain[3])
    for test, (cats, words) in ((hybrid, X.TECHNIQUES_HYBRID), (rerank, X.TECHNIQUES_RERANK), (metadata, X.TECHNIQUES_METADATA)):
        categories, search = F.when(test, F.array(*map(F.lit, cats))).otherwise(categories), F.when(test, words).otherwise(search)
    return categories, search


def _aspect(n: Column, name: str) -> Column:
    categories, search = _techniques(n) if name == "techniques" else (F.array(*map(F.lit, X.ASPECTS[name][2])), F.lit(X.ASPECTS[name][3]))
    return F.struct(F.lit(name).alias("name"), categories.alias("categories"), search.alias("search"))


def aspects(n: Column) -> Column:
    """The aspects of the first planner, in order: triggered ones, those an evaluation brings, or the broad three."""
    tests = {name: has_any(n, d[0]) for name, d in X.ASPECTS.items()}
    direct = F.array_compact(F.array(*[F.when(t, _aspect(n, name)) for name, t in tests.items()]))
    badcase = tests["evaluation"] & has_any(n, X.ASPECTS["badcase_analysis"][0]) & ~tests["badcase_analysis"]
    citation = tests["evaluation"] & has_any(n, X.CITATION_MARKERS) & ~tests["citation_quality"]
    more = F.array_compact(F.array(F.when(badcase, _aspect(n, "badcase_analysis")), F.when(citation, _aspect(n, "citation_quality"))))
    found = F.concat(direct, more)
    broad = has_any(n, X.BROAD_SUBJECTS) & has_any(n, X.BROAD_MARKERS) & (F.size(found) == 0)
    return F.when(broad, F.array(*[_aspect(n, a) for a in ("classification", "techniques", "bottlenecks")])).otherwise(found)


def conservative_aspects(n: Column, question: Column) -> Column:
    """Only explicit, independent needs; search texts are anchored in the question's own words."""
    found = [F.when(has_any(n, X.ASPECTS[name][1]), _aspect(n, name)) for name in X.CONSERVATIVE_ORDER]
    scope = has_any(n, X.INGESTION_SCOPE)
    for name, words, categories, search in (
        ("ingestion_identity", X.INGESTION_IDENTITY, ["ingestion", "indexing", "vector db"], X.IDENTITY_SEARCH),
        ("ingestion_cache", X.INGESTION_CACHE, ["ingestion", "indexing"], X.CACHE_SEARCH),
    ):
        made = F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, categories)).alias("categories"), F.lit(search).alias("search"))
        found.append(F.when(scope & has_any(n, words), made))
    anchored = lambda a: F.struct(a["name"].alias("name"), a["categories"].alias("categories"), F.concat(T.strip(question), F.lit(" 检索重点: "), a["search"]).alias("search"))
    return F.transform(F.array_compact(F.array(*found)), anchored)


def _names(scores: Column) -> Column:
    return F.transform(F.filter(scores, lambda s: s["s"] < 0), lambda s: s["c"])


def distinct_folded(items: Column) -> Column:
    """The first of the items that are equal but for case, in order."""
    return F.aggregate(items, F.array().cast(EMPTY), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def plan(questions: DataFrame, version: int = 2, most: int = 2) -> DataFrame:
    """Adds the plan: normalized, scores, confidence, aspects, categories, intent, sub_queries, warnings."""
    n = F.col("normalized")
    out = questions.withColumn("normalized", normalized("question")).withColumn("scores", category_scores(n)).withColumn("confidence", confidence(F.col("scores")))
    asked = T.strip("question")
    if version == 2:
        out = out.withColumn("aspects", aspects(n))
        merged = F.concat(F.slice(_names(F.col("scores")), 1, most), F.flatten(F.transform("aspects", lambda a: a["categories"])))
        out = out.withColumn("categories", F.slice(distinct_folded(merged), 1, max(2, most)))
        expansion = lambda c: _lookup(c, X.CATEGORY_EXPANSIONS)
        extended = F.transform("categories", lambda c: F.concat(asked, F.lit(" "), expansion(c)))
        subs = F.concat(F.array(asked), F.transform("aspects", lambda a: a["search"]), extended)
        warnings = F.array_compact(F.array(F.when(F.size("categories") == 0, "no category"), F.when(F.size("aspects") > 0, "several aspects")))
    else:
        out = out.withColumn("aspects", conservative_aspects(n, F.col("question")))
        scored = _names(F.col("scores"))
        specific = F.filter(scored, lambda c: ~c.isin("RAG overview", "RAG challenges"))
        out = out.withColumn("categories", F.slice(distinct_folded(F.concat(F.flatten(F.transform("aspects", lambda a: a["categories"])), specific, scored)), 1, most))
        subs = F.when(F.size("aspects") < 2, F.array(asked)).otherwise(F.concat(F.array(asked), F.transform("aspects", lambda a: a["search"])))
        warnings = F.array_compact(F.array(F.when(F.size("categories") == 0, "no category"), F.when(F.size("aspects") < 2, "expansion disabled").otherwise("bounded expansion")))
    return out.withColumn("intent", intent(n, F.col("categories"))).withColumn("sub_queries", distinct_folded(subs)).withColumn("warnings", warnings)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit("")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def route(plans: DataFrame, budget_ms: int = 12_000, mode: str = "auto") -> DataFrame:
    """Adds features, complexity, estimated_ms, route and reasons."""
    if mode not in ("auto", "direct", "planned") or budget_ms <= 0:
        raise ValueError("mode must be auto, direct or planned, and the budget positive")
    a, c, s = F.size("aspects"), F.size("categories"), F.size("sub_queries")
    searches = F.filter(F.transform(F.concat(F.transform("aspects", lambda x: x["search"]), F.col("sub_queries")), lambda q: F.lower(T.strip(q))), lambda q: q != "")
    unique = F.size(F.array_distinct(searches))
    many, wide, unsure = a >= 2, (a == 0) & (s >= 3) & (c >= 2), (a == 1) & (F.col("confidence") < 0.25)
    crossed = (F.col("intent") == "compare") & (c >= 2)
    score = F.when(many, 4).when(wide, 3).when(unsure, 3).otherwise(0) + F.when(crossed, 2).otherwise(0)
    estimate = 1500 + 1000 * F.greatest(F.lit(1), unique)
    enough = score >= 3
    picked = F.lit(mode) if mode != "auto" else F.when(enough & (estimate <= budget_ms), "planned").otherwise("direct")
    lead = F.lit("forced_by_user") if mode != "auto" else F.when(enough & (estimate <= budget_ms), "complexity_threshold_reached").when(enough, "estimated_planned_latency_exceeds_budget").otherwise("simple_or_specific_query")
    why = F.when(many, "multiple_answer_aspects").when(wide, "multi_category_expansion_without_aspects").when(unsure, "aspect_detected_with_low_category_confidence")
    return plans.withColumns({
        "unique_queries": unique, "complexity": score, "estimated_ms": estimate, "route": picked,
        "reasons": F.array_compact(F.array(lead, why, F.when(crossed, "cross_category_comparison"))),
    })


def run_specs(plans: DataFrame, conservative: bool = False) -> DataFrame:
    """(query_id, run_ord, query, category, aspect, run_group, weight): the retrieval runs of each plan.

    Runs are told apart by query and category; the first of equals stays. A group's weight is shared by its runs.
    """

    def spec(query: Column, category: Column, aspect: Column, group: str) -> Column:
        return F.struct(T.strip(query).alias("query"), category.cast("string").alias("category"), aspect.cast("string").alias("aspect"), F.lit(group).alias("run_group"))

    none, q = F.lit(None), F.col("question")
    anchor = F.array(spec(q, none, none, "anchor"))
    by_category = lambda cats, query, aspect: F.transform(cats, lambda c: spec(query, c, aspect, "filtered_expansion"))
    if conservative:
        per_aspect = F.flatten(F.transform(F.slice("aspects", 1, 4), lambda a: F.concat(F.array(spec(a["search"], none, a["name"], "global_expansion")), by_category(F.slice(a["categories"], 1, 1), a["search"], a["name"]))))
        more = F.concat(by_category(F.slice("categories", 1, 2), q, none), per_aspect)
        listed = F.when(F.size("aspects") < 2, anchor).otherwise(F.concat(anchor, more))
        totals = {"anchor": 3.0, "global_expansion": 0.75, "filtered_expansion": 0.25}
    else:
        per_aspect = F.flatten(F.transform("aspects", lambda a: F.concat(F.array(spec(a["search"], none, a["name"], "global_expansion")), by_category(F.slice(a["categories"], 1, 8), a["search"], a["name"]))))
        per_sub = F.flatten(F.transform("sub_queries", lambda s: F.concat(F.array(spec(s, none, none, "global_expansion")), by_category(F.col("categories"), s, none))))
        listed = F.concat(anchor, by_category(F.col("categories"), q, none), per_aspect, per_sub)
        totals = {"anchor": 2.0, "global_expansion": 1.0, "filtered_expansion": 0.5}
    rows = plans.select("query_id", F.posexplode(listed).alias("at", "r")).select("query_id", "at", "r.*").filter(F.col("query") != "")
    same = Window.partitionBy("query_id", F.lower(T.squash("query")), "category").orderBy("at")
    first = rows.withColumn("n", F.row_number().over(same)).filter("n = 1")
    total = F.lit(None).cast("double")
    for g, w in totals.items():
        total = F.when(F.col("run_group") == g, w).otherwise(total)
    numbered = first.withColumn("run_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    share = F.round(total / F.count(F.lit(1)).over(Window.partitionBy("query_id", "run_group")), 6)
    return numbered.withColumn("weight", share).select("query_id", "run_ord", "query", "category", "aspect", "run_group", "weight")


def legacy_run_specs(plans: DataFrame) -> DataFrame:
    """(query_id, run_ord, query, category, aspect, run_group, weight): each aspect and sub-query, alone and per category.

    Runs aren't told apart and all weigh 1.
    """

    def spec(query: Column, category: Column, aspect: Column, group: str) -> Column:
        return F.struct(T.strip(query).alias("query"), category.cast("string").alias("category"), aspect.cast("string").alias("aspect"), F.lit(group).alias("run_group"))

    none = F.lit(None)
    per_aspect = F.flatten(F.transform("aspects", lambda a: F.concat(F.array(spec(a["search"], none, a["name"], "global_expansion")), F.transform(F.slice(a["categories"], 1, 8), lambda c: spec(a["search"], c, a["name"], "filtered_expansion")))))
    per_sub = F.flatten(F.transform("sub_queries", lambda s: F.concat(F.array(spec(s, none, none, "global_expansion")), F.transform("categories", lambda c: spec(s, c, none, "filtered_expansion")))))
    rows = plans.select("query_id", F.posexplode(F.concat(per_aspect, per_sub)).alias("at", "r"))
    return rows.select("query_id", (F.col("at") + 1).alias("run_ord"), "r.*", F.lit(1.0).alias("weight"))
