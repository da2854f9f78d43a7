"""Retrieval evaluation: graded metrics, pooling, agreement, routing and latency summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

RELEVANT = 2


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ranking_metrics(rankings: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Metrics per (query_id, system) of rankings (query_id, system, chunk_id, rank) against grades of the whole pool.

    Only queries with a relevant chunk (grade 2 or more) are evaluable and have a row. Precision is by k, recall by all
    relevant chunks of the pool, and the ideal of nDCG are the pool's best k grades.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id"))
    pool = grades.withColumn("i", best).groupBy("query_id").agg(F.count_if(F.col("grade") >= RELEVANT).alias("relevant"), F.sum(F.when(F.col("i") <= k, _gain(F.col("grade"), F.col("i")))).alias("ideal"))
    judged = rankings.filter(F.col("rank") <= k).join(grades, ["query_id", "chunk_id"])
    good = F.col("grade") >= RELEVANT
    per = judged.groupBy("query_id", "system").agg(
        F.count_if(good).alias("found"), F.min(F.when(good, F.col("rank"))).alias("first_rank"), F.sum(_gain(F.col("grade"), F.col("rank"))).alias("gain"), F.max(F.when(F.col("rank") == 1, F.col("grade"))).alias("top_grade")
    )
    runs = rankings.select("query_id", "system").distinct()
    out = runs.join(pool.filter("relevant > 0"), "query_id").join(per, ["query_id", "system"], "left")
    found = F.coalesce("found", F.lit(0))
    return out.select(
        "query_id", "system", "relevant", found.alias("found"), F.round(found / F.col("relevant"), 4).alias("recall"), F.round(found / k, 4).alias("precision"), (found > 0).cast("int").alias("hit"),
        F.coalesce("first_rank", F.lit(0)).alias("first_rank"), F.coalesce(F.round(1 / F.col("first_rank"), 4), F.lit(0.0)).alias("reciprocal_rank"), F.round(F.coalesce("gain", F.lit(0.0)) / F.col("ideal"), 4).alias("ndcg"), F.coalesce("top_grade", F.lit(0)).alias("top_grade"),
    )


def ranking_violations(rankings: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, system, problem): a chunk ranked twice, one without a grade, a query without a relevant chunk."""
    twice = rankings.groupBy("query_id", "system", "chunk_id").count().filter("count > 1").select("query_id", "system", F.lit("duplicate").alias("problem"))
    unjudged = rankings.join(grades, ["query_id", "chunk_id"], "left_anti").select("query_id", "system", F.lit("unjudged").alias("problem"))
    good = grades.filter(F.col("grade") >= RELEVANT).select("query_id").distinct()
    none = rankings.join(good, "query_id", "left_anti").select("query_id", "system", F.lit("no relevant").alias("problem"))
    return twice.unionByName(unjudged).unionByName(none).distinct()


def system_summary(metrics: DataFrame) -> DataFrame:
    """Mean metrics per system over the evaluable queries."""
    means = [F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "hit", "reciprocal_rank", "ndcg")]
    return metrics.groupBy("system").agg(F.count(F.lit(1)).alias("queries"), *means)


def pool_rankings(rankings: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, chunk_id, systems, provenance, place): the union of all systems' rankings in a blind order."""
    provenance = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("system", "rank"))), lambda x: F.concat(x["system"], F.lit("="), x["rank"].cast("string"))), ",")
    pooled = rankings.groupBy("query_id", "chunk_id").agg(F.countDistinct("system").alias("systems"), provenance.alias("provenance"))
    blind = Window.partitionBy("query_id").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "query_id", "chunk_id"), 256))
    return pooled.withColumn("place", F.row_number().over(blind))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(pairs, exact, within_one, severe and their rates) of two integer columns, rows with a null left out."""
    gap = F.abs(F.col(a) - F.col(b))
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = F.count(F.lit(1))
    counts = {"exact": F.count_if(gap == 0), "within_one": F.count_if(gap <= 1), "severe": F.count_if(gap >= 2)}
    return both.agg(n.alias("pairs"), *[c.alias(k) for k, c in counts.items()], *[F.round(c / n, 4).alias(f"{k}_rate") for k, c in counts.items()])


def latency_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, level, samples, average, median, most): per group and, at level total, over all; medians are exact.

    Counts per distinct value come first, so that a group that holds a third of all samples isn't gathered by rows.
    """
    from pyspark.sql import Window as W

    counted = samples.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    every = counted.groupBy(value).agg(F.sum("n").alias("n")).withColumn(group, F.lit(None).cast("string")).withColumn("level", F.lit("total"))
    both = counted.withColumn("level", F.lit("group")).unionByName(every)
    part = W.partitionBy("level", group)
    ranked = both.withColumn("upto", F.sum("n").over(part.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(part))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(value)))
    median = (at(F.floor((F.col("all") + 1) / 2)) + at(F.floor(F.col("all") / 2) + 1)) / 2
    return ranked.groupBy("level", group).agg(F.sum("n").alias("samples"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 4).alias("average"), F.round(median, 4).alias("median"), F.round(F.max(value), 4).alias("most"))


def oracle_routes(metrics: DataFrame, direct: str, planned: str, margin: float = 0.05) -> DataFrame:
    """(query_id, oracle, delta, benefit): the better of two systems per query (nDCG, recall, then direct) and by how much."""
    one, two = (metrics.filter(F.col("system") == s).select("query_id", F.col("ndcg").alias(f"{n}_ndcg"), F.col("recall").alias(f"{n}_recall")) for s, n in ((direct, "d"), (planned, "p")))
    both = one.join(two, "query_id")
    better = F.struct("p_ndcg", "p_recall") > F.struct(F.col("d_ndcg").alias("p_ndcg"), F.col("d_recall").alias("p_recall"))
    delta = F.round(F.col("p_ndcg") - F.col("d_ndcg"), 4)
    benefit = F.when(delta > margin, "planned_better").when(delta < -margin, "direct_better").otherwise("comparable")
    return both.select("query_id", F.when(better, planned).otherwise(direct).alias("oracle"), delta.alias("delta"), benefit.alias("benefit"))


def question_issue(low: int = 8, high: int = 180) -> Column:
    """The first rule that a generated question breaks, or null."""
    q = T.strip(F.coalesce("question", F.lit("")))
    needs = F.size("information_needs")
    return (
        F.when((F.char_length(q) < low) | (F.char_length(q) > high) | q.contains("\n"), "invalid_question_length")
        .when(q.rlike(r"(?i)\b(?:direct|planned)\b|路由模式"), "route_label_leakage")
        .when(F.coalesce(T.strip("scenario"), F.lit("")) == "", "missing_scenario")
        .when(F.col("topics").isNull() | ~F.size("topics").between(1, 4), "invalid_topics")
        .when(F.col("information_needs").isNull() | F.exists("information_needs", lambda n: F.coalesce(T.strip(n), F.lit("")) == ""), "invalid_information_needs")
        .when((F.col("intended_route") == "direct") & (needs != 1), "direct_need_count")
        .when((F.col("intended_route") == "planned") & ~needs.between(2, 4), "planned_need_count")
    )


def usable_evidence(text: str = "text", heading: str = "heading_path") -> Column:
    """450 to 2600 characters, no reference section, fewer than four code fences, 45 % letters and digits."""
    t, h = F.coalesce(text, F.lit("")), F.lower(F.coalesce(heading, F.lit("")))
    fences = (F.char_length(t) - F.char_length(F.replace(t, F.lit("```"), F.lit("")))) / 3
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return F.char_length(t).between(450, 2600) & ~h.rlike("references|bibliography|installation|news:") & (fences < 4) & (letters / F.greatest(F.lit(1), F.char_length(t)) >= 0.45)


def stratified_sample(chunks: DataFrame, stratum: str, per: int, seed: int) -> DataFrame:
    """(stratum, chunk_id, place): per stratum the chunks with the least hashes, preferring different sources."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), stratum, "chunk_id"), 256)
    first = F.row_number().over(Window.partitionBy(stratum, "source_id").orderBy("key"))
    # No source can give more than `per`; that is cut before the strata are sorted, and before the shuffle.
    placed = chunks.withColumn("key", key).withColumn("nth", first).filter(F.col("nth") <= per)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), "key"))
    return placed.withColumn("place", place).filter(F.col("place") <= per).select(stratum, "chunk_id", "place")


def judgments_of(content: str | None, expected: list[str]) -> tuple[list[tuple[str, int, str]], str | None]:
    """([(chunk_id, relevance, reason)] in the order of the request, problem) of a model's reply; rows only without a problem."""
    text = (content or "").strip()
    if text.startswith("```"):
        lines = text.splitlines()[1:]
        text = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines).strip()
    try:
        payload = json.loads(text)
    except json.JSONDecodeError:
        return [], "not JSON"
    if not isinstance(payload, dict) or not isinstance(payload.get("judgments"), list):
        return [], "no judgments array"
    if len(set(expected)) != len(expected):
        return [], "request has duplicates"
    seen: dict[str, tuple[str, int, str]] = {}
    for item in payload["judgments"]:
        if not isinstance(item, dict):
            return [], "judgment is no object"
        key, grade = str(item.get("chunk_id") or "").strip(), item.get("relevance")
        if key not in expected:
            return [], "unknown chunk_id"
        if key in seen:
            return [], "duplicate chunk_id"
        if isinstance(grade, bool) or not isinstance(grade, int) or not 0 <= grade <= 3:
            return [], "invalid relevance"
        seen[key] = (key, grade, str(item.get("reason") or "").strip())
    return ([], "omitted chunk_id") if len(seen) < len(expected) else ([seen[c] for c in expected], None)


def parse_judgments(replies: DataFrame) -> DataFrame:
    """(query_id, place, chunk_id, relevance, reason, problem) of (query_id, content, expected): rejected replies give one row with the problem."""
    kind = "struct<rows: array<struct<chunk_id: string, relevance: int, reason: string>>, problem: string>"
    parsed = replies.select("query_id", F.udf(judgments_of, kind, useArrow=True)("content", "expected").alias("p"))
    return parsed.select("query_id", "p.problem", F.posexplode_outer("p.rows").alias("at", "r")).select("query_id", (F.col("at") + 1).alias("place"), "r.*", "problem")


def _term_hits(text: Column, terms: list[str]) -> Column:
    return sum((F.when(F.contains(F.lower(text), F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))


def response_checks(responses: DataFrame, case: dict) -> DataFrame:
    """(id, check, required, passed) of end-to-end responses against what a case expects.

    responses are (id, ok, quality_pass, answer, aspects, categories, sources, memory_answer_mode, retrieved, stored)
    with the names found and the text of the sources. A response that isn't ok has that one check. The case may hold
    must_quality_pass; expected_aspects, expected_categories, expected_source_terms and expected_answer_terms, each
    with the least number of hits as least_..., all of them by default; memory_answer_mode, least_retrieved,
    most_stored; and insufficient_terms, one of which the answer must hold. What it doesn't hold isn't checked.
    """
    answer = F.coalesce("answer", F.lit(""))
    found = lambda c, wanted: F.size(F.array_intersect(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, wanted))))
    counts = {"aspects": lambda w: found("aspects", w), "categories": lambda w: found("categories", w), "source_terms": lambda w: _term_hits(F.coalesce("sources", F.lit("")), w), "answer_terms": lambda w: _term_hits(answer, w)}
    must = bool(case.get("must_quality_pass"))
    checks = [("response_ok", True, F.lit(True)), ("quality", must, F.coalesce("quality_pass", F.lit(False)) if must else F.lit(True))]
    for name, count in counts.items():
        if wanted := case.get(f"expected_{name}"):
            least = case.get(f"least_{name}", len(wanted))
            checks.append((name, least > 0, count(wanted) >= least))
    if "memory_answer_mode" in case:
        checks.append(("memory_answer_mode", True, F.coalesce("memory_answer_mode", F.lit(False)) == F.lit(bool(case["memory_answer_mode"]))))
    if "least_retrieved" in case:
        checks.append(("long_memory_retrieved", True, F.coalesce("retrieved", F.lit(0)) >= case["least_retrieved"]))
    if "most_stored" in case:
        checks.append(("long_memory_stored", True, F.coalesce("stored", F.lit(0)) <= case["most_stored"]))
    if terms := case.get("insufficient_terms"):
        checks.append(("insufficient_boundary", True, _term_hits(answer, terms) > 0))
    row = lambda name, required, passed: F.struct(F.lit(name).alias("check"), F.lit(required).alias("required"), passed.alias("passed"))
    listed = F.when(F.coalesce("ok", F.lit(False)), F.array(*[row(*c) for c in checks])).otherwise(F.array(row("response_ok", True, F.lit(False))))
    return responses.select("id", F.explode(listed).alias("c")).select("id", "c.*")


def contract_checks(responses: DataFrame, mode: str, categories: list[str], most_seconds: float, least_categories: int | None = None) -> DataFrame:
    """(id, check, passed): the twelve conditions of the response contract.

    responses are (id, ok, answer, sources, requested_mode, retrieval_mode, selected_mode, fusion_mode,
    planner_version, provider, seconds), sources an array of structs of index, url and category.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    sources = F.coalesce("sources", F.array())
    cited = F.transform(F.regexp_extract_all(text("answer"), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    least = least_categories if least_categories is not None else int(bool(categories))
    planner = F.col("planner_version").isNull() if mode == "direct" else text("planner_version") == "rules_v3_conservative"
    hits = F.size(F.array_intersect(F.transform(sources, lambda s: text(s["category"])), F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")))
    checks = {
        "response_ok": F.coalesce("ok", F.lit(False)),
        "answer_nonempty": T.strip(text("answer")) != "",
        "sources_present": F.size(sources) > 0,
        "source_urls_present": F.forall(sources, lambda s: F.trim(text(s["url"])) != ""),
        "expected_category_present": hits >= least,
        "citation_present": F.arrays_overlap(cited, F.transform(sources, lambda s: s["index"])),
        "requested_mode": text("requested_mode") == mode,
        "selected_mode": (text("retrieval_mode") == mode) & (text("selected_mode") == mode),
        "conservative_fusion": text("fusion_mode") == "conservative",
        "planner_shape": planner,
        "local_generation": text("provider") == "ollama",
        "latency_budget": F.coalesce(F.col("seconds") <= most_seconds, F.lit(False)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return responses.select("id", F.explode(rows).alias("c")).select("id", "c.*")
