"""Queries of retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import sql as S
from siltstone.functions import text as T
from siltstone.operators import evaluation as E
from siltstone.operators import planning
from siltstone.plans import retrieval as R
from siltstone.plans.registry import Registry
from siltstone.session import cut
from siltstone.sources.inputs import current_chunks, grades, questions, turns
from siltstone.sources.tables import table

registry = Registry()
add = registry.add

_RANK = f"""{R._FUSED}, {S.GRADES}, rankings AS (SELECT query_id, 'direct' AS system, chunk_id, rank FROM runs WHERE run_ord = 1 UNION ALL SELECT query_id, 'bm25', chunk_id, rank FROM runs WHERE run_ord = 2 UNION ALL SELECT query_id, 'planned', chunk_id, rank FROM fused)"""


def _rankings(spark, d):
    runs = R._runs(spark, d)
    pick = lambda n, name: runs.filter(F.col("run_ord") == n).select("query_id", F.lit(name).alias("system"), "chunk_id", "rank")
    return pick(1, "direct").unionByName(pick(2, "bm25")).unionByName(R._fused(spark, d).select("query_id", F.lit("planned").alias("system"), "chunk_id", "rank"))


def _metrics_sql(k):
    return f"""pool AS (SELECT query_id, count(*) FILTER (grade >= 2) AS relevant, sum(CASE WHEN i <= {k} THEN (pow(2, grade) - 1) / log2(i + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS i FROM grades) GROUP BY 1),
per AS (SELECT query_id, system, count(*) FILTER (grade >= 2) AS found, min(CASE WHEN grade >= 2 THEN rank END) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS gain, max(CASE WHEN rank = 1 THEN grade END) AS top FROM rankings JOIN grades USING (query_id, chunk_id) WHERE rank <= {k} GROUP BY 1, 2),
metrics AS (SELECT r.query_id, r.system, relevant, coalesce(found, 0) AS found, round(coalesce(found, 0) / relevant, 4) AS recall, round(coalesce(found, 0) / {k}, 4) AS precision, CASE WHEN coalesce(found, 0) > 0 THEN 1 ELSE 0 END AS hit, coalesce(first, 0) AS first_rank,
 coalesce(round(1 / first, 4), 0) AS reciprocal_rank, round(coalesce(gain, 0) / ideal, 4) AS ndcg, coalesce(top, 0) AS top_grade FROM (SELECT DISTINCT query_id, system FROM rankings) r JOIN pool USING (query_id) LEFT JOIN per USING (query_id, system) WHERE relevant > 0)"""


@add("i01_metrics", f"WITH {_RANK}, {_metrics_sql(5)} SELECT * FROM metrics")
def i01(spark, d):
    return E.ranking_metrics(_rankings(spark, d), grades(spark, d), 5)


@add("i01_violations", f"""WITH {_RANK} SELECT DISTINCT * FROM (SELECT query_id, system, 'unjudged' AS problem FROM rankings r WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.query_id = r.query_id AND g.chunk_id = r.chunk_id)
 UNION ALL SELECT query_id, system, 'no relevant' FROM rankings r WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.query_id = r.query_id AND grade >= 2) UNION ALL SELECT query_id, system, 'duplicate' FROM rankings GROUP BY query_id, system, chunk_id HAVING count(*) > 1)""")
def i01_violations(spark, d):
    return E.ranking_violations(_rankings(spark, d), grades(spark, d))


@add("i02_ideal_gain", f"WITH {S.GRADES} SELECT query_id, round(sum((pow(2, grade) - 1) / log2(i + 1)), 5) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS i FROM grades) WHERE i <= 10 GROUP BY 1")
def i02(spark, d):
    i = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id"))
    return grades(spark, d).withColumn("i", i).filter("i <= 10").groupBy("query_id").agg(F.round(F.sum(E._gain(F.col("grade"), F.col("i"))), 5).alias("ideal"))


_POOLED = """pool0 AS (SELECT query_id, chunk_id, count(DISTINCT system) AS systems, array_to_string(list_transform(list_sort(list(DISTINCT {'s': system, 'r': rank})), lambda x: x.s || '=' || x.r), ',') AS provenance FROM rankings GROUP BY 1, 2),
pooled AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sha256('42:' || query_id || ':' || chunk_id)) AS INTEGER) AS place FROM pool0)"""
_POOL = f"{_RANK}, {_POOLED}"


@add("i03_pool", f"WITH {_POOL} SELECT * FROM pooled")
def i03(spark, d):
    return E.pool_rankings(_rankings(spark, d))


@add("i04_blinded", f"WITH {_POOL} SELECT query_id, chunk_id, place, 0.0::DOUBLE AS distance, 0.0::DOUBLE AS score, '' AS channels FROM pooled")
def i04(spark, d):
    return E.pool_rankings(_rankings(spark, d)).select("query_id", "chunk_id", "place", F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit("").alias("channels"))


@add("i05_inherited", f"WITH {_POOL}, q AS (SELECT query_id, chunk_id, relevance, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY updated_at DESC NULLS LAST, annotator DESC NULLS LAST, relevance DESC NULLS LAST) AS n FROM qrels) SELECT p.query_id, p.chunk_id, q.relevance, p.place FROM pooled p JOIN q USING (query_id, chunk_id) WHERE n = 1")
def i05(spark, d):
    last = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("annotator"), F.desc_nulls_last("relevance")))
    q = table(spark, d, "qrels").withColumn("n", last).filter("n = 1").select("query_id", "chunk_id", "relevance")
    return E.pool_rankings(_rankings(spark, d)).select("query_id", "chunk_id", "place").join(q, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "relevance", "place")


@add("i06_missing_chunks", f"WITH {S.CURRENT} SELECT DISTINCT chunk_id FROM qrels WHERE chunk_id NOT IN (SELECT chunk_id FROM current)")
def i06(spark, d):
    return table(spark, d, "qrels").filter("chunk_id is not null").select("chunk_id").distinct().join(current_chunks(spark, d).select("chunk_id"), "chunk_id", "left_anti")


_MERGED = """g AS (SELECT query_id, chunk_id, max(relevance) AS relevance, 0 AS ord FROM qrels WHERE relevance BETWEEN 0 AND 3 GROUP BY 1, 2 UNION ALL SELECT query_id, chunk_id, max(llm_relevance), 1 FROM spot_audit GROUP BY 1, 2)"""


@add("i07_merged", f"WITH {_MERGED} SELECT query_id, chunk_id, max_by(relevance, ord) AS relevance, min(ord) AS first_group FROM g GROUP BY 1, 2")
def i07(spark, d):
    a = grades(spark, d).select("query_id", "chunk_id", F.col("grade").alias("relevance"), F.lit(0).alias("ord"))
    b = table(spark, d, "spot_audit").groupBy("query_id", "chunk_id").agg(F.max("llm_relevance").alias("relevance")).withColumn("ord", F.lit(1))
    return a.unionByName(b).groupBy("query_id", "chunk_id").agg(F.max_by("relevance", "ord").alias("relevance"), F.min("ord").alias("first_group"))


@add("i08_pool_summary", f"WITH {_POOL} SELECT split_part(provenance, '=', 1) AS system, count(*) AS only_here FROM pooled WHERE systems = 1 GROUP BY 1")
def i08(spark, d):
    return E.pool_rankings(_rankings(spark, d)).filter("systems = 1").groupBy(F.split_part("provenance", F.lit("="), F.lit(1)).alias("system")).agg(F.count(F.lit(1)).alias("only_here"))


@add("i10_progress", f"WITH {_POOL}, {'j AS (SELECT DISTINCT query_id, chunk_id FROM qrels WHERE relevance BETWEEN 0 AND 3)'} SELECT p.query_id, count(*) AS pooled, count(j.chunk_id) AS judged FROM pooled p LEFT JOIN j USING (query_id, chunk_id) GROUP BY 1")
def i10(spark, d):
    j = grades(spark, d).select("query_id", "chunk_id", F.lit(1).alias("done"))
    return E.pool_rankings(_rankings(spark, d)).join(j, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("pooled"), F.count("done").alias("judged"))


@add("i11_unjudged", f"WITH {_POOL} SELECT query_id, chunk_id FROM pooled p WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.query_id = p.query_id AND g.chunk_id = p.chunk_id)")
def i11(spark, d):
    return E.pool_rankings(_rankings(spark, d)).join(grades(spark, d), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id")


@add("i12_label_problems", "SELECT CASE WHEN relevance IS NULL THEN 'missing grade' WHEN relevance NOT BETWEEN 0 AND 3 THEN 'grade out of range' WHEN coalesce(trim(annotator), '') = '' THEN 'no annotator' ELSE 'fine' END AS problem, count(*) AS rows FROM qrels GROUP BY 1")
def i12(spark, d):
    p = F.when(F.col("relevance").isNull(), "missing grade").when(~F.col("relevance").between(0, 3), "grade out of range").when(F.coalesce(F.trim("annotator"), F.lit("")) == "", "no annotator").otherwise("fine")
    return table(spark, d, "qrels").groupBy(p.alias("problem")).agg(F.count(F.lit(1)).alias("rows"))


@add("i12_parsed_judgments")
def i12_parsed(spark, d):
    """The replies that spot_audit's judgments make, every other one in a code fence, parsed against their requests."""
    a = table(spark, d, "spot_audit").filter("query_id is not null and chunk_id is not null")
    item = F.struct("chunk_id", F.col("llm_relevance").alias("relevance"), F.col("rationale").alias("reason"))
    r = a.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("judgments"))).alias("content"), F.reverse(F.array_sort(F.collect_set("chunk_id"))).alias("expected"))
    fenced = F.when(F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0, F.concat(F.lit("```json\n"), "content", F.lit("\n```"))).otherwise(F.col("content"))
    return E.parse_judgments(r.withColumn("content", fenced))


_AGREE = "count(*) AS pairs, count(*) FILTER (a = b) AS exact, count(*) FILTER (abs(a - b) <= 1) AS within_one, count(*) FILTER (abs(a - b) >= 2) AS severe, round(count(*) FILTER (a = b) / count(*), 4) AS exact_rate, round(count(*) FILTER (abs(a - b) <= 1) / count(*), 4) AS within_one_rate, round(count(*) FILTER (abs(a - b) >= 2) / count(*), 4) AS severe_rate"


@add("i14_agreement", f"WITH s AS (SELECT DISTINCT query_id, chunk_id, human_relevance AS a, llm_relevance AS b FROM spot_audit) SELECT {_AGREE} FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def i14(spark, d):
    pairs = table(spark, d, "spot_audit").select("query_id", "chunk_id", "human_relevance", "llm_relevance").distinct()
    return E.agreement(pairs, "human_relevance", "llm_relevance")


@add("i15_refreshed", f"WITH {S.GRADES}, s AS (SELECT DISTINCT query_id, chunk_id, llm_relevance FROM spot_audit) SELECT s.query_id, s.chunk_id, g.grade AS human, abs(g.grade - llm_relevance) AS difference, g.grade IS NULL AS missing FROM s LEFT JOIN grades g USING (query_id, chunk_id)")
def i15(spark, d):
    s = table(spark, d, "spot_audit").select("query_id", "chunk_id", "llm_relevance").distinct().join(grades(spark, d), ["query_id", "chunk_id"], "left")
    return s.select("query_id", "chunk_id", F.col("grade").alias("human"), F.abs(F.col("grade") - F.col("llm_relevance")).alias("difference"), F.col("grade").isNull().alias("missing"))


@add("i16_label_distribution", "SELECT a.an AS annotator, CAST(g.g AS INTEGER) AS grade, count(q.relevance) AS labels FROM (SELECT DISTINCT lower(trim(annotator)) AS an FROM qrels WHERE annotator IS NOT NULL) a, range(0, 4) g(g) LEFT JOIN qrels q ON lower(trim(q.annotator)) = a.an AND q.relevance = g.g GROUP BY 1, 2")
def i16(spark, d):
    q = table(spark, d, "qrels").filter("annotator is not null").select(F.lower(F.trim("annotator")).alias("annotator"), "relevance")
    counts = q.filter(F.col("relevance").between(0, 3)).groupBy("annotator", F.col("relevance").alias("grade")).agg(F.count(F.lit(1)).alias("n"))
    every = q.select("annotator").distinct().select("annotator", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("grade"))
    return every.join(counts, ["annotator", "grade"], "left").select("annotator", "grade", F.coalesce("n", F.lit(0)).alias("labels"))


@add("i16_review_queue", "SELECT DISTINCT query_id, chunk_id FROM spot_audit WHERE abs(llm_relevance - codex_relevance) >= 2 AND NOT starts_with(coalesce(audit_status, ''), 're')")
def i16_queue(spark, d):
    s = table(spark, d, "spot_audit").filter((F.abs(F.col("llm_relevance") - F.col("codex_relevance")) >= 2) & ~F.coalesce("audit_status", F.lit("")).startswith("re"))
    return s.select("query_id", "chunk_id").distinct()


@add("i17_seeded", "SELECT DISTINCT query_id, chunk_id, llm_relevance AS relevance FROM spot_audit s WHERE EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = s.query_id AND q.chunk_id = s.chunk_id)")
def i17(spark, d):
    pairs = table(spark, d, "qrels").select("query_id", "chunk_id").distinct()
    return table(spark, d, "spot_audit").join(pairs, ["query_id", "chunk_id"], "left_semi").select("query_id", "chunk_id", F.col("llm_relevance").alias("relevance")).distinct()


@add("i18_overview", f"WITH {S.QUESTIONS}, {S.GRADES} SELECT q.id, count(g.chunk_id) AS judged, coalesce(max(g.grade), -1) AS best FROM questions q LEFT JOIN grades g ON g.query_id = q.id GROUP BY 1")
def i18(spark, d):
    return questions(spark, d).select("id").join(grades(spark, d).withColumnRenamed("query_id", "id"), "id", "left").groupBy("id").agg(F.count("chunk_id").alias("judged"), F.coalesce(F.max("grade"), F.lit(-1)).alias("best"))


_MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("recall", "precision", "hit", "reciprocal_rank", "ndcg"))


@add("i19_evaluated_at_10", f"WITH {_RANK}, {_metrics_sql(10)} SELECT query_id, system, recall, ndcg FROM metrics")
def i19(spark, d):
    return E.ranking_metrics(_rankings(spark, d), grades(spark, d), 10).select("query_id", "system", "recall", "ndcg")


@add("i20_system_summary", f"WITH {_RANK}, {_metrics_sql(5)} SELECT system, count(*) AS queries, {_MEANS} FROM metrics GROUP BY system")
def i20(spark, d):
    return E.system_summary(E.ranking_metrics(_rankings(spark, d), grades(spark, d), 5))


_CASES = f"{R._CAND}, ex AS (SELECT query_id, rank, chunk_id, list_contains(q2.topics, category) AS fits, len(list_filter(q2.information_needs, lambda n: contains(lower(coalesce(text, '')), lower(n)))) AS hits, len(q2.information_needs) AS needs FROM cand JOIN (SELECT id, topics, information_needs FROM questions WHERE topics IS NOT NULL AND information_needs IS NOT NULL) q2 ON q2.id = query_id)"


def _cases(spark, d):
    q = questions(spark, d).filter("topics is not null and information_needs is not null").select(F.col("id").alias("query_id"), "topics", "information_needs")
    c = R._candidates(spark, d).join(q, "query_id")
    hits = F.size(F.filter("information_needs", lambda n: F.lower(F.coalesce("text", F.lit(""))).contains(F.lower(n))))
    return c.select("query_id", "rank", "chunk_id", F.coalesce(F.array_contains("topics", F.col("category")), F.lit(False)).alias("fits"), hits.alias("hits"), F.size("information_needs").alias("needs"))


@add("i21_case_checks", f"WITH {_CASES} SELECT query_id, bool_or(coalesce(fits, false)) AS category_pass, coalesce(min(CASE WHEN fits THEN rank END), 0) AS first_rank, round(coalesce(1 / min(CASE WHEN fits THEN rank END), 0), 4) AS reciprocal_rank FROM ex GROUP BY 1")
def i21(spark, d):
    first = F.min(F.when(F.col("fits"), F.col("rank")))
    return _cases(spark, d).groupBy("query_id").agg(F.bool_or("fits").alias("category_pass"), F.coalesce(first, F.lit(0)).alias("first_rank"), F.round(F.coalesce(1 / first, F.lit(0.0)), 4).alias("reciprocal_rank"))


@add("i22_variant_summary", f"WITH {_CASES}, c AS (SELECT query_id, bool_or(coalesce(fits, false)) AS p, coalesce(1 / min(CASE WHEN fits THEN rank END), 0) AS rr FROM ex GROUP BY 1) SELECT count(*) AS cases, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 4) AS pass_rate, round(avg(rr), 4) AS mrr FROM c")
def i22(spark, d):
    c = _cases(spark, d).groupBy("query_id").agg(F.bool_or("fits").alias("p"), F.coalesce(1 / F.min(F.when(F.col("fits"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return c.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("p").cast("int")), 4).alias("pass_rate"), F.round(F.avg("rr"), 4).alias("mrr"))


@add("i23_proxy_grades", f"WITH {_CASES} SELECT query_id, chunk_id, round(CASE WHEN fits THEN 2 ELSE 0 END + CASE WHEN needs > 0 THEN 2.0::DOUBLE * hits / needs ELSE 0 END, 4) AS grade FROM ex")
def i23(spark, d):
    grade = F.when(F.col("fits"), 2.0).otherwise(0.0) + F.when(F.col("needs") > 0, 2.0 * F.col("hits") / F.col("needs")).otherwise(0.0)
    return _cases(spark, d).select("query_id", "chunk_id", F.round(grade, 4).alias("grade"))


@add("i25_hits", f"WITH {_CASES} SELECT query_id, max(CASE WHEN fits AND rank <= 1 THEN 1 ELSE 0 END) AS hit_at_1, max(CASE WHEN fits AND rank <= 3 THEN 1 ELSE 0 END) AS hit_at_3 FROM ex GROUP BY 1")
def i25(spark, d):
    hit = lambda k: F.max(F.when(F.col("fits") & (F.col("rank") <= k), 1).otherwise(0))
    return _cases(spark, d).groupBy("query_id").agg(hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"))


_ORACLE = f"""{_RANK}, {_metrics_sql(5)}, two AS (SELECT d.query_id, d.ndcg AS dn, d.recall AS dr, p.ndcg AS pn, p.recall AS pr FROM metrics d JOIN metrics p USING (query_id) WHERE d.system = 'direct' AND p.system = 'planned'),
oracle AS (SELECT query_id, CASE WHEN pn > dn OR (pn = dn AND pr > dr) THEN 'planned' ELSE 'direct' END AS oracle, round(pn - dn, 4) AS delta FROM two),
benefit AS (SELECT *, CASE WHEN delta > 0.05 THEN 'planned_better' WHEN delta < -0.05 THEN 'direct_better' ELSE 'comparable' END AS benefit FROM oracle)"""


def _oracle(spark, d):
    return E.oracle_routes(E.ranking_metrics(_rankings(spark, d), grades(spark, d), 5), "direct", "planned")


@add("i26_oracle_routes", f"WITH {_ORACLE} SELECT query_id, oracle FROM benefit")
def i26(spark, d):
    return _oracle(spark, d).select("query_id", "oracle")


@add("i33_benefit", f"WITH {_ORACLE} SELECT query_id, delta, benefit FROM benefit")
def i33(spark, d):
    return _oracle(spark, d).select("query_id", "delta", "benefit")


_ROUTED = f"""{R._PLAN2}, {R._ROUTE}, routed AS (SELECT query_id, estimated_ms, CASE WHEN complexity >= 3 AND estimated_ms <= 12000 THEN 'planned' ELSE 'direct' END AS route FROM r)"""


def _routed(spark, d):
    return planning.route(planning.plan(R._asked(spark, d))).select("query_id", "route", "estimated_ms")


def _both(a, b):
    """Two chains of common tables that both begin with the questions."""
    return a + ", " + b.replace(S.QUESTIONS + ", ", "", 1)


@add("i27_routing_summary", f"WITH {_both(_ROUTED, _ORACLE)} SELECT route, count(*) AS queries, count(*) FILTER (route = oracle) AS matches, round(avg(CASE WHEN route = oracle THEN 1.0 ELSE 0.0 END), 4) AS match_rate FROM routed JOIN benefit USING (query_id) GROUP BY route")
def i27(spark, d):
    j = _routed(spark, d).join(_oracle(spark, d), "query_id").withColumn("m", (F.col("route") == F.col("oracle")).cast("int"))
    return j.groupBy("route").agg(F.count(F.lit(1)).alias("queries"), F.sum("m").alias("matches"), F.round(F.avg("m"), 4).alias("match_rate"))


@add("i28_acceptance", f"""WITH {_both(_ROUTED, _ORACLE)}, j AS (SELECT b.*, rt.route, rt.estimated_ms, m.ndcg, m.recall, m.reciprocal_rank AS rr FROM routed rt JOIN benefit b USING (query_id) JOIN metrics m ON m.query_id = rt.query_id AND m.system = rt.route),
dd AS (SELECT avg(ndcg) AS ndcg, avg(recall) AS recall, avg(reciprocal_rank) AS rr FROM metrics WHERE system = 'direct' AND query_id IN (SELECT query_id FROM j)),
aa AS (SELECT avg(ndcg) AS ndcg, avg(recall) AS recall, avg(rr) AS rr, avg(CASE WHEN route = oracle THEN 1.0::DOUBLE ELSE 0 END) AS match, count(*) FILTER (route = 'planned' AND delta < -0.25) AS harm, median(estimated_ms) / 1000 AS seconds FROM j)
SELECT name, passed FROM (SELECT unnest([{{'name': 'auto_ndcg_noninferior', 'passed': aa.ndcg >= dd.ndcg - 0.03}}, {{'name': 'auto_recall_noninferior', 'passed': aa.recall >= dd.recall - 0.03}}, {{'name': 'auto_mrr_noninferior', 'passed': aa.rr >= dd.rr - 0.05}}, {{'name': 'oracle_agreement', 'passed': match >= 0.6}}, {{'name': 'planned_route_worst_case', 'passed': harm = 0}}, {{'name': 'median_latency_within_budget', 'passed': seconds <= 4.0}}], recursive := true) FROM aa, dd)""")
def i28(spark, d):
    m = E.ranking_metrics(_rankings(spark, d), grades(spark, d), 5)
    # Routes are large expressions over the plan; written out they are made once.
    j = cut(_routed(spark, d)).join(E.oracle_routes(m, "direct", "planned"), "query_id")
    auto = j.join(m.withColumnRenamed("system", "route"), ["query_id", "route"]).select("query_id", "route", "estimated_ms", "oracle", "delta", "ndcg", "recall", F.col("reciprocal_rank").alias("rr"))
    direct = m.filter("system = 'direct'").select("query_id", F.col("ndcg").alias("d_ndcg"), F.col("recall").alias("d_recall"), F.col("reciprocal_rank").alias("d_rr"))
    s = auto.join(direct, "query_id").agg(
        *[F.avg(c).alias(c) for c in ("ndcg", "recall", "rr", "d_ndcg", "d_recall", "d_rr")], F.avg((F.col("route") == F.col("oracle")).cast("double")).alias("match"), F.count_if((F.col("route") == "planned") & (F.col("delta") < -0.25)).alias("harm"), (F.median("estimated_ms") / 1000).alias("seconds")
    )
    checks = {"auto_ndcg_noninferior": F.col("ndcg") >= F.col("d_ndcg") - 0.03, "auto_recall_noninferior": F.col("recall") >= F.col("d_recall") - 0.03, "auto_mrr_noninferior": F.col("rr") >= F.col("d_rr") - 0.05, "oracle_agreement": F.col("match") >= 0.6, "planned_route_worst_case": F.col("harm") == 0, "median_latency_within_budget": F.col("seconds") <= 4.0}
    return s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in checks.items()])).alias("c")).select("c.name", "c.passed")


@add("i29_latency", "SELECT event_type, 'group' AS level, count(value) AS samples, round(avg(value), 4) AS average, round(median(value), 4) AS median, round(max(value), 4) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type UNION ALL SELECT NULL, 'total', count(value), round(avg(value), 4), round(median(value), 4), round(max(value), 4) FROM events WHERE value IS NOT NULL")
def i29(spark, d):
    return E.latency_summary(table(spark, d, "events"), "event_type", "value")


@add("i30_order_equality", f"WITH {_RANK}, l AS (SELECT query_id, system, string_agg(chunk_id, ',' ORDER BY rank) AS o, string_agg(chunk_id, ',' ORDER BY chunk_id) AS s FROM rankings WHERE rank <= 3 GROUP BY 1, 2) SELECT count(*) AS queries, count(*) FILTER (a.o = b.o) AS same_order, count(*) FILTER (a.s = b.s) AS same_set FROM l a JOIN l b USING (query_id) WHERE a.system = 'direct' AND b.system = 'planned'")
def i30(spark, d):
    lists = _rankings(spark, d).filter("rank <= 3").groupBy("query_id", "system").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("o"))
    a, b = (lists.filter(F.col("system") == s).select("query_id", F.col("o").alias(n)) for s, n in (("direct", "a"), ("planned", "b")))
    return a.join(b, "query_id").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("a") == F.col("b")).alias("same_order"), F.count_if(F.array_sort("a") == F.array_sort("b")).alias("same_set"))


@add("i32_route_confusion", f"WITH {_ROUTED} SELECT coalesce(q.intended_route, 'unknown') AS intended, r.route, count(*) AS questions FROM routed r JOIN questions q ON q.id = r.query_id GROUP BY 1, 2")
def i32(spark, d):
    q = questions(spark, d).select(F.col("id").alias("query_id"), F.coalesce("intended_route", F.lit("unknown")).alias("intended"))
    return _routed(spark, d).join(q, "query_id").groupBy("intended", "route").agg(F.count(F.lit(1)).alias("questions"))


@add("i34_intent_summary", f"WITH {S.QUESTIONS}, {_ORACLE} SELECT coalesce(q.intended_route, 'unknown') AS intended, b.benefit, count(*) AS questions, round(avg(b.delta), 4) AS delta FROM benefit b JOIN questions q ON q.id = b.query_id GROUP BY ROLLUP (1, 2)")
def i34(spark, d):
    q = questions(spark, d).select(F.col("id").alias("query_id"), F.coalesce("intended_route", F.lit("unknown")).alias("intended"))
    return _oracle(spark, d).join(q, "query_id").rollup("intended", "benefit").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("delta"), 4).alias("delta"))


_Q = S.strip("coalesce(question, '')")


@add("i39_question_issues", rf"""WITH {S.QUESTIONS} SELECT id, CASE WHEN length({_Q}) < 8 OR length({_Q}) > 180 OR contains({_Q}, chr(10)) THEN 'invalid_question_length' WHEN regexp_matches({_Q}, '(?i)\b(?:direct|planned)\b|路由模式') THEN 'route_label_leakage'
 WHEN coalesce({S.strip('scenario')}, '') = '' THEN 'missing_scenario' WHEN topics IS NULL OR len(topics) NOT BETWEEN 1 AND 4 THEN 'invalid_topics' WHEN information_needs IS NULL OR len(list_filter(information_needs, lambda n: coalesce({S.strip('n')}, '') = '')) > 0 THEN 'invalid_information_needs'
 WHEN intended_route = 'direct' AND len(information_needs) <> 1 THEN 'direct_need_count' WHEN intended_route = 'planned' AND len(information_needs) NOT BETWEEN 2 AND 4 THEN 'planned_need_count' END AS issue FROM questions""")
def i39(spark, d):
    return questions(spark, d).select("id", E.question_issue().alias("issue"))


@add("i40_review_issues", f"WITH {S.QUESTIONS} SELECT id, CASE WHEN critic.naturalness IS NULL OR critic.information_need_count IS NULL THEN 'invalid_critic_review' WHEN critic.naturalness < 4 THEN 'critic_low_naturalness' WHEN intended_route = 'direct' AND critic.information_need_count <> 1 THEN 'critic_direct_need_count' WHEN intended_route = 'planned' AND critic.information_need_count < 2 THEN 'critic_planned_need_count' END AS issue FROM questions")
def i40(spark, d):
    n, c = F.col("critic.naturalness"), F.col("critic.information_need_count")
    issue = F.when(n.isNull() | c.isNull(), "invalid_critic_review").when(n < 4, "critic_low_naturalness").when((F.col("intended_route") == "direct") & (c != 1), "critic_direct_need_count").when((F.col("intended_route") == "planned") & (c < 2), "critic_planned_need_count")
    return questions(spark, d).select("id", issue.alias("issue"))


@add("i41_dataset_violations", f"WITH {S.QUESTIONS}, n AS (SELECT {S.squash('lower(question)')} AS q, count(*) AS n FROM questions WHERE question IS NOT NULL GROUP BY 1) SELECT q AS question, n AS times FROM n WHERE n > 1")
def i41(spark, d):
    return questions(spark, d).filter("question is not null").groupBy(T.squash(F.lower("question")).alias("question")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


@add("i42_dataset_summary", f"WITH {S.QUESTIONS} SELECT stratum, topic, count(*) AS questions, min(n) AS shortest, max(n) AS longest FROM (SELECT stratum, unnest(topics) AS topic, CAST(length(question) AS INTEGER) AS n FROM questions) GROUP BY 1, 2")
def i42(spark, d):
    q = questions(spark, d).select("stratum", F.explode("topics").alias("topic"), F.char_length("question").alias("n"))
    return q.groupBy("stratum", "topic").agg(F.count(F.lit(1)).alias("questions"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


_USABLE = r"""length(coalesce(text, '')) BETWEEN 450 AND 2600 AND NOT regexp_matches(lower(coalesce(heading_path, '')), 'references|bibliography|installation|news:') AND (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '```', ''))) / 3 < 4 AND length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) / greatest(1, length(coalesce(text, ''))) >= 0.45"""


@add("i43_usable_evidence", f"WITH {S.CURRENT} SELECT chunk_id FROM current WHERE {_USABLE}")
def i43(spark, d):
    return current_chunks(spark, d).filter(E.usable_evidence()).select("chunk_id")


@add("i44_stratified_sample", f"""WITH {S.CURRENT}, k AS (SELECT coalesce(category, '') AS category, source_id, chunk_id, sha256('7:' || coalesce(category, '') || ':' || chunk_id) AS key FROM current WHERE {_USABLE}),
f AS (SELECT *, row_number() OVER (PARTITION BY category, source_id ORDER BY key) AS nth FROM k) SELECT category, chunk_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, key) AS INTEGER) AS place FROM f) WHERE place <= 3""")
def i44(spark, d):
    c = current_chunks(spark, d).filter(E.usable_evidence()).withColumn("category", F.coalesce("category", F.lit("")))
    return E.stratified_sample(c, "category", 3, 7)
