"""Queries of whole retrieval paths, seams, prompts, near-duplicate removal and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import sql as S
from siltstone.functions import text as T
from siltstone.operators import dedupe, fusion, memory, planning, retrieval, safety
from siltstone.operators import fixed as X
from siltstone.operators import evaluation as E
from siltstone.plans import evaluation as V
from siltstone.plans import index as N
from siltstone.plans import retrieval as R
from siltstone.plans.registry import Registry
from siltstone.sources import html
from siltstone.sources.inputs import asked, current_chunks, grades, turns
from siltstone.sources.tables import table
from siltstone.streaming import ingest

registry = Registry()
add = registry.add


@add("b01_html_to_markdown")
def b01(spark, d):
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><nav>menu</nav><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.coalesce("text", F.lit("")), F.lit("</p><script>x()</script><ul><li>one<li>two</ul></body></html>"))
    return table(spark, d, "documents").select("doc_id", html.markdown(page).alias("markdown"))


_DEFINED = r"```[a-z]*\n(def load\([^`]*?)\n```"


@add("b04_python_symbols", rf"""WITH wanted AS (SELECT DISTINCT lower(trim(source_id)) AS source_id, extract_symbol FROM source_manifest WHERE extract_symbol IS NOT NULL AND source_id IS NOT NULL),
held AS (SELECT doc_id, coalesce(extract_symbol, 'Page.load') AS extract_symbol, regexp_extract(text, '{_DEFINED}', 1) AS code FROM documents LEFT JOIN wanted ON lower(trim(source)) = source_id WHERE text IS NOT NULL AND contains(text, '```'))
SELECT doc_id, sha256(CASE WHEN code <> '' THEN '# Official symbol: ' || extract_symbol || chr(10) || replace(code, chr(10), chr(10) || '    ') END) AS text_hash, CASE WHEN code = '' THEN 'not defined: ' || extract_symbol END AS error FROM held""")
def b04(spark, d):
    wanted = table(spark, d, "source_manifest").filter("extract_symbol is not null and source_id is not null").select(F.lower(F.trim("source_id")).alias("source_id"), "extract_symbol").distinct()
    docs = table(spark, d, "documents").filter(F.col("text").contains("```")).select("doc_id", F.lower(F.trim("source")).alias("source_id"), F.regexp_extract("text", _DEFINED, 1).alias("code"))
    held = docs.join(wanted, "source_id", "left").withColumn("extract_symbol", F.coalesce("extract_symbol", F.lit("Page.load")))
    body = F.when(F.col("code") == "", "    pass").otherwise(F.regexp_replace("code", "(?m)^", "    "))
    made = held.withColumn("source", F.concat(F.lit("class "), F.substring_index("extract_symbol", ".", 1), F.lit(":\n"), body)).withColumn("s", html.symbol("source", "extract_symbol"))
    return made.select("doc_id", T.sha256("s.text").alias("text_hash"), F.col("s.error").alias("error"))


@add("e02_planned_retrieval")
def e02(spark, d):
    return retrieval.planned_retrieve(asked(spark, d), current_chunks(spark, d)).select("query_id", "chunk_id", "rank")


@add("e02_conservative_retrieval")
def e02_conservative(spark, d):
    return retrieval.planned_retrieve(asked(spark, d), current_chunks(spark, d), conservative=True).select("query_id", "chunk_id", "rank")


@add("e01_legacy_retrieval")
def e01(spark, d):
    return retrieval.legacy_retrieve(asked(spark, d), current_chunks(spark, d)).select("query_id", "chunk_id", "rank")


@add("c20_direct_lexical")
def c20(spark, d):
    return retrieval.direct_retrieve(asked(spark, d), current_chunks(spark, d)).select("query_id", "chunk_id", "rank", "score")


@add("e10_plan_coverage")
def e10(spark, d):
    c = R._candidates(spark, d)
    plans = planning.plan(R._asked(spark, d)).select("query_id", "aspects", "categories")
    return retrieval.cover_plan(c, plans, 5, by_rank=True)


_REQUIRED = f"CASE WHEN len(aspects) = 0 THEN '' ELSE chr(10) || {S.lit(X.REQUIREMENTS[0])} || chr(10) || array_to_string(list_transform(aspects, lambda a, i: i || '. ' || a.name), chr(10)) || chr(10) || {S.lit(X.REQUIREMENTS[1])} END"


@add("g02_prompts", f"""WITH {S.TURNS}, {N._COVER} SELECT p.query_id AS id, sha256({_REQUIRED} || chr(10) || '问题：' || {S.strip("question")} || chr(10) || '资料：' || chr(10) || coalesce(source_titles_json, '[]')) AS hash FROM plans p JOIN spoken t ON t.id = p.query_id""")
def g02(spark, d):
    t = planning.plan(turns(spark, d).filter("user_text is not null and answer is not null").withColumn("question", F.col("user_text")))
    prompt = F.concat(safety.requirement_list(F.transform("aspects", lambda a: a["name"])), F.lit("\n问题："), T.strip(F.col("question")), F.lit("\n资料：\n"), F.coalesce("source_titles_json", F.lit("[]")))
    return t.select("id", T.sha256(prompt).alias("hash"))


@add("g06_policy_answers", f"WITH x AS ({N._SCREEN}) SELECT DISTINCT action, CASE action WHEN 'refuse' THEN '结论：无法执行该请求。' WHEN 'insufficient' THEN '结论：根据当前知识库资料不足以回答。' END AS answer FROM x")
def g06(spark, d):
    return N._screened(spark, d).select(F.col("s.action").alias("action"), F.when(F.col("s.action") == "refuse", "结论：无法执行该请求。").when(F.col("s.action") == "insufficient", "结论：根据当前知识库资料不足以回答。").alias("answer")).distinct()


@add("g13_quality", f"""{N._COVERAGE}, s AS (SELECT query_id AS id, CASE WHEN n = 0 THEN 5.0::DOUBLE ELSE round(5.0::DOUBLE * covered / n, 1) END AS score, missing FROM g), {N._AUDIT.replace(S.TURNS + ", ", "", 1)}
SELECT id, CASE WHEN (len(valid) > 0 OR insufficient) AND len(outside) = 0 AND (listed OR insufficient) THEN 10 ELSE 0 END + CASE WHEN missing = 0 AND score >= 4 THEN 5 ELSE 0 END + score AS quality FROM s JOIN a0 USING (id)""")
def g13(spark, d):
    from siltstone.operators import safety

    t = turns(spark, d).filter("user_text is not null and answer is not null").withColumn("question", F.col("user_text"))
    c = planning.plan(t).withColumn("c", safety.coverage_audit("answer", F.transform("aspects", lambda a: a["name"]))).withColumn("a", safety.citation_audit("answer", F.lit(3)))
    return c.select("id", (F.when(F.col("a.passed"), 10).otherwise(0) + F.when(F.col("c.passed"), 5).otherwise(0) + F.col("c.score")).alias("quality"))


@add("i24_rerankers", f"""WITH {R._LEX}, {S.GRADES}, rankings AS (SELECT query_id, 'fused' AS system, chunk_id, rank FROM cand UNION ALL SELECT query_id, 'lexical', chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, distance, chunk_id) AS INTEGER) FROM s), {V._metrics_sql(5)}
SELECT system, count(*) AS queries, {V._MEANS} FROM metrics GROUP BY system""")
def i24(spark, d):
    c = R._candidates(spark, d)
    both = c.select("query_id", F.lit("fused").alias("system"), "chunk_id", "rank").unionByName(fusion.lexical_rerank(c).select("query_id", F.lit("lexical").alias("system"), "chunk_id", "rank"))
    return E.system_summary(E.ranking_metrics(both, grades(spark, d), 5))


@add("i31_unjudged_by_system", f"WITH {V._RANK} SELECT system, count(*) AS unjudged FROM rankings r WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.query_id = r.query_id AND g.chunk_id = r.chunk_id) GROUP BY system")
def i31(spark, d):
    return V._rankings(spark, d).join(grades(spark, d), ["query_id", "chunk_id"], "left_anti").groupBy("system").agg(F.count(F.lit(1)).alias("unjudged"))


@add("i36_greedy_dedupe")
def i36(spark, d):
    return dedupe.greedy_dedupe(table(spark, d, "embeddings"), "vec_id", "label", "embedding")


@add("i09_system_grid", f"{R._SYSTEMS} SELECT system, count(DISTINCT query_id) AS queries, count(*) AS rows FROM rankings GROUP BY system")
def i09(spark, d):
    return R._systems(spark, d).groupBy("system").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("rows"))


@add("i09_system_metrics", f"{R._SYSTEMS}, {S.GRADES}, {V._metrics_sql(10)} SELECT * FROM metrics")
def i09_metrics(spark, d):
    return E.ranking_metrics(R._systems(spark, d), grades(spark, d), 10)


@add("i09_system_pool", f"{R._SYSTEMS}, {V._POOLED} SELECT * FROM pooled")
def i09_pool(spark, d):
    return E.pool_rankings(R._systems(spark, d))


@add("h07_streamed", f"WITH {N._UP} SELECT namespace, content_hash, importance, kind, times FROM up")
def h07_streamed(spark, d):
    target = ingest.shared_folder(spark, "memories")
    ingest.stream_memories(spark, f"{d}/turns.parquet", target, target + ".progress")
    return ingest.read_memories(spark, target).select("namespace", "content_hash", "importance", "kind", "times")


@add("s01_windowed_events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def s01(spark, d):
    return ingest.windowed_counts(table(spark, d, "events"))


_SPECS = [("g1", "c1", 0.8, 7), ("g1", "c1", 0.8, 7), ("g2", "", 0.8, 7), ("g3", "c3", 1.5, 7), ("g4", "c4", 0.5, 0)]
_SPEC_ROWS = "gate AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {k})" for a, b, c, k in _SPECS) + ") t(gate_id, case_id, least, top_k))"


@add("f13_gate_specs", f"""WITH {_SPEC_ROWS}, p AS (SELECT gate_id, case_id, count(*) OVER (PARTITION BY gate_id, case_id) AS n, least, top_k FROM gate)
SELECT DISTINCT gate_id, problem FROM (SELECT gate_id, unnest(list_filter([CASE WHEN case_id = '' THEN 'no case id' END, CASE WHEN n > 1 THEN 'duplicate case' END, CASE WHEN least NOT BETWEEN 0 AND 1 THEN 'rate out of range' END, CASE WHEN top_k <= 0 THEN 'no depth' END], lambda x: x IS NOT NULL)) AS problem FROM p)""")
def f13(spark, d):
    from pyspark.sql import Window

    gate = spark.createDataFrame(_SPECS, "gate_id string, case_id string, least double, top_k int")
    n = F.count(F.lit(1)).over(Window.partitionBy("gate_id", "case_id"))
    problems = F.array_compact(F.array(F.when(F.col("case_id") == "", "no case id"), F.when(F.col("n") > 1, "duplicate case"), F.when(~F.col("least").between(0, 1), "rate out of range"), F.when(F.col("top_k") <= 0, "no depth")))
    return gate.withColumn("n", n).select("gate_id", F.explode(problems).alias("problem")).distinct()


@add("g03_plain_context", f"""WITH {R._CAND}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, title, text FROM cand),
b AS (SELECT query_id, n, '[' || n || '] ' || coalesce(title, '') || chr(10) || {S.strip("coalesce(text, '')")} AS block FROM r), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY n) AS used FROM b)
SELECT query_id, count(*) AS sources, sha256(string_agg(block, chr(10) || chr(10) ORDER BY n)) AS hash FROM u WHERE n = 1 OR used <= 6000 GROUP BY query_id""")
def g03(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("query_id").orderBy("rank")
    c = R._candidates(spark, d).select("query_id", F.row_number().over(by).alias("n"), "title", "text")
    b = c.select("query_id", "n", F.concat(F.lit("["), "n", F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), T.strip(F.coalesce("text", F.lit("")))).alias("block"))
    used = F.sum(F.char_length("block")).over(Window.partitionBy("query_id").orderBy("n"))
    kept = b.withColumn("used", used).filter("n = 1 or used <= 6000")
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), T.sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n")).alias("hash"))


@add("i38_novelty", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
m AS (SELECT q.vec_id, max(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))) AS nearest FROM u q, u v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id GROUP BY 1) SELECT vec_id, round(nearest, 5) AS nearest, nearest < 0.86 AS novel FROM m""")
def i38(spark, d):
    from siltstone.operators import dense

    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / norm).alias("embedding"))
    near = dense.l2_search(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 2).filter("vec_id <> query_id")
    cosine = 1 - F.min("distance") / 2
    return near.groupBy(F.col("query_id").alias("vec_id")).agg(F.round(cosine, 5).alias("nearest"), (cosine < 0.86).alias("novel"))



@add("i37_lexical_similarity")
def i37(spark, d):
    """Of every question, the likeness to the most alike of all questions with a lower id."""
    from siltstone.sources.inputs import questions

    return dedupe.prior_likeness(questions(spark, d), "id", "question")


# --- checks of whole responses: turns as the responses, their plans as what was planned --------------------------------

_CASE = {
    "must_quality_pass": True, "expected_aspects": ["evaluation", "techniques"], "least_aspects": 1, "expected_categories": ["retrieval", "evaluation", "embedding"], "least_categories": 1, "expected_source_terms": ["guide", "notes"],
    "expected_answer_terms": ["recall", "召回率"], "least_answer_terms": 1, "memory_answer_mode": False, "least_retrieved": 1, "most_stored": 0, "insufficient_terms": ["资料不足", "不足以回答"],
}
_CITES = r"regexp_matches(coalesce(answer, ''), '\[\d+\]')"
_RESPONSES = rf"""WITH {S.TURNS}, {N._COVER}, resp AS (SELECT p.query_id AS id, {S.strip("p.answer")} <> '' AS ok, regexp_matches(p.answer, '\[\d+\]') AS quality, p.answer, list_transform(p.aspects, lambda a: a.name) AS aspects, p.categories, lower(coalesce(t.source_titles_json, '')) AS sources,
  {N._has(X.MEMORY_QUESTIONS, 'p.question')} AS mem, len(regexp_extract_all(p.answer, '\[\d+\]')) AS retrieved FROM plans p JOIN spoken t ON t.id = p.query_id),
checks AS (SELECT id, unnest(CASE WHEN NOT ok THEN [{{'c': 'response_ok', 'p': false}}] ELSE [{{'c': 'response_ok', 'p': true}}, {{'c': 'quality', 'p': quality}},
 {{'c': 'aspects', 'p': len(list_intersect(aspects, {S.lst(_CASE['expected_aspects'])})) >= 1}}, {{'c': 'categories', 'p': len(list_intersect(categories, {S.lst(_CASE['expected_categories'])})) >= 1}}, {{'c': 'source_terms', 'p': contains(sources, 'guide') AND contains(sources, 'notes')}},
 {{'c': 'answer_terms', 'p': contains(lower(answer), 'recall') OR contains(answer, '召回率')}}, {{'c': 'memory_answer_mode', 'p': NOT mem}}, {{'c': 'long_memory_retrieved', 'p': retrieved >= 1}}, {{'c': 'long_memory_stored', 'p': NOT mem}},
 {{'c': 'insufficient_boundary', 'p': contains(answer, '资料不足') OR contains(answer, '不足以回答')}}] END, recursive := true) FROM resp)"""


def _responses(spark, d):
    t = planning.plan(turns(spark, d).filter("user_text is not null and answer is not null").withColumn("question", F.col("user_text")))
    cites = F.regexp_extract_all("answer", F.lit(r"(\[\d+\])"), F.lit(1))
    asks = memory.is_memory_question("user_text")
    return t.select(
        "id", (T.strip(F.col("answer")) != "").alias("ok"), (F.size(cites) > 0).alias("quality_pass"), "answer", F.transform("aspects", lambda a: a["name"]).alias("aspects"), "categories", F.coalesce("source_titles_json", F.lit("")).alias("sources"),
        asks.alias("memory_answer_mode"), F.size(cites).alias("retrieved"), asks.cast("int").alias("stored"),
    )


@add("i45_response_checks", f"{_RESPONSES} SELECT id, c AS \"check\", true AS required, p AS passed FROM checks")
def i45(spark, d):
    return E.response_checks(_responses(spark, d), _CASE)


@add("i46_response_summary", f"{_RESPONSES}, per AS (SELECT id, bool_and(p) AS passed, count(*) FILTER (c = 'quality' AND p) > 0 AS quality FROM checks GROUP BY 1) SELECT count(*) AS responses, count(*) FILTER (passed) AS passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS pass_rate, round(avg(CASE WHEN quality THEN 1.0 ELSE 0.0 END), 4) AS quality_rate, (SELECT count(*) FILTER (NOT p) FROM checks) AS failed_checks FROM per")
def i46(spark, d):
    checks = E.response_checks(_responses(spark, d), _CASE)
    per = checks.groupBy("id").agg(F.bool_and(~F.col("required") | F.col("passed")).alias("passed"), F.bool_or((F.col("check") == "quality") & F.col("passed")).alias("quality"), F.count_if(~F.col("passed")).alias("failed"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return per.agg(F.count(F.lit(1)).alias("responses"), F.count_if("passed").alias("passed"), rate("passed").alias("pass_rate"), rate("quality").alias("quality_rate"), F.sum("failed").alias("failed_checks"))


_TITLES = "len(regexp_extract_all(coalesce(source_titles_json, ''), '\"[^\"]+\"'))"


@add("i47_contract", rf"""WITH {S.TURNS}, r AS (SELECT id, answer, {_TITLES} AS n, list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{{1,9}})\]', 1), lambda x: CAST(x AS INTEGER)) AS cited, namespace, created_at FROM spoken),
c AS (SELECT id, unnest([{{'c': 'response_ok', 'p': answer IS NOT NULL}}, {{'c': 'answer_nonempty', 'p': {S.strip("coalesce(answer, '')")} <> ''}}, {{'c': 'sources_present', 'p': n > 0}}, {{'c': 'source_urls_present', 'p': n < 3}}, {{'c': 'expected_category_present', 'p': n >= 2}},
 {{'c': 'citation_present', 'p': len(list_filter(cited, lambda x: x BETWEEN 1 AND n)) > 0}}, {{'c': 'requested_mode', 'p': true}}, {{'c': 'selected_mode', 'p': length(id) % 3 > 0}}, {{'c': 'conservative_fusion', 'p': true}}, {{'c': 'planner_shape', 'p': length(coalesce(answer, '')) % 2 = 0}}, {{'c': 'local_generation', 'p': true}},
 {{'c': 'latency_budget', 'p': coalesce(length(answer) / 100.0 <= 3, false)}}], recursive := true) FROM r) SELECT id, c AS "check", p AS passed FROM c""")
def i47(spark, d):
    n = F.size(F.regexp_extract_all(F.coalesce("source_titles_json", F.lit("")), F.lit('("[^"]+")'), F.lit(1)))
    source = lambda i: F.struct(i.cast("int").alias("index"), F.when(i < 3, "https://kb.example").otherwise(F.lit("")).alias("url"), F.when(i == 2, "retrieval").otherwise("other").alias("category"))
    r = turns(spark, d).select(
        "id", F.col("answer").isNotNull().alias("ok"), "answer", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), source)).alias("sources"), F.lit("planned").alias("requested_mode"), F.lit("planned").alias("retrieval_mode"), F.when(F.char_length("id") % 3 > 0, "planned").otherwise("direct").alias("selected_mode"),
        F.lit("conservative").alias("fusion_mode"), F.when(F.char_length(F.coalesce("answer", F.lit(""))) % 2 == 0, "rules_v3_conservative").otherwise("rules_v2").alias("planner_version"), F.lit("ollama").alias("provider"), (F.char_length("answer") / 100).alias("seconds"),
    )
    return E.contract_checks(r, "planned", ["retrieval"], 3.0)
