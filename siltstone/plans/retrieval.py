"""Queries of sparse and dense retrieval, fusion, reranking, selection, planning and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import sql as S
from siltstone.functions import text as T
from siltstone.functions.embedding import CHARACTERS
from siltstone.operators import dense, fusion, planning, retrieval, sparse
from siltstone.operators import fixed as X
from siltstone.plans.registry import Registry
from siltstone.session import cut
from siltstone.sources.inputs import asked, current_chunks, questions
from siltstone.sources.tables import table

registry = Registry()
add = registry.add

_INDEX = "array_to_string([coalesce(title, ''), coalesce(title, ''), coalesce(category, ''), coalesce(category, ''), coalesce(heading_path, ''), coalesce(heading_path, ''), coalesce(text, '')], chr(10))"
_ALIASES = "".join(f" || CASE WHEN contains(replace(lower(question), 'ß', 'ss'), {S.lit(k)}) THEN {S.tokens(S.lit(chr(10).join(v)))} ELSE [] END" for k, v in X.TERM_ALIASES.items())
_TERMS = f"list_distinct({S.tokens('question')}{_ALIASES})"
_BM25 = f"""WITH {S.CURRENT}, {S.ASKED},
tok AS (SELECT chunk_id, {S.tokens(_INDEX)} AS tokens FROM current), facts AS (SELECT count(*) AS n, greatest(1.0, avg(len(tokens))) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
terms AS (SELECT DISTINCT query_id, unnest({_TERMS}) AS term FROM asked),
scores AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM terms JOIN post USING (term) JOIN df USING (term), facts GROUP BY 1, 2)"""


@add("c10_tokens", f"WITH {S.CURRENT} SELECT chunk_id, CAST(len({S.tokens('text')}) AS INTEGER) AS tokens, sha256(array_to_string({S.tokens('text')}, ' ')) AS hash FROM current")
def c10(spark, d):
    t = current_chunks(spark, d).select("chunk_id", T.search_tokens("text").alias("t"))
    return t.select("chunk_id", F.size("t").alias("tokens"), T.sha256(F.array_join("t", " ")).alias("hash"))


@add("c11_index_text", f"WITH {S.CURRENT} SELECT chunk_id, sha256({_INDEX}) AS hash FROM current")
def c11(spark, d):
    return current_chunks(spark, d).select("chunk_id", T.sha256(sparse.index_text()).alias("hash"))


@add("c12_query_terms", f"WITH {S.QUESTIONS} SELECT id, array_to_string(list_sort({_TERMS}), ' ') AS terms FROM questions WHERE question IS NOT NULL")
def c12(spark, d):
    return questions(spark, d).filter("question is not null").select("id", F.array_join(F.array_sort(sparse.query_terms("question")), " ").alias("terms"))


@add("c13_statistics", f"""WITH {S.CURRENT}, tok AS (SELECT chunk_id, {S.tokens(_INDEX)} AS tokens FROM current), n AS (SELECT count(*) AS n FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(tokens) AS term FROM tok) GROUP BY term)
SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, n""")
def c13(spark, d):
    return sparse.bm25_statistics(current_chunks(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@add("c14_bm25_scores", _BM25 + " SELECT query_id, count(*) AS chunks, round(max(score), 4) AS best, round(avg(score), 4) AS average FROM scores GROUP BY query_id")
def c14(spark, d):
    return sparse.bm25_summary(asked(spark, d), current_chunks(spark, d))


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"


@add("c15_bm25_search", _BM25 + f" SELECT query_id, rank, chunk_id, score FROM (SELECT *, CAST({_TOP} AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 10")
def c15(spark, d):
    return sparse.bm25_search(asked(spark, d), current_chunks(spark, d))


@add("c15_bm25_in_category", _BM25 + f" SELECT query_id, rank, chunk_id, score FROM (SELECT s.*, CAST({_TOP} AS INTEGER) AS rank FROM scores s JOIN current c USING (chunk_id) WHERE score > 0 AND c.category = 'retrieval') WHERE rank <= 5")
def c15_category(spark, d):
    return sparse.bm25_search(asked(spark, d), current_chunks(spark, d), 5, "retrieval")


@add("c16_sparse_candidates", _BM25 + f" SELECT query_id, rank, chunk_id, round(1 / (1 + score), 6) AS distance, 'bm25' AS channel FROM (SELECT *, CAST({_TOP} AS INTEGER) AS rank FROM scores WHERE score > 0) WHERE rank <= 10")
def c16(spark, d):
    hits = sparse.as_candidates(sparse.bm25_search(asked(spark, d), current_chunks(spark, d)))
    return hits.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"), "channel")


_L2 = "round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE))), 6)"


@add("c01_l2_search", f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, {_L2} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) SELECT * FROM r WHERE rank <= 10""")
def c01(spark, d):
    e = table(spark, d, "embeddings")
    return dense.l2_search(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e)


@add("c02_l2_in_label", f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, {_L2} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.label = v.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) SELECT * FROM r WHERE rank <= 5""")
def c02(spark, d):
    e = table(spark, d, "embeddings")
    return dense.l2_search(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), e, 5)


@add("i35_cosine", """SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
 / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def i35(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return e.join(after, "vec_id").select("vec_id", F.round(dense.cosine("embedding", "following"), 5).alias("cosine"))


# --- fusion: three runs over the judged pairs of every question -----------------------------------------------------

_RUNS = """pairs AS (SELECT DISTINCT query_id, chunk_id FROM qrels WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL),
runs AS (SELECT * FROM (SELECT query_id, chunk_id, r AS run_ord, CAST(row_number() OVER (PARTITION BY query_id, r ORDER BY sha256(r || ':' || chunk_id)) AS INTEGER) AS rank,
  (strpos('0123456789abcdef', substr(sha256(chunk_id || ':' || r), 1, 1)) - 1) / 16.0::DOUBLE AS distance, CASE r WHEN 2 THEN 'evaluation' WHEN 3 THEN 'techniques' END AS aspect,
  CASE WHEN r = 2 THEN 'bm25' ELSE 'dense' END AS channel, CASE r WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM pairs, (VALUES (1), (2), (3)) t(r)))"""


def _runs(spark, d):
    from pyspark.sql import Window

    pairs = table(spark, d, "qrels").filter("query_id is not null and chunk_id is not null").select("query_id", "chunk_id").distinct()
    r = pairs.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run_ord"))
    by = Window.partitionBy("query_id", "run_ord").orderBy(F.sha2(F.concat_ws(":", "run_ord", "chunk_id"), 256))
    digit = F.conv(F.substring(F.sha2(F.concat_ws(":", "chunk_id", "run_ord"), 256), 1, 1), 16, 10).cast("double") / 16
    aspect = F.when(F.col("run_ord") == 2, "evaluation").when(F.col("run_ord") == 3, "techniques")
    channel = F.when(F.col("run_ord") == 2, "bm25").otherwise("dense")
    weight = F.when(F.col("run_ord") == 1, 2.0).when(F.col("run_ord") == 2, 1.0).otherwise(0.5)
    return r.withColumns({"rank": F.row_number().over(by), "distance": digit, "aspect": aspect, "channel": channel, "weight": weight})


_FUSE = """,
steps AS (SELECT *, min(distance) OVER (PARTITION BY query_id, chunk_id ORDER BY run_ord, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
fuse AS (SELECT query_id, chunk_id, round(sum(weight / (60 + rank)), 9) AS score, min(distance) AS distance,
  coalesce(max_by(aspect, run_ord * 1000000 + rank) FILTER ((before IS NULL OR distance < before) AND aspect IS NOT NULL), min_by(aspect, run_ord * 1000000 + rank) FILTER (aspect IS NOT NULL)) AS aspect,
  array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM steps GROUP BY 1, 2),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) AS INTEGER) AS rank FROM fuse)"""

_FUSED = _RUNS + _FUSE


def _fused(spark, d):
    return fusion.reciprocal_rank_fusion(_runs(spark, d))


@add("c05_rank_fusion", f"WITH {_FUSED} SELECT * FROM fused")
def c05(spark, d):
    return _fused(spark, d)


@add("c06_run_violations", f"WITH {_RUNS} SELECT query_id, run_ord, 'negative weight' AS problem FROM (SELECT *, CASE WHEN run_ord = 3 THEN -weight ELSE weight END AS w FROM runs) GROUP BY 1, 2 HAVING min(w) < 0")
def c06(spark, d):
    return fusion.run_violations(_runs(spark, d).withColumn("weight", F.when(F.col("run_ord") == 3, -F.col("weight")).otherwise(F.col("weight"))))


_CAND = f"""{S.CURRENT}, {S.QUESTIONS}, {_FUSED},
cand AS (SELECT f.*, q.question, c.title, c.category, c.heading_path, c.text, c.source_id FROM fused f JOIN questions q ON q.id = f.query_id JOIN current c USING (chunk_id) WHERE q.question IS NOT NULL)"""


def _candidates(spark, d):
    q = questions(spark, d).filter("question is not null").select(F.col("id").alias("query_id"), "question")
    return _fused(spark, d).join(q, "query_id").join(current_chunks(spark, d).select("chunk_id", "title", "category", "heading_path", "text", "source_id"), "chunk_id")


def _profile(x):
    return "[" + ", ".join(f"100.0::DOUBLE * (length({x}) - length(replace({x}, '{c}', ''))) / greatest(length({x}), 1)" for c in CHARACTERS) + "]"


#: The three systems over real searches: nearest by profile, best by BM25 and both fused, 16 candidates each.
_SYSTEMS = f"""{_BM25}, vec AS (SELECT chunk_id, {_profile('x')} AS embedding FROM (SELECT chunk_id, {_INDEX} AS x FROM current)), qv AS (SELECT query_id, {_profile('question')} AS embedding FROM asked WHERE question IS NOT NULL),
near AS (SELECT query_id, chunk_id, round(list_sum(list_transform(list_zip(qv.embedding, vec.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM qv, vec),
nearest AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM near QUALIFY rank <= 16),
best AS (SELECT query_id, chunk_id, 1 / (1 + score) AS distance, CAST({_TOP} AS INTEGER) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 16),
runs AS (SELECT query_id, chunk_id, rank, distance, 1 AS run_ord, 'dense' AS channel, NULL::VARCHAR AS aspect, 1.0::DOUBLE AS weight FROM nearest UNION ALL SELECT query_id, chunk_id, rank, distance, 2, 'bm25', NULL, 1.0 FROM best){_FUSE},
rankings AS (SELECT query_id, 'dense' AS system, chunk_id, rank FROM nearest UNION ALL SELECT query_id, 'bm25', chunk_id, rank FROM best UNION ALL SELECT query_id, 'hybrid', chunk_id, rank FROM fused WHERE rank <= 16)"""


def _systems(spark, d):
    """(query_id, system, chunk_id, rank): every system run over every asked question."""
    q, c = asked(spark, d), current_chunks(spark, d)
    near = retrieval.dense_candidates(q, c, 16).withColumn("run_ord", F.lit(1))
    best = sparse.as_candidates(sparse.bm25_search(q, c, 16)).withColumn("run_ord", F.lit(2))
    columns = ["query_id", "rank", "chunk_id", "distance", "channel", "run_ord"]
    runs = cut(near.select(*columns).unionByName(best.select(*columns)))
    both = fusion.reciprocal_rank_fusion(runs.withColumn("aspect", F.lit(None).cast("string")).withColumn("weight", F.lit(1.0)))
    fused = both.filter("rank <= 16").select("query_id", F.lit("hybrid").alias("system"), "chunk_id", "rank")
    return runs.select("query_id", F.col("channel").alias("system"), "chunk_id", "rank").unionByName(fused)


@add("c03_hybrid", f"{_SYSTEMS} SELECT query_id, chunk_id, score, rank, channels FROM fused WHERE rank <= 5")
def c03(spark, d):
    hits = retrieval.hybrid_candidates(asked(spark, d), current_chunks(spark, d), 16)
    return retrieval.rerank_candidates(hits.drop("rank"), None, None, 5, "none").select("query_id", "chunk_id", "score", "rank", "channels")


@add("c04_strategies", f"{_SYSTEMS} SELECT system AS strategy, query_id, chunk_id, rank FROM rankings WHERE rank <= 7 UNION ALL SELECT 'other', 'strategy must be dense, hybrid or bm25, not other', NULL, NULL")
def c04(spark, d):
    q, c = asked(spark, d), current_chunks(spark, d)
    found = [retrieval.retrieve(q, c, s, 7, 16).select(F.lit(s).alias("strategy"), "query_id", "chunk_id", "rank") for s in ("dense", "bm25", "hybrid")]
    try:
        retrieval.retrieve(q, c, "other")
    except ValueError as e:
        found.append(spark.createDataFrame([("other", str(e), None, None)], "strategy string, query_id string, chunk_id string, rank int"))
    return reduce(DataFrame.unionByName, found)


@add("i09_system_runs", f"{_SYSTEMS} SELECT query_id, system, chunk_id, rank FROM rankings")
def i09_runs(spark, d):
    return _systems(spark, d)


@add("c22_base_score", f"WITH {_FUSED} SELECT query_id, chunk_id, round(CASE WHEN rank % 2 = 0 THEN 1 / (1 + greatest(0, distance)) ELSE score END, 6) AS base FROM fused")
def c22(spark, d):
    score = F.when(F.col("rank") % 2 == 0, 0.0).otherwise(F.col("score"))
    return _fused(spark, d).select("query_id", "chunk_id", F.round(fusion.base_score(score, F.col("distance")), 6).alias("base"))


@add("c23_min_max", f"WITH {_FUSED} SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM fused WINDOW w AS (PARTITION BY query_id)")
def c23(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.round(fusion.min_max(F.col("score")), 6).alias("scaled"))


_RTOK = f"""list_filter(list_distinct({S.tokens('question', False)}{"".join(f" || CASE WHEN contains(lower(question), {S.lit(k)}) THEN {S.lst(v)} ELSE [] END" for k, v in X.TERM_ALIASES.items())}), lambda t: length(t) >= 2)"""
_LEX = f"""{_CAND}, t AS (SELECT *, {_RTOK} AS tokens, lower(coalesce(title, '')) || ' ' || lower(coalesce(category, '')) || ' ' || lower(coalesce(heading_path, '')) AS head,
  lower(coalesce(title, '')) || chr(10) || lower(coalesce(category, '')) || chr(10) || lower(coalesce(heading_path, '')) || chr(10) || lower(coalesce(text, '')) AS whole, lower(coalesce(category, '')) AS cat FROM cand),
m AS (SELECT *, CASE WHEN len(tokens) = 0 OR whole = '' THEN 0 ELSE len(list_filter(tokens, lambda x: contains(whole, x))) / len(tokens) END AS lexical,
  CASE WHEN len(tokens) = 0 OR head = '' THEN 0 ELSE len(list_filter(tokens, lambda x: contains(head, x))) / len(tokens) END AS heading,
  CASE WHEN len(tokens) = 0 OR cat = '' THEN 0 ELSE len(list_filter(tokens, lambda x: contains(cat, x))) / len(tokens) END AS fits,
  CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS base FROM t WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, round(0.5::DOUBLE * base + 0.3::DOUBLE * lexical + 0.15::DOUBLE * heading + 0.05::DOUBLE * fits, 6) AS blended FROM m)"""


@add("c24_matched_share", f"WITH {_LEX} SELECT query_id, chunk_id, round(lexical, 6) AS lexical, round(heading, 6) AS heading, round(fits, 6) AS category FROM m")
def c24(spark, d):
    r = fusion.lexical_rerank(_candidates(spark, d))
    return r.select("query_id", "chunk_id", F.round("lexical", 6).alias("lexical"), F.round("heading", 6).alias("heading"), F.round("fits", 6).alias("category"))


@add("c21_lexical_rerank", f"WITH {_LEX} SELECT query_id, chunk_id, blended AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, distance, chunk_id) AS INTEGER) AS rank FROM s")
def c21(spark, d):
    return fusion.lexical_rerank(_candidates(spark, d)).select("query_id", "chunk_id", "score", "rank")


@add("c25_rerank_tokens", f"WITH {S.QUESTIONS} SELECT id, array_to_string(list_sort({_RTOK}), '|') AS tokens FROM questions WHERE question IS NOT NULL")
def c25(spark, d):
    return questions(spark, d).filter("question is not null").select("id", F.array_join(F.array_sort(fusion.rerank_tokens("question")), "|").alias("tokens"))


@add("c26_rank_blend", f"WITH {_FUSED}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS other FROM fused), b AS (SELECT query_id, chunk_id, distance, round(0.5::DOUBLE / (60 + rank) + 0.5::DOUBLE / (60 + other), 9) AS score FROM m) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) AS INTEGER) AS rank FROM b")
def c26(spark, d):
    from pyspark.sql import Window

    other = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return fusion.rank_fusion(_fused(spark, d).withColumn("other", other), "rank", "other").select("query_id", "chunk_id", "score", "rank")


@add("c27_reranker_document", f"WITH {S.CURRENT} SELECT chunk_id, sha256('Title: ' || coalesce(title, '') || chr(10) || 'Category: ' || coalesce(category, '') || chr(10) || 'Section: ' || coalesce(heading_path, '') || chr(10) || coalesce(text, '')) AS hash FROM current")
def c27(spark, d):
    parts = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in (("Title", "title"), ("Category", "category"), ("Section", "heading_path"))]
    return current_chunks(spark, d).select("chunk_id", T.sha256(F.concat_ws("\n", *parts, F.coalesce("text", F.lit("")))).alias("hash"))


_HITS = "CASE aspect " + " ".join(f"WHEN {S.lit(a)} THEN len(list_filter({S.lst(t)}, lambda x: contains(body, x)))" for a, t in X.EVIDENCE_TERMS.items()) + " ELSE 0 END"


@add("e08_plan_boosts", f"""WITH {_CAND}, b AS (SELECT *, lower(coalesce(title, '') || chr(10) || coalesce(heading_path, '') || chr(10) || coalesce(text, '')) AS body FROM cand),
s AS (SELECT query_id, chunk_id, distance, round(score + least(0.24::DOUBLE, 0.24::DOUBLE / 6 * ({_HITS})), 6) AS score FROM b)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, chunk_id) AS INTEGER) AS rank FROM s""")
def e08(spark, d):
    return fusion.plan_boosts(_candidates(spark, d)).select("query_id", "chunk_id", "score", "rank")


_WANT = ["retrieval", "chunking", "vector db", "reranking"]


@add("e09_category_coverage", f"""WITH {_CAND}, r AS (SELECT query_id, chunk_id, category, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM cand),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY rank) AS nth, max(CASE WHEN rank = 1 THEN category END) OVER (PARTITION BY query_id) AS top, list_position({S.lst(_WANT)}, category) AS want FROM r),
k AS (SELECT *, CASE WHEN rank = 1 THEN 0 WHEN nth = 1 AND want > 0 AND category IS DISTINCT FROM top THEN want ELSE 1000 + rank END AS key FROM f)
SELECT query_id, chunk_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY key) AS INTEGER) AS place FROM k) WHERE place <= 3""")
def e09(spark, d):
    c = fusion.ranked(_candidates(spark, d))
    return fusion.cover_categories(c, _WANT, 3)


@add("e12_aspect_coverage", f"""WITH {_FUSED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN aspect IS NOT NULL AND nth = 1 THEN 0 ELSE 1 END, rank) AS take FROM (SELECT *, row_number() OVER (PARTITION BY query_id, aspect ORDER BY rank) AS nth FROM fused))
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM t WHERE take <= 3""")
def e12(spark, d):
    return fusion.cover_aspects(_fused(spark, d), 3)


# --- planning -------------------------------------------------------------------------------------------------------


def _any(words):
    return "(" + " OR ".join(f"contains(n, {S.lit(w.lower())})" for w in words) + ")"


_SCORES = "[" + ", ".join("{'s': -(" + " + ".join([f"CASE WHEN contains(n, {S.lit(c.lower())}) THEN 2 ELSE 0 END"] + [f"CASE WHEN contains(n, {S.lit(h)}) THEN {2 if len(h) > 4 else 1} ELSE 0 END" for h in hs]) + f"), 'i': {i}, 'c': {S.lit(c)}}}" for i, (c, hs) in enumerate(X.CATEGORY_HINTS.items())) + "]"
_TECH = {"hybrid": f"(({_any(['hybrid', '混合检索'])} OR {_any(['only vector', 'single vector', 'vector similarity', '向量相似度', '只做一次'])}) AND {_any(['metadata', 'filter', '过滤', 'rerank', '重排'])})",
         "rerank": f"({_any(['rerank', '重排'])} AND NOT {_any(['hybrid', '混合检索', 'metadata'])})", "metadata": f"(contains(n, 'chroma') AND {_any(['metadata', 'filter', 'where', '过滤'])})"}


def _aspect(name, anchored=False):
    lead = f"{S.strip('question')} || ' 检索重点: ' || " if anchored else ""
    cats, text = X.ASPECTS[name][2], S.lit(X.ASPECTS[name][3])
    made = f"{{'name': {S.lit(name)}, 'categories': {S.lst(cats)}, 'search': {lead}{text}}}"
    if name != "techniques":
        return made
    for key, (c, t) in (("hybrid", X.TECHNIQUES_HYBRID), ("rerank", X.TECHNIQUES_RERANK), ("metadata", X.TECHNIQUES_METADATA)):
        made = f"CASE WHEN {_TECH[key]} THEN {{'name': 'techniques', 'categories': {S.lst(c)}, 'search': {lead}{S.lit(t)}}} ELSE {made} END"
    return made


_TESTS = {a: _any(v[0]) for a, v in X.ASPECTS.items()}
_ASP2 = "list_filter([" + ", ".join([f"CASE WHEN {t} THEN {_aspect(a)} END" for a, t in _TESTS.items()] + [
    f"CASE WHEN {_TESTS['evaluation']} AND {_any(X.ASPECTS['badcase_analysis'][0])} AND NOT {_TESTS['badcase_analysis']} THEN {_aspect('badcase_analysis')} END",
    f"CASE WHEN {_TESTS['evaluation']} AND {_any(X.CITATION_MARKERS)} AND NOT {_TESTS['citation_quality']} THEN {_aspect('citation_quality')} END"]) + "], lambda x: x IS NOT NULL)"
_BROAD = "[" + ", ".join(_aspect(a) for a in ("classification", "techniques", "bottlenecks")) + "]"
_ASP3 = "list_filter([" + ", ".join([f"CASE WHEN {_any(X.ASPECTS[a][1])} THEN {_aspect(a, True)} END" for a in X.CONSERVATIVE_ORDER] + [
    f"CASE WHEN {_any(X.INGESTION_SCOPE)} AND {_any(w)} THEN {{'name': '{m}', 'categories': {S.lst(c)}, 'search': {S.strip('question')} || ' 检索重点: ' || {S.lit(t)}}} END"
    for m, w, c, t in (("ingestion_identity", X.INGESTION_IDENTITY, ["ingestion", "indexing", "vector db"], X.IDENTITY_SEARCH), ("ingestion_cache", X.INGESTION_CACHE, ["ingestion", "indexing"], X.CACHE_SEARCH))]) + "], lambda x: x IS NOT NULL)"
_FIRST = "list_filter({x}, lambda y, i: list_position(list_transform({x}, lambda z: lower(z)), lower(y)) = i)"
_INTENT = "CASE " + " ".join(f"WHEN {_any(w)}{' OR list_contains(categories, ' + chr(39) + 'evaluation' + chr(39) + ')' if m == 'evaluate' else ''} THEN '{m}'" for m, w in X.INTENTS) + " ELSE 'answer' END"
_EXPAND = "CASE c " + " ".join(f"WHEN {S.lit(c)} THEN {S.lit(t)}" for c, t in X.CATEGORY_EXPANSIONS.items()) + " ELSE '' END"
_N = rf"regexp_replace(lower({S.strip('question')}), '[\s\x0b]+', ' ', 'g')"
_P0 = f"""{S.QUESTIONS}, p0 AS (SELECT id AS query_id, question, {_N} AS n FROM questions WHERE question IS NOT NULL), p1 AS (SELECT *, list_sort({_SCORES}) AS scores FROM p0),
p2 AS (SELECT *, CASE WHEN -scores[1].s <= 0 THEN 0 ELSE round(least(1.0::DOUBLE, (-2 * scores[1].s + scores[2].s) / 8.0::DOUBLE), 2) END AS confidence, list_transform(list_filter(scores, lambda x: x.s < 0), lambda x: x.c) AS scored FROM p1)"""
_PLAN2 = f"""{_P0}, p3 AS (SELECT *, {_ASP2} AS found FROM p2), p4 AS (SELECT *, CASE WHEN len(found) = 0 AND {_any(X.BROAD_SUBJECTS)} AND {_any(X.BROAD_MARKERS)} THEN {_BROAD} ELSE found END AS aspects FROM p3),
p5 AS (SELECT *, scored[1:2] || flatten(list_transform(aspects, lambda a: a.categories)) AS merged FROM p4), p6 AS (SELECT *, ({_FIRST.format(x='merged')})[1:2] AS categories FROM p5),
p7 AS (SELECT *, [{S.strip('question')}] || list_transform(aspects, lambda a: a.search) || list_transform(categories, lambda c: {S.strip('question')} || ' ' || {_EXPAND}) AS listed FROM p6),
plans AS (SELECT *, {_FIRST.format(x='listed')} AS sub_queries, {_INTENT} AS intent FROM p7)"""
_PLAN3 = f"""{_P0}, p4 AS (SELECT *, {_ASP3} AS aspects FROM p2), p5 AS (SELECT *, flatten(list_transform(aspects, lambda a: a.categories)) || list_filter(scored, lambda c: c NOT IN ('RAG overview', 'RAG challenges')) || scored AS merged FROM p4),
p6 AS (SELECT *, ({_FIRST.format(x='merged')})[1:2] AS categories FROM p5), p7 AS (SELECT *, [{S.strip('question')}] || CASE WHEN len(aspects) < 2 THEN [] ELSE list_transform(aspects, lambda a: a.search) END AS listed FROM p6),
plans AS (SELECT *, {_FIRST.format(x='listed')} AS sub_queries, {_INTENT} AS intent FROM p7)"""
_SHOW = "query_id, confidence, array_to_string(list_transform(aspects, lambda a: a.name), ',') AS aspects, array_to_string(categories, ',') AS categories, intent, sha256(array_to_string(sub_queries, chr(10))) AS searches"


def _asked(spark, d):
    return questions(spark, d).filter("question is not null").select(F.col("id").alias("query_id"), "question")


def _show(plans):
    return plans.select("query_id", "confidence", F.array_join(F.transform("aspects", lambda a: a["name"]), ",").alias("aspects"), F.array_join("categories", ",").alias("categories"), "intent", T.sha256(F.array_join("sub_queries", "\n")).alias("searches"))


def _preferred():
    narrow = "list_filter(a.categories, lambda x: x NOT IN ('RAG overview', 'RAG paper'))"
    return f"CASE WHEN a.name = 'classification' OR len({narrow}) = 0 THEN a.categories ELSE {narrow} END"


@add("e11_bounded_coverage", f"""WITH {_CAND}, {_PLAN2.replace(S.QUESTIONS + ', ', '')},
c AS (SELECT cand.query_id, chunk_id, aspect, category, row_number() OVER (PARTITION BY cand.query_id ORDER BY rank) AS rank, aspects, categories AS asked FROM cand JOIN plans USING (query_id)),
by_aspect AS (SELECT query_id, chunk_id, 0 AS way, pos, CASE WHEN list_contains({_preferred()}, category) THEN 0 ELSE 1 END AS other, rank FROM (SELECT *, unnest(aspects) AS a, unnest(range(1, len(aspects) + 1)) AS pos FROM c) WHERE aspect = a.name AND rank > 1),
by_category AS (SELECT query_id, chunk_id, 1 AS way, list_position({S.lst(X.CATEGORY_PRIORITY)}, category) AS pos, 0 AS other, rank FROM c WHERE rank > 1 AND list_position({S.lst(X.CATEGORY_PRIORITY)}, category) > 0
  AND list_contains(asked || flatten(list_transform(aspects, lambda x: x.categories)), category) AND category <> (SELECT coalesce(t.category, '') FROM c t WHERE t.query_id = c.query_id AND t.rank = 1)),
slot AS (SELECT query_id, chunk_id FROM (SELECT * FROM by_aspect UNION ALL SELECT * FROM by_category) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY way, pos, other, rank) = 1),
k AS (SELECT c.query_id, c.chunk_id, CASE WHEN rank = 1 THEN 0 WHEN slot.chunk_id IS NOT NULL THEN 1 ELSE 1000 + rank END AS key FROM c LEFT JOIN slot ON slot.query_id = c.query_id AND slot.chunk_id = c.chunk_id)
SELECT query_id, chunk_id, place FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY key) AS INTEGER) AS place FROM k) WHERE place <= 3""")
def e11(spark, d):
    plans = planning.plan(_asked(spark, d)).select("query_id", "aspects", "categories", F.lit(3).alias("k"), F.lit(1).alias("slots"))
    return retrieval.cover_plan_bounded(fusion.ranked(_candidates(spark, d)), plans)


@add("d01_normalized", f"WITH {_P0} SELECT query_id, n AS normalized FROM p0")
def d01(spark, d):
    return _asked(spark, d).select("query_id", planning.normalized("question").alias("normalized"))


@add("d02_category_scores", f"WITH {_P0} SELECT query_id, array_to_string(list_transform(list_filter(scores, lambda x: x.s < 0), lambda x: x.c || '=' || CAST(-x.s AS VARCHAR)), ',') AS scores FROM p1")
def d02(spark, d):
    s = _asked(spark, d).select("query_id", planning.category_scores(planning.normalized("question")).alias("s"))
    return s.select("query_id", F.array_join(F.transform(F.filter("s", lambda x: x["s"] < 0), lambda x: F.concat(x["c"], F.lit("="), (-x["s"]).cast("string"))), ",").alias("scores"))


@add("d03_confidence", f"WITH {_P0} SELECT query_id, confidence FROM p2")
def d03(spark, d):
    return _asked(spark, d).select("query_id", planning.confidence(planning.category_scores(planning.normalized("question"))).alias("confidence"))


@add("d04_intent", f"WITH {_PLAN2} SELECT intent, count(*) AS questions FROM plans GROUP BY intent")
def d04(spark, d):
    return planning.plan(_asked(spark, d)).groupBy("intent").agg(F.count(F.lit(1)).alias("questions"))


@add("d05_aspects", f"WITH {_PLAN2} SELECT query_id, array_to_string(list_transform(aspects, lambda a: a.name || ':' || a.search), '|') AS aspects FROM plans")
def d05(spark, d):
    return planning.plan(_asked(spark, d)).select("query_id", F.array_join(F.transform("aspects", lambda a: F.concat(a["name"], F.lit(":"), a["search"])), "|").alias("aspects"))


@add("d06_conservative_aspects", f"WITH {_PLAN3} SELECT query_id, array_to_string(list_transform(aspects, lambda a: a.name || ':' || a.search), '|') AS aspects FROM plans")
def d06(spark, d):
    return planning.plan(_asked(spark, d), 3).select("query_id", F.array_join(F.transform("aspects", lambda a: F.concat(a["name"], F.lit(":"), a["search"])), "|").alias("aspects"))


@add("d09_categories", f"WITH {_PLAN2} SELECT c AS category, count(*) AS questions FROM (SELECT unnest(categories) AS c FROM plans) GROUP BY c")
def d09(spark, d):
    return planning.plan(_asked(spark, d)).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("questions"))


@add("d10_sub_queries", f"WITH {_PLAN2} SELECT query_id, CAST(len(sub_queries) AS INTEGER) AS n, sha256(array_to_string(sub_queries, chr(10))) AS hash FROM plans")
def d10(spark, d):
    return planning.plan(_asked(spark, d)).select("query_id", F.size("sub_queries").alias("n"), T.sha256(F.array_join("sub_queries", "\n")).alias("hash"))


@add("d11_plan", f"WITH {_PLAN2} SELECT {_SHOW} FROM plans")
def d11(spark, d):
    return _show(planning.plan(_asked(spark, d)))


@add("d12_conservative_plan", f"WITH {_PLAN3} SELECT {_SHOW} FROM plans")
def d12(spark, d):
    return _show(planning.plan(_asked(spark, d), 3))


_ROUTE = f"""f AS (SELECT *, len(aspects) AS a, len(categories) AS c, len(sub_queries) AS s,
 len(list_distinct(list_filter(list_transform(list_transform(aspects, lambda x: x.search) || sub_queries, lambda q: lower({S.strip('q')})), lambda q: q <> ''))) AS u FROM plans),
r AS (SELECT *, CASE WHEN a >= 2 THEN 4 WHEN a = 0 AND s >= 3 AND c >= 2 THEN 3 WHEN a = 1 AND confidence < 0.25 THEN 3 ELSE 0 END + CASE WHEN intent = 'compare' AND c >= 2 THEN 2 ELSE 0 END AS complexity, 1500 + 1000 * greatest(1, u) AS estimated_ms FROM f)"""


@add("d20_plan_features", f"WITH {_PLAN2}, {_ROUTE} SELECT query_id, CAST(a AS INTEGER) AS aspects, CAST(s AS INTEGER) AS sub_queries, CAST(c AS INTEGER) AS categories, CAST(u AS INTEGER) AS searches FROM r")
def d20(spark, d):
    r = planning.route(planning.plan(_asked(spark, d)))
    return r.select("query_id", F.size("aspects").alias("aspects"), F.size("sub_queries").alias("sub_queries"), F.size("categories").alias("categories"), F.col("unique_queries").alias("searches"))


@add("d21_complexity", f"WITH {_PLAN2}, {_ROUTE} SELECT CAST(complexity AS INTEGER) AS complexity, count(*) AS questions FROM r GROUP BY complexity")
def d21(spark, d):
    return planning.route(planning.plan(_asked(spark, d))).groupBy("complexity").agg(F.count(F.lit(1)).alias("questions"))


@add("d22_estimate", f"WITH {_PLAN3}, {_ROUTE} SELECT query_id, CAST(estimated_ms AS INTEGER) AS estimated_ms FROM r")
def d22(spark, d):
    return planning.route(planning.plan(_asked(spark, d), 3)).select("query_id", "estimated_ms")


@add("d23_route", f"""WITH {_PLAN2}, {_ROUTE} SELECT query_id, CASE WHEN complexity >= 3 AND estimated_ms <= 6000 THEN 'planned' ELSE 'direct' END AS route,
 array_to_string(list_filter([CASE WHEN complexity >= 3 AND estimated_ms <= 6000 THEN 'complexity_threshold_reached' WHEN complexity >= 3 THEN 'estimated_planned_latency_exceeds_budget' ELSE 'simple_or_specific_query' END,
  CASE WHEN a >= 2 THEN 'multiple_answer_aspects' WHEN a = 0 AND s >= 3 AND c >= 2 THEN 'multi_category_expansion_without_aspects' WHEN a = 1 AND confidence < 0.25 THEN 'aspect_detected_with_low_category_confidence' END,
  CASE WHEN intent = 'compare' AND c >= 2 THEN 'cross_category_comparison' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def d23(spark, d):
    return planning.route(planning.plan(_asked(spark, d)), 6000).select("query_id", "route", F.array_join("reasons", ",").alias("reasons"))


def _specs(total, listed):
    return f"""x AS (SELECT query_id, unnest(l) AS r, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT query_id, {listed} AS l FROM plans)),
y AS (SELECT query_id, pos, r.q AS query, r.c AS category, r.a AS aspect, r.g AS run_group FROM x WHERE r.q <> ''),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY query_id, lower({S.squash('query')}), category ORDER BY pos) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS run_ord, query, category, aspect, run_group,
 round(CASE run_group WHEN 'anchor' THEN {total[0]} WHEN 'global_expansion' THEN {total[1]} ELSE {total[2]} END::DOUBLE / count(*) OVER (PARTITION BY query_id, run_group), 6) AS weight FROM z"""


def _spec(q, c, a, g):
    return f"{{'q': {S.strip(q)}, 'c': CAST({c} AS VARCHAR), 'a': CAST({a} AS VARCHAR), 'g': '{g}'}}"


_ANCHOR = f"[{_spec('question', 'NULL', 'NULL', 'anchor')}]"
_LIST2 = f"""{_ANCHOR} || list_transform(categories, lambda c: {_spec('question', 'c', 'NULL', 'filtered_expansion')})
 || flatten(list_transform(aspects, lambda a: [{_spec('a.search', 'NULL', 'a.name', 'global_expansion')}] || list_transform(a.categories[1:8], lambda c: {_spec('a.search', 'c', 'a.name', 'filtered_expansion')})))
 || flatten(list_transform(sub_queries, lambda s: [{_spec('s', 'NULL', 'NULL', 'global_expansion')}] || list_transform(categories, lambda c: {_spec('s', 'c', 'NULL', 'filtered_expansion')})))"""
_LIST3 = f"""CASE WHEN len(aspects) < 2 THEN {_ANCHOR} ELSE {_ANCHOR} || list_transform(categories[1:2], lambda c: {_spec('question', 'c', 'NULL', 'filtered_expansion')})
 || flatten(list_transform(aspects[1:4], lambda a: [{_spec('a.search', 'NULL', 'a.name', 'global_expansion')}] || list_transform(a.categories[1:1], lambda c: {_spec('a.search', 'c', 'a.name', 'filtered_expansion')}))) END"""


@add("e03_run_specs", f"WITH {_PLAN2}, {_specs((2.0, 1.0, 0.5), _LIST2)}")
def e03(spark, d):
    return planning.run_specs(planning.plan(_asked(spark, d)))


@add("e04_conservative_specs", f"WITH {_PLAN3}, {_specs((3.0, 0.75, 0.25), _LIST3)}")
def e04(spark, d):
    return planning.run_specs(planning.plan(_asked(spark, d), 3), True)


@add("e05_group_weights", f"WITH {_PLAN2}, w AS ({'SELECT * FROM (WITH ' + _specs((2.0, 1.0, 0.5), _LIST2) + ')'}) SELECT run_group, count(*) AS runs, round(sum(weight), 2) AS weight FROM w GROUP BY run_group")
def e05(spark, d):
    return planning.run_specs(planning.plan(_asked(spark, d))).groupBy("run_group").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("weight"), 2).alias("weight"))
