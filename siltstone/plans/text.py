"""Queries over sources and texts: scans, cleaning, hashing, sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import sql as S
from siltstone.functions import text as T
from siltstone.operators import chunking, sources
from siltstone.plans.registry import Registry
from siltstone.sources.inputs import current_chunks, questions
from siltstone.sources.tables import table

registry = Registry()
add = registry.add

MANIFEST = "source_id priority category title source_type url ingest_first why notes extract_symbol".split()
_TRIMMED = ", ".join(f"coalesce({S.strip(c)}, '') AS {c}" for c in MANIFEST)
_SOURCES = f"sources AS (SELECT DISTINCT {_TRIMMED} FROM source_manifest)"


@add("a01_manifest_scan", f"WITH {_SOURCES} SELECT * FROM sources")
def a01(spark, d):
    return sources.read_manifest(table(spark, d, "source_manifest"))


@add("a02_selected_sources", f"WITH {_SOURCES} SELECT * FROM sources WHERE priority IN ('P0', 'P1') AND lower(ingest_first) = 'yes'")
def a02(spark, d):
    return sources.select_sources(sources.read_manifest(table(spark, d, "source_manifest")), ["P0", "P1"])


@add("a03_wanted_sources", f"WITH {_SOURCES}, wanted AS (SELECT * FROM sources WHERE lower(category) IN ('retrieval', 'chunking', 'vector db')) SELECT * FROM wanted ORDER BY source_id LIMIT 5")
def a03(spark, d):
    found = sources.read_manifest(table(spark, d, "source_manifest")).filter(F.lower("category").isin("retrieval", "chunking", "vector db"))
    return found.orderBy("source_id").limit(5)


_EXAMPLES = [
    "https://arxiv.org/abs/2005.11401", "https://docs.llamaindex.ai/en/stable/module/x/", "https://developers.llamaindex.ai/python/framework/a", "https://docs.langchain.com/oss/rag/",
    "https://github.com/own/proj/blob/main/src/a.py", "https://github.com/own/proj", "https://x.example/file.PDF", "https://x.example/notes.txt?a=1",
]
_URLS = f"urls AS (SELECT DISTINCT url FROM (SELECT unnest({S.lst(_EXAMPLES)}) AS url UNION ALL SELECT {S.strip('url')} FROM source_manifest) WHERE url IS NOT NULL)"
_HOST, _PATH = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _urls(spark, d):
    given = spark.createDataFrame([(u,) for u in _EXAMPLES], "url string")
    return given.unionByName(table(spark, d, "source_manifest").select(T.strip("url").alias("url"))).filter("url is not null").distinct()


@add(
    "a04_candidate_urls",
    f"""WITH {_URLS}, parts AS (SELECT url, {_HOST} AS host, {_PATH} AS path, list_filter(string_split({_PATH}, '/'), lambda p: p <> '') AS p FROM urls),
made AS (SELECT url, list_filter([
  CASE WHEN host = 'github.com' AND len(p) >= 5 AND p[3] = 'blob' THEN 'https://raw.githubusercontent.com/' || p[1] || '/' || p[2] || '/' || p[4] || '/' || array_to_string(p[5:], '/') END,
  CASE WHEN host = 'docs.langchain.com' THEN rtrim(url, '/') || '.md' END,
  CASE WHEN host = 'developers.llamaindex.ai' AND NOT ends_with(path, '/index.md') THEN rtrim(url, '/') || '/index.md' END,
  CASE WHEN host = 'docs.llamaindex.ai' THEN 'https://developers.llamaindex.ai' || rtrim(replace(path, '/en/stable/', '/python/framework/'), '/') || '/index.md' END,
  CASE WHEN host = 'arxiv.org' AND starts_with(path, '/abs/') THEN 'https://arxiv.org/html/' || substr(path, 6) END,
  CASE WHEN host = 'arxiv.org' AND starts_with(path, '/abs/') THEN 'https://arxiv.org/pdf/' || substr(path, 6) END,
  url,
  CASE WHEN host = 'github.com' AND len(p) >= 2 AND NOT (len(p) >= 5 AND p[3] = 'blob') THEN 'https://raw.githubusercontent.com/' || p[1] || '/' || p[2] || '/main/README.md' END,
  CASE WHEN host = 'github.com' AND len(p) >= 2 AND NOT (len(p) >= 5 AND p[3] = 'blob') THEN 'https://raw.githubusercontent.com/' || p[1] || '/' || p[2] || '/master/README.md' END], lambda x: x IS NOT NULL) AS c FROM parts)
SELECT url, CAST(i AS INTEGER) AS place, c[i] AS candidate FROM (SELECT url, c, unnest(range(1, len(c) + 1)) AS i FROM made)""",
)
def a04(spark, d):
    return sources.candidate_urls(_urls(spark, d))


@add(
    "a05_extension",
    f"""WITH {_URLS} SELECT url, CASE WHEN ends_with(lower({_PATH}), '.pdf') THEN '.pdf' WHEN ends_with(lower({_PATH}), '.md') THEN '.md'
 WHEN ends_with(lower({_PATH}), '.txt') THEN '.txt' ELSE '.html' END AS extension FROM urls""",
)
def a05(spark, d):
    return _urls(spark, d).select("url", sources.extension(F.col("url")).alias("extension"))


@add("a07_missing_sources", f"WITH {_SOURCES} SELECT source_id FROM sources WHERE lower(source_id) NOT IN (SELECT DISTINCT lower({S.strip('source')}) FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)")
def a07(spark, d):
    return sources.missing_sources(sources.read_manifest(table(spark, d, "source_manifest")), table(spark, d, "documents"))


@add("a09_scan_violations", f"SELECT count(*) FILTER (coalesce(chunk_id, '') = '') AS without_id, count(*) FILTER (coalesce(text, '') = '') AS without_text, count(*) AS delivered FROM chunks")
def a09(spark, d):
    empty = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "")
    return table(spark, d, "chunks").agg(empty("chunk_id").alias("without_id"), empty("text").alias("without_text"), F.count(F.lit(1)).alias("delivered"))


@add("a12_preview", f"WITH {S.CURRENT} SELECT chunk_id, {S.preview('text', 500)} AS preview FROM current")
def a12(spark, d):
    return current_chunks(spark, d).select("chunk_id", T.preview("text", 500).alias("preview"))


@add("a13_vector_scan", "SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing, count(DISTINCT len(embedding)) AS widths, count(DISTINCT vec_id) AS ids FROM embeddings")
def a13(spark, d):
    e = table(spark, d, "embeddings")
    return e.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.countDistinct(F.size("embedding")).alias("widths"), F.countDistinct("vec_id").alias("ids"))


@add("a15_query_cache", f"SELECT count(*) AS requests, count(DISTINCT {S.squash('question')}) AS misses, count(*) - count(DISTINCT {S.squash('question')}) AS hits FROM natural_queries WHERE question IS NOT NULL")
def a15(spark, d):
    return sources.cache_counts(table(spark, d, "natural_queries"), "question")


_BASES = ["https://api.example/v1", "http://localhost:11434/v1/", "http://api.example/v1", "https://user:pw@api.example", "ftp://x.example", "https://api.example/v1?k=1", "", "https://api.example/chat/completions"]


@add(
    "a17_url_policy",
    f"""WITH urls AS (SELECT DISTINCT {S.strip('base')} AS url FROM (SELECT unnest({S.lst(_BASES)}) AS base UNION ALL SELECT url FROM source_manifest WHERE url IS NOT NULL)),
parts AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS place,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM urls),
judged AS (SELECT *, CASE WHEN url = '' THEN 'required' WHEN scheme NOT IN ('http', 'https') OR place = '' THEN 'not absolute' WHEN contains(place, '@') THEN 'credentials'
  WHEN contains(url, '?') OR contains(url, '#') THEN 'query or fragment' WHEN scheme = 'http' AND regexp_replace(lower(place), ':\\d+$', '') NOT IN ('localhost', '127.0.0.1', '::1') THEN 'not secure' ELSE 'ok' END AS verdict FROM parts)
SELECT url, verdict, CASE WHEN verdict = 'ok' THEN scheme || '://' || place || CASE WHEN ends_with(rtrim(path, '/'), '/chat/completions') THEN rtrim(path, '/') ELSE rtrim(path, '/') || '/chat/completions' END END AS endpoint FROM judged""",
)
def a17(spark, d):
    given = spark.createDataFrame([(u,) for u in _BASES], "url string").unionByName(table(spark, d, "source_manifest").select("url").filter("url is not null"))
    return sources.endpoint_policy(given.select(T.strip("url").alias("url")).distinct())


@add("a18_case_violations", f"""SELECT id, count(*) AS rows, count(*) FILTER (coalesce({S.strip('question')}, '') = '') AS blank FROM natural_queries GROUP BY id HAVING count(*) > 1 OR count(*) FILTER (coalesce({S.strip('question')}, '') = '') > 0""")
def a18(spark, d):
    blank = F.count_if(F.coalesce(T.strip("question"), F.lit("")) == "").alias("blank")
    return table(spark, d, "natural_queries").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), blank).filter("rows > 1 or blank > 0")


@add("a19_open_runs", f"WITH {S.ASKED} SELECT query_id, system FROM asked, (VALUES ('dense'), ('bm25')) t(system) WHERE NOT EXISTS (SELECT 1 FROM qrels r WHERE r.query_id = asked.query_id AND system = 'bm25')")
def a19(spark, d):
    from siltstone.sources.inputs import asked

    done = table(spark, d, "qrels").select("query_id", F.lit("bm25").alias("system")).distinct()
    return sources.open_runs(asked(spark, d).select("query_id"), ["dense", "bm25"], done)


@add("a20_prior_questions", f"SELECT question, min(id) AS first_id FROM natural_queries WHERE {S.strip('question')} <> '' GROUP BY question")
def a20(spark, d):
    return table(spark, d, "natural_queries").filter(T.strip("question") != "").groupBy("question").agg(F.min("id").alias("first_id"))


# --- cleaning -------------------------------------------------------------------------------------------------------

_PAGE = """pages AS (SELECT doc_id, text, coalesce(source, '') AS source, CASE WHEN ends_with(lower(source), '_paper') THEN 'paper' ELSE 'page' END AS source_type FROM documents WHERE text IS NOT NULL)"""


def _pages(spark, d):
    kind = F.when(F.lower("source").endswith("_paper"), "paper").otherwise("page")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), kind.alias("source_type"))


def _hashed(name, expression, sql):
    """Register one cleaning step over every document: the length and hash of what it leaves."""

    @add(name, f"WITH {_PAGE}, done AS (SELECT doc_id, {sql} AS x FROM pages) SELECT doc_id, CAST(length(x) AS INTEGER) AS n, sha256(x) AS hash FROM done")
    def query(spark, d):
        done = _pages(spark, d).select("doc_id", expression("text").alias("x"))
        return done.select("doc_id", F.char_length("x").alias("n"), T.sha256("x").alias("hash"))


def _first(x):
    first = rf"coalesce(nullif(strpos(chr(10) || {x}, regexp_extract(chr(10) || {x}, '\n#\s+\S')), 0), 0)"
    return f"CASE WHEN source_type = 'paper' AND NOT contains({x}, chr(10) || '# ') THEN {x} WHEN regexp_extract(chr(10) || {x}, '\\n#\\s+\\S') = '' THEN {x} ELSE substr({x}, {first}) END"


def _tail(x):
    places = ", ".join(f"strpos({x}, {_escaped(m)}) - 1" for m in T.TAIL_MARKERS)
    return f"CASE WHEN len(list_filter([{places}], lambda p: p > 0.35 * length({x}))) > 0 THEN substr({x}, 1, list_min(list_filter([{places}], lambda p: p > 0.35 * length({x})))) ELSE {x} END"


def _escaped(marker):
    return " || ".join("chr(10)" if p == "\n" else S.lit(p) for p in _parts(marker))


def _parts(marker):
    out = []
    for i, piece in enumerate(marker.split("\n")):
        if i:
            out.append("\n")
        if piece:
            out.append(piece)
    return out


def _chrome(x):
    stripped = S.strip("l")
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN {stripped} = '' THEN '' ELSE l END), lambda l: NOT regexp_matches({stripped}, {S.lit(T.CHROME)})), chr(10))"


def _anchors(x):
    return rf"regexp_replace(regexp_replace({x}, '(?m)^(#{{1,6}})\s+\[.*?\]\(#.*?\)\s*', '\1 ', 'g'), '(?m)^\[.*?†(.+?)\]\s*$', '\1', 'g')"


def _lead(x):
    return S.strip(rf"regexp_replace({x}, '(?s)\A#\s+.+?\n+', '')")


_hashed("b06_frontmatter", T.without_frontmatter, S.strip(rf"regexp_replace({S.strip('text')}, '(?s)\A---\n.*?\n---\n*', '')"))
_hashed("b08_tail", T.without_tail, _tail("text"))
_hashed("b09_chrome_lines", T.without_chrome, _chrome("text"))
_hashed("b10_anchors", lambda x: T.without_leading_title(T.without_anchors(x)), _lead(_anchors("text")))
_hashed("b11_tidy", T.tidy, S.tidy("text"))
_hashed("b12_source_lines", T.without_source_lines, S.tidy(rf"array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches({S.strip('l')}, '(?i)^Source:\s+https?://')), chr(10))"))
_hashed("b14_hash", lambda x: F.col(x), "text")


@add("b07_first_title", f"WITH {_PAGE}, done AS (SELECT doc_id, {_first('text')} AS x FROM pages) SELECT doc_id, CAST(length(x) AS INTEGER) AS n, sha256(x) AS hash FROM done")
def b07(spark, d):
    done = _pages(spark, d).select("doc_id", T.from_first_title("text", "source_type").alias("x"))
    return done.select("doc_id", F.char_length("x").alias("n"), T.sha256("x").alias("hash"))


@add(
    "b05_clean_body",
    f"""WITH {_PAGE}, s1 AS (SELECT *, {S.strip(rf"regexp_replace({S.tidy('text')}, '(?s){chr(92)}A---{chr(92)}n.*?{chr(92)}n---{chr(92)}n+', '')")} AS a FROM pages),
s2 AS (SELECT *, {_first('a')} AS b FROM s1), s3 AS (SELECT *, {_tail('b')} AS c FROM s2), s4 AS (SELECT *, {_chrome('c')} AS e FROM s3), s5 AS (SELECT *, {_lead(_anchors('e'))} AS f FROM s4), s6 AS (SELECT doc_id, {S.tidy('f')} AS x FROM s5)
SELECT doc_id, CAST(length(x) AS INTEGER) AS n, sha256(x) AS hash FROM s6""",
)
def b05(spark, d):
    done = T.with_clean_body(_pages(spark, d), "text", "source_type", "x")
    return done.select("doc_id", F.char_length("x").alias("n"), T.sha256("x").alias("hash"))


@add("b13_clean_heading", rf"""WITH {S.CURRENT}, h AS (SELECT DISTINCT heading_path AS heading FROM current WHERE heading_path IS NOT NULL)
SELECT heading, regexp_replace(regexp_replace(regexp_replace(heading, '\s+', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '^[ #]+|[ #]+$', '', 'g') AS clean FROM h""")
def b13(spark, d):
    return current_chunks(spark, d).filter("heading_path is not null").select(F.col("heading_path").alias("heading")).distinct().withColumn("clean", T.clean_heading("heading"))


@add(
    "b03_wrapped",
    f"""WITH {_PAGE}, t AS (SELECT doc_id, '---' || chr(10) || 'source_id: "' || replace(replace(source, chr(10), ' '), '"', '''') || '"' || chr(10) || 'source_type: "' || source_type || '"' || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS x FROM pages) SELECT doc_id, sha256(x) AS hash FROM t""",
)
def b03(spark, d):
    return sources.wrapped(_pages(spark, d), ["source_id", "source_type"], {"source_id": "source"}).select("doc_id", T.sha256("document").alias("hash"))


@add("b15_canonical_hash", """WITH m AS (SELECT DISTINCT source_id, coalesce(category, '') AS category, coalesce(url, '') AS url FROM source_manifest WHERE source_id IS NOT NULL)
SELECT source_id, sha256('{"category":' || to_json(category) || ',"source_id":' || to_json(source_id) || ',"url":' || to_json(url) || '}') AS hash FROM m""")
def b15(spark, d):
    m = table(spark, d, "source_manifest").filter("source_id is not null").select("source_id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("url", F.lit("")).alias("url")).distinct()
    return m.select("source_id", sources.canonical_hash(["source_id", "category", "url"]).alias("hash"))


@add("b16_previews", f"WITH {S.TURNS} SELECT id, {S.preview('user_text', 260)} AS asked, {S.preview('answer', 220)} AS answered FROM spoken")
def b16(spark, d):
    from siltstone.sources.inputs import turns

    return turns(spark, d).select("id", T.preview("user_text", 260).alias("asked"), T.preview("answer", 220).alias("answered"))


# --- sections and chunks --------------------------------------------------------------------------------------------


@add(
    "b20_sections",
    rf"""WITH src AS (SELECT doc_id, coalesce(title, '') AS title, {S.tidy(rf"array_to_string(list_filter(string_split({S.tidy('text')}, chr(10)), lambda l: NOT regexp_matches({S.strip('l')}, '(?i)^Source:\s+https?://')), chr(10))")} AS text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM src WHERE text <> ''),
fenced AS (SELECT *, starts_with({S.strip('line')}, '```') AS mark, sum(CASE WHEN starts_with({S.strip('line')}, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 AS inside FROM lines),
heads AS (SELECT *, CASE WHEN NOT mark AND inside = 0 AND regexp_matches(line, '^#{{1,6}}[\s\x0b]+[^\s\x0b]') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM fenced),
titled AS (SELECT *, CASE WHEN level IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '^#{{1,6}}[\s\x0b]+(.+?)[\s\x0b]*$', 1), '[\s\x0b]+', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '^[ #]+|[ #]+$', '', 'g') END AS head,
  sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM heads),
parts AS (SELECT doc_id, title, part, max(level) AS level, max(head) AS head, {S.tidy("string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY n)")} AS body FROM titled GROUP BY 1, 2, 3),
paths AS (SELECT *, {", ".join(f"last_value(CASE WHEN level <= {l} THEN {{'l': level, 'h': head}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY part) AS h{l}" for l in range(1, 7))} FROM parts),
named AS (SELECT *, array_to_string(list_filter([CASE WHEN h1 IS NULL THEN title ELSE h1.h END, {", ".join(f"CASE WHEN h{l}.l = {l} THEN h{l}.h END" for l in range(2, 7))}], lambda x: x IS NOT NULL AND x <> ''), ' > ') AS path FROM paths WHERE body <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section_index, CAST(coalesce(level, 1) AS INTEGER) AS heading_level, path AS heading_path, sha256(body) AS body_hash FROM named""",
)
def b20(spark, d):
    found = chunking.markdown_sections(table(spark, d, "documents"), "doc_id", "text", "title")
    return found.select("doc_id", "section_index", "heading_level", "heading_path", T.sha256("body").alias("body_hash"))


@add("b21_chunks")
def b21(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return chunking.split_documents(docs, "doc_id", "text", "title")


@add(
    "b23_paragraphs",
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x0b]*\n'), lambda x: {S.tidy('x')}), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(p) AS INTEGER) AS paragraphs, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS INTEGER) AS longest FROM p""",
)
def b23(spark, d):
    p = table(spark, d, "documents").filter("text is not null").select("doc_id", chunking.paragraphs("text").alias("p"))
    return p.select("doc_id", F.size("p").alias("paragraphs"), F.coalesce(F.array_max(F.transform("p", F.char_length)), F.lit(0)).alias("longest"))


@add("b25_formatted", f"""WITH {S.CURRENT}, f AS (SELECT chunk_id, {S.tidy("'Document: ' || coalesce(title, '') || CASE WHEN coalesce(heading_path, '') NOT IN ('', coalesce(title, '')) THEN chr(10) || 'Section: ' || heading_path ELSE '' END || chr(10) || chr(10) || coalesce(text, '')")} AS x FROM current)
SELECT chunk_id, CAST(length(x) AS INTEGER) AS char_count, sha256(x) AS text_hash FROM f""")
def b25(spark, d):
    made = current_chunks(spark, d).select("chunk_id", chunking.formatted("title", "heading_path", "text").alias("x"))
    return made.select("chunk_id", F.char_length("x").alias("char_count"), T.sha256("x").alias("text_hash"))


@add("b27_estimate", f"SELECT doc_id, {S.estimate('text')} AS tokens FROM documents")
def b27(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate("text").alias("tokens"))


@add("b28_records", f"""WITH {S.CURRENT} SELECT chunk_id, doc_id || '::chunk_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS VARCHAR), 4, '0') AS record_id FROM current WHERE doc_id IS NOT NULL""")
def b28(spark, d):
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1
    return current_chunks(spark, d).filter("doc_id is not null").select("chunk_id", F.format_string("%s::chunk_%04d", "doc_id", ordinal).alias("record_id"))


@add(
    "b29_corpus_summary",
    f"""WITH {S.CURRENT}, n AS (SELECT coalesce(category, '') AS category, length(text) AS chars FROM current WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY chars) AS i, count(*) OVER (PARTITION BY category) AS c FROM n)
SELECT category, count(*) AS chunks, min(chars) AS least, max(CASE WHEN i = c // 2 + 1 THEN chars END) AS p50, max(CASE WHEN i = CAST(floor(c * 0.9) AS BIGINT) + 1 THEN chars END) AS p90, max(chars) AS most,
  round(avg(chars), 4) AS average, count(*) FILTER (chars > 3750) AS too_long, count(*) FILTER (chars < 120) AS tiny FROM r GROUP BY category""",
)
def b29(spark, d):
    return chunking.corpus_summary(current_chunks(spark, d))
