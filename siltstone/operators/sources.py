"""Operators around sources: manifest, URLs, endpoints, caches and open work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import squash, strip

# Hosts that may be spoken to without encryption.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def read_manifest(raw: DataFrame) -> DataFrame:
    """The manifest with every value stripped, nulls as empty texts, repeated rows once."""
    return raw.select(*[F.coalesce(strip(c), F.lit("")).alias(c) for c in raw.columns]).distinct()


def select_sources(manifest: DataFrame, priorities: Sequence[str], include_all: bool = False) -> DataFrame:
    chosen = manifest.filter(F.col("priority").isin(*priorities))
    return chosen if include_all else chosen.filter(F.lower("ingest_first") == "yes")


def missing_sources(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_id): sources for which no document with a text was read."""
    read = documents.filter("text is not null and source is not null").select(F.lower(strip("source")).alias("key")).distinct()
    return manifest.withColumn("key", F.lower("source_id")).join(read, "key", "left_anti").select("source_id")


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def candidate_urls(urls: DataFrame) -> DataFrame:
    """(url, place, candidate): the addresses to try for a URL, best first, each once."""
    url, host, path = F.col("url"), _host(F.col("url")), _path(F.col("url"))
    part = F.filter(F.split(path, "/"), lambda p: p != "")
    bare = F.regexp_replace(url, r"/+$", "")
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(part, 0), F.lit("/"), F.get(part, 1), F.lit("/"))
    blob = (F.size(part) >= 5) & (F.get(part, 2) == "blob")
    arxiv = (host == "arxiv.org") & path.startswith("/abs/")
    paper = F.regexp_replace(path, r"^/abs/", "")
    readme = (host == "github.com") & (F.size(part) >= 2) & ~blob
    found = F.array(
        F.when((host == "github.com") & blob, F.concat(raw, F.get(part, 3), F.lit("/"), F.array_join(F.slice(part, 5, 1000), "/"))),
        F.when(host == "docs.langchain.com", F.concat(bare, F.lit(".md"))),
        F.when((host == "developers.llamaindex.ai") & ~path.endswith("/index.md"), F.concat(bare, F.lit("/index.md"))),
        F.when(host == "docs.llamaindex.ai", F.concat(F.lit("https://developers.llamaindex.ai"), F.regexp_replace(F.replace(path, F.lit("/en/stable/"), F.lit("/python/framework/")), r"/+$", ""), F.lit("/index.md"))),
        F.when(arxiv, F.concat(F.lit("https://arxiv.org/html/"), paper)),
        F.when(arxiv, F.concat(F.lit("https://arxiv.org/pdf/"), paper)),
        url,
        F.when(readme, F.concat(raw, F.lit("main/README.md"))),
        F.when(readme, F.concat(raw, F.lit("master/README.md"))),
    )
    listed = urls.select("url", F.posexplode(F.array_distinct(F.array_compact(found))).alias("place", "candidate"))
    return listed.select("url", (F.col("place") + 1).alias("place"), "candidate")


def extension(url: Column, content_type: Column | None = None) -> Column:
    """.pdf, .md, .txt or .html, by the path's ending, else by the content type, else .html."""
    path = F.lower(_path(url))
    ending = F.when(path.endswith(".pdf"), ".pdf").when(path.endswith(".md"), ".md").when(path.endswith(".txt"), ".txt")
    if content_type is not None:
        kind = F.lower(content_type)
        ending = ending.when(kind.contains("pdf"), ".pdf").when(kind.contains("markdown"), ".md").when(kind.contains("text/plain"), ".txt")
    return ending.otherwise(".html")


def cache_counts(df: DataFrame, column: str) -> DataFrame:
    """(requests, misses, hits): of requests by text, evened white space, how many a cache would have to compute."""
    text = squash(column)
    return df.filter(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct(text).alias("misses")).withColumn("hits", F.col("requests") - F.col("misses"))


def endpoint_policy(urls: DataFrame) -> DataFrame:
    """(url, verdict, endpoint): whether a base URL may be called, and the address of its chat endpoint."""
    url = F.col("url")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    verdict = (
        F.when(url == "", "required")
        .when(~scheme.isin("http", "https") | (place == ""), "not absolute")
        .when(place.contains("@"), "credentials")
        .when(url.contains("?") | url.contains("#"), "query or fragment")
        .when((scheme == "http") & ~F.regexp_replace(F.lower(place), r":\d+$", "").isin(*LOCAL_HOSTS), "not secure")
        .otherwise("ok")
    )
    full = F.when(path.endswith("/chat/completions"), path).otherwise(F.concat(path, F.lit("/chat/completions")))
    return urls.select("url", verdict.alias("verdict"), F.when(verdict == "ok", F.concat(scheme, F.lit("://"), place, full)).alias("endpoint"))


def open_runs(cases: DataFrame, systems: Sequence[str], done: DataFrame) -> DataFrame:
    """(query_id, system): the cases' runs that aren't done yet."""
    return cases.select("query_id", F.explode(F.array(*[F.lit(s) for s in systems])).alias("system")).join(done, ["query_id", "system"], "left_anti")


def wrapped(df: DataFrame, fields: Sequence[str], named: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Adds `document`: the text behind a front matter of the fields, quotes and line ends made safe."""
    named = named or {}
    lines = [F.concat(F.lit(f'{f}: "'), F.translate(F.replace(F.col(named.get(f, f)), F.lit("\n"), F.lit(" ")), '"', "'"), F.lit('"')) for f in fields]
    return df.withColumn("document", F.concat(F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.col(text)), F.lit("\n")))


def canonical_hash(fields: Sequence[str]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and no blanks."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256)
