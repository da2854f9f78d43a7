"""Versioned corpora: fingerprints, delta plans, reuse of embeddings, source states, validation, the active pointer."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.embedding import profile
from siltstone.operators import chunking

VERSION_ID = r"^[A-Za-z0-9._-]+$"


def violations(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """(key, problem): keys that are missing, occur more than once, or lack a required field."""
    blank = [F.when(F.count_if(F.coalesce(T.strip(F.col(c).cast("string")), F.lit("")) == "") > 0, f"missing {c}") for c in required if c != key]
    twice = F.when(F.count(F.lit(1)) > 1, "duplicate")
    keyless = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "missing key")
    facts = df.groupBy(key).agg(F.array_compact(F.array(twice, *blank)).alias("problems"))
    return facts.select(key, F.explode(F.array_compact(F.concat("problems", F.array(keyless)))).alias("problem"))


def fingerprint(metadata: Sequence[str], text: str, config: dict[str, int]) -> Column:
    """SHA-256 over the sorted metadata, the cleaned text and the chunking configuration."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(metadata)]
    body = T.without_source_lines(T.without_frontmatter(F.coalesce(F.col(text), F.lit(""))))
    return F.sha2(F.concat_ws("\n", F.to_json(F.struct(*fields)), body, F.lit(json.dumps(config, sort_keys=True, separators=(",", ":")))), 256)


def delta_plan(before: DataFrame, after: DataFrame, key: str, value: str, config_changed: bool = False) -> DataFrame:
    """(key, change_type): added, removed, changed or unchanged; a changed configuration changes every common key."""
    a, b = (x.select(key, F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for x, n in ((before, "old"), (after, "new")))
    same = F.lit(not config_changed) & F.col("old").eqNullSafe(F.col("new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change_type"))


def incremental_chunks(plan: DataFrame, previous_chunks: DataFrame, fresh_chunks: DataFrame, key: str) -> DataFrame:
    """The chunks of the next version: rows of unchanged keys as they were, of the others newly split."""
    keep = previous_chunks.join(plan.filter("change_type = 'unchanged'").select(key), key, "left_semi")
    return keep.unionByName(fresh_chunks.join(plan.filter("change_type in ('added', 'changed')").select(key), key, "left_semi"))


def next_chunks(plan: DataFrame, previous_chunks: DataFrame, documents: DataFrame, recorded: DataFrame, key: str, text: str = "text", title: str = "title") -> DataFrame:
    """The chunk rows of the next version: unchanged documents keep theirs, only added and changed ones are split.

    recorded are the source_states (source_id = key) of the previous version; kept rows whose chunk ids aren't those
    recorded raise ValueError. A document without text has no chunks in either.
    """
    unchanged = plan.filter("change_type = 'unchanged'").select(key)
    kept = previous_chunks.join(unchanged, key, "left_semi")
    actual = source_states(kept.select(F.col(key).alias("source_id"), F.col(key).alias("doc_id"), "chunk_id", "text_hash")).select(F.col("source_id").alias(key), F.col("ids_hash").alias("actual"))
    states = unchanged.join(recorded.select(F.col("source_id").alias(key), F.col("ids_hash").alias("recorded")), key, "left").join(actual, key, "left")
    if wrong := states.filter(~F.col("recorded").eqNullSafe(F.col("actual"))).select(key).limit(5).collect():
        raise ValueError(f"previous chunks don't match the manifest: {sorted(r[0] for r in wrong)}")
    renewed = documents.join(plan.filter("change_type in ('added', 'changed')").select(key), key, "left_semi")
    fresh = chunking.split_documents(renewed, key, text, title)
    return incremental_chunks(plan, kept.withColumn("origin", F.lit("kept")), fresh.withColumn("origin", F.lit("split")), key)


def reuse(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(chunk_id, reuse): whether an embedding exists for the same chunk and text, for the source's text, or none."""
    own = previous.select("chunk_id", F.col("text_hash")).distinct().withColumn("own", F.lit(True))
    alike = previous.select("source_id", "text_hash").distinct().withColumn("alike", F.lit(True))
    joined = current.join(own, ["chunk_id", "text_hash"], "left").join(alike, ["source_id", "text_hash"], "left")
    return joined.select("chunk_id", F.when(F.col("own"), "same chunk").when(F.col("alike"), "same text").otherwise("new").alias("reuse"))


def materialise(current: DataFrame, previous: DataFrame, embed: Callable[[Column], Column] = profile) -> DataFrame:
    """(chunk_id, text_hash, embedding, reuse): the vectors of a version, taken from the previous one where the text is the same.

    current is (chunk_id, source_id, text_hash, text), previous (chunk_id, source_id, text_hash, embedding). A vector
    is taken from the same chunk with the same hash, else from a chunk of the same source with the same hash (of
    several the one with the smallest id), else the text is embedded. Null hashes are never the same.
    """
    own = previous.groupBy("chunk_id", "text_hash").agg(F.first("embedding").alias("own"))
    alike = previous.groupBy("source_id", "text_hash").agg(F.min_by("embedding", "chunk_id").alias("alike"))
    joined = current.join(own, ["chunk_id", "text_hash"], "left").join(alike, ["source_id", "text_hash"], "left")
    reuse = F.when(F.col("own").isNotNull(), "same chunk").when(F.col("alike").isNotNull(), "same text").otherwise("new")
    # The branch of coalesce that embeds runs only for rows without a vector.
    return joined.select("chunk_id", "text_hash", F.coalesce("own", "alike", embed(F.col("text"))).alias("embedding"), reuse.alias("reuse"))


def store_problems(manifest: DataFrame, store: DataFrame, size: int) -> DataFrame:
    """(chunk_id, problem): chunks whose stored vector is missing, unknown to the manifest, stale or of a wrong size.

    manifest is (chunk_id, text_hash), store (chunk_id, text_hash, embedding); hashes are compared, nulls as equal.
    """
    m, s = manifest.select("chunk_id", F.col("text_hash").alias("due"), F.lit(True).alias("listed")), store.select("chunk_id", F.col("text_hash").alias("held"), "embedding", F.lit(True).alias("stored"))
    problem = F.when(F.col("stored").isNull(), "missing").when(F.col("listed").isNull(), "unknown").when(~F.col("due").eqNullSafe(F.col("held")), "stale").when(F.coalesce(F.size("embedding"), F.lit(-1)) != size, "size")
    return m.join(s, "chunk_id", "full_outer").select("chunk_id", problem.alias("problem")).filter("problem is not null")


def source_states(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_count, ids_hash, texts_hash): per source the ordered chunk ids and text hashes, folded.

    Hashes are first folded per document, so a source that holds a third of all chunks isn't gathered as single rows.
    """
    per = chunks.groupBy("source_id", "doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("chunk_id")), "\n"), 256).alias("ids"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", F.coalesce("text_hash", F.lit("")).alias("h")))), lambda x: x["h"]), "\n"), 256).alias("texts"),
    )
    by_doc = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", c))), lambda x: x[c]), "\n"), 256)
    return per.groupBy("source_id").agg(F.sum("n").alias("chunk_count"), by_doc("ids").alias("ids_hash"), by_doc("texts").alias("texts_hash"))


def manifest_differences(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(source_id, problem): sources whose recorded state isn't the actual one."""
    a, b = recorded.alias("a"), actual.alias("b")
    problem = F.when(F.col("b.source_id").isNull(), "missing").when(F.col("a.source_id").isNull(), "unknown").when(F.col("a.chunk_count") != F.col("b.chunk_count"), "count").when(F.col("a.texts_hash") != F.col("b.texts_hash"), "content")
    joined = a.join(b, F.col("a.source_id") == F.col("b.source_id"), "full_outer")
    return joined.select(F.coalesce("a.source_id", "b.source_id").alias("source_id"), problem.alias("problem")).filter("problem is not null")


class ActivePointer:
    """The control file that names the active version; it is replaced by renaming, so readers never see half of it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def read(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def activate(self, version: str) -> dict:
        """Make `version` active; activating it again changes nothing, the one before is remembered."""
        if not re.match(VERSION_ID, version):
            raise ValueError(f"not a version id: {version!r}")
        now = self.read() if os.path.exists(self.path) else {"version": None, "previous": None}
        return now if now["version"] == version else self._write({"version": version, "previous": now["version"]})

    def rollback(self) -> dict:
        now = self.read()
        if not now["previous"]:
            raise ValueError("there is no version to go back to")
        return self._write({"version": now["previous"], "previous": None})

    def _write(self, state: dict) -> dict:
        handle, staged = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(self.path)))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(state, f)
        os.replace(staged, self.path)
        return state


def gate_cases(cases: DataFrame, retrieved: DataFrame, k: int = 7) -> DataFrame:
    """(query_id, category_hits, term_hits, passed): whether the first k results reach the case's expectations.

    cases are (query_id, categories, terms, least_categories, least_terms); retrieved are (query_id, rank, category, text).
    """
    top = retrieved.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("category").alias("found"), F.lower(F.concat_ws("\n", F.collect_list("text"))).alias("blob"))
    joined = cases.join(top, "query_id", "left")
    hits = F.size(F.array_intersect(F.col("categories"), F.coalesce("found", F.array().cast("array<string>"))))
    terms = F.size(F.filter("terms", lambda t: F.coalesce(F.col("blob"), F.lit("")).contains(F.lower(t))))
    return joined.select("query_id", hits.alias("category_hits"), terms.alias("term_hits"), ((hits >= F.col("least_categories")) & (terms >= F.col("least_terms"))).alias("passed"))
