"""Token budget: how many tokens each text holds under the project's estimate, rolled up exactly.

A text is taken apart into pieces; each distinct piece is held as a linked symbol list whose neighbouring word
characters merge through a priority queue until runs are left. The symbols that survive - ideographs, runs and
other code points - are counted once per distinct piece, weighted by how often the text holds it, and put together
as int(1.2 x ideographs + 1.3 x runs + others / 4).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import CACHE_PARTS, merge_symbols
from siltstone.llm.language import language_of
from siltstone.sources.tables import latest

#: Ideograph runs have nothing to merge; other pieces end at white space.
PIECES = re.compile(r"[一-鿿]+|[^\s一-鿿]+|\s+")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def surviving_symbols(piece: str) -> tuple[int, int, int]:
    """(ideographs, runs, others) that survive when neighbouring word characters are merged."""
    first = piece[0]
    if "一" <= first <= "鿿":
        return len(piece), 0, 0
    if first.isspace():
        return 0, 0, len(piece)
    left = merge_symbols(list(piece), lambda a, b: 0 if a[0] in WORD and b[0] in WORD else None, lambda a, b: a + b)
    runs = sum(s[0] in WORD for s in left)
    return 0, runs, len(left) - runs


class Estimator:
    """The project's estimate: each distinct piece of a text counts once, times how often it occurs there.

    Pieces known from other texts are kept per Python worker. Weights are taken per text, as the estimate is cut to
    an integer per text, and sums over a corpus of these integers are exact.
    """

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int]] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        known, ideographs, runs, others = self.known, 0, 0, 0
        for piece, many in Counter(PIECES.findall(text)).items():
            first = piece[0]
            if "一" <= first <= "鿿":
                ideographs += len(piece) * many
                continue
            got = known.get(piece)
            if got is None:
                got = surviving_symbols(piece)
                if len(piece) <= 64:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[piece] = got
            runs += got[1] * many
            others += got[2] * many
        return int(1.2 * ideographs + 1.3 * runs + others / 4)


def estimate_tokens(df: DataFrame, keep: list[str], text: str = "text", with_language: bool = False) -> DataFrame:
    """The columns `keep` with `tokens`, the estimate of the whole text (0 for null and empty texts).

    with_language adds `text_lang`, the language the text itself shows (null where it says too little).
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens int" + ", text_lang string" * with_language
    names = [*keep, "tokens", *["text_lang"] * with_language]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate = Estimator()
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array([estimate(t) for t in texts], pa.int32())]
            if with_language:
                arrays.append(pa.array([language_of(t) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def wrong_estimates(chunks: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(chunk_id, token_estimate, tokens) of current records whose stored estimate is null or too far off.

    Far off is more than `tolerance` of the estimate away. The current record of a chunk_id is the latest loaded;
    a null loaded_at is the earliest, ties go to the larger estimate. Repeated rows collapse; a null chunk_id is
    no record. A null or empty text has the estimate 0, from which any stored value but 0 is too far.
    """
    counted = estimate_tokens(chunks, ["chunk_id", "loaded_at", "token_estimate"])
    current = latest(counted, ["chunk_id"], ["loaded_at"], ["tokens", "token_estimate"])
    off = F.col("token_estimate").isNull() | (F.abs(F.col("token_estimate") - F.col("tokens")) > tolerance * F.col("tokens"))
    return current.filter(off).select("chunk_id", "token_estimate", "tokens")


def squeezed(column: Column | str) -> Column:
    """Lower case without outer blanks, null where nothing is left."""
    column = F.col(column) if isinstance(column, str) else column
    bare = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def budget_rollup(documents: DataFrame, chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(part, source_id, language, category, texts, tokens): totals of documents and current chunks, with subtotals.

    part is documents or chunks. language is what the text itself shows, else the stated language's first letters,
    else und; chunks state none. category is the manifest's for the source (spelled evenly), else unknown, and so
    is a source that is null or not in the manifest. Each (part, source, language, category) has one row, as have
    the totals per source, per language, per category and per part, in which the other columns are null. Repeated
    rows of documents count once per doc_id, chunks once per chunk_id (their latest record).
    """
    known = manifest.select(squeezed("source_id").alias("source_id"), squeezed("category").alias("category")).filter("source_id is not null").groupBy("source_id").agg(F.max("category").alias("category"))
    docs = estimate_tokens(documents, ["doc_id", "source", "lang"], with_language=True)
    docs = docs.groupBy("doc_id").agg(F.max(F.struct("tokens", "text_lang", "source", "lang")).alias("r")).select("r.*")
    docs = docs.select(F.lit("documents").alias("part"), squeezed("source").alias("source_id"), "text_lang", "lang", "tokens")
    parts = latest(estimate_tokens(chunks, ["chunk_id", "loaded_at", "source_id"], with_language=True), ["chunk_id"], ["loaded_at"], ["tokens", "text_lang", "source_id"])
    parts = parts.select(F.lit("chunks").alias("part"), squeezed("source_id").alias("source_id"), "text_lang", F.lit(None).cast("string").alias("lang"), "tokens")
    stated = F.regexp_extract(squeezed("lang"), r"^([a-z]{2})(?:-|_|$)", 1)
    both = docs.unionByName(parts).withColumn("language", F.coalesce("text_lang", F.when(stated != "", stated), F.lit("und")))
    # Counts first, so that what meets the manifest is one row per source and language.
    sums = both.groupBy("part", "source_id", "language").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens").cast("long")).alias("tokens"))
    listed = sums.join(known.withColumn("listed", F.lit(True)), "source_id", "left")
    named = listed.select("part", F.when(F.col("listed"), F.col("source_id")).otherwise("unknown").alias("source_id"), "language", F.coalesce("category", F.lit("unknown")).alias("category"), "texts", "tokens")
    sets = [["part", "source_id", "language", "category"], ["part", "source_id"], ["part", "language"], ["part", "category"], ["part"]]
    return named.groupingSets([[F.col(c) for c in s] for s in sets], "part", "source_id", "language", "category").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
