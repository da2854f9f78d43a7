"""Splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over the text names landmarks: places that depend only on the few characters around them. Each
landmark snaps to the nearest natural boundary, preferring paragraph over line, sentence and word ends, within the
piece's minimum and maximum size. As landmarks don't depend on what lies far before, an edit alters only the pieces
next to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import latest

LIMIT = 3500
LEAST = 1200
OVERLAP = 200
WINDOW = 32
#: One place in so many is a landmark.
SPACING = 512
#: How far from a landmark a boundary of a better kind may lie.
REACH = (400, 240, 160, 80)

#: Ends of paragraphs, lines, sentences and words: a cut is made behind the match.
ENDS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[。！？]+[”’」』）]*\s*|[.!?]+[\"”’)\]]*\s+"),
    re.compile(r"\s+"),
)
UNBROKEN = re.compile(r"[^\s。！？]+")


def landmarks(text: str) -> np.ndarray:
    """Places whose rolling hash over the WINDOW characters before them is 0 modulo SPACING."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) <= WINDOW:
        return np.zeros(0, np.int64)
    # A polynomial hash modulo 2**64 of every window, from prefix hashes with inverse powers of an odd base.
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        back = np.cumprod(np.full(len(codes), inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * back)])
        forward = np.cumprod(np.full(len(codes), base, np.uint64))
        hashes = (sums[WINDOW:] - sums[:-WINDOW]) * forward[WINDOW - 1 :]
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(SPACING) == 0) + WINDOW


def cut_places(text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """[(start, end, forced)]: consecutive spans of new text; only the last need not end at a boundary.

    A span and the overlap before it never exceed `limit` together: the overlap shrinks where a span needs the
    room. forced says that the span ends inside a run longer than the limit that has no boundary at all.
    """
    ends = [[m.end() for m in kind.finditer(text)] for kind in ENDS]
    marks = landmarks(text).tolist()
    spans: list[tuple[int, int, bool]] = []
    start = 0
    while len(text) - start > limit - (overlap if start else 0):
        room = limit - (overlap if start else 0)
        low, high = start + min(least, room), start + room
        place = None
        at = bisect_left(marks, low)
        while at < len(marks) and marks[at] <= high and place is None:
            mark = marks[at]
            for kind, reach in zip(ends, REACH):
                place = _nearest(kind, max(low, mark - reach), min(high, mark + reach), mark)
                if place is not None:
                    break
            at += 1
        if place is None:  # no landmark near a boundary: the last boundary of the best kind
            for kind in ends:
                place = _last(kind, low, high)
                if place is not None:
                    break
        if place is None:  # every boundary lies before the least size, or in the room the overlap would take
            for kind in ends[2:]:
                place = _last(kind, start + 1, start + limit)
                if place is not None:
                    break
        forced = place is None
        if forced:
            place = start + limit
        spans.append((start, place, forced))
        start = place
    if start < len(text):
        spans.append((start, len(text), False))
    return spans


def _nearest(places: list[int], low: int, high: int, mark: int) -> int | None:
    a, b = bisect_left(places, low), bisect_right(places, high)
    return min(places[a:b], key=lambda p: (abs(p - mark), p), default=None)


def _last(places: list[int], low: int, high: int) -> int | None:
    at = bisect_right(places, high) - 1
    return places[at] if at >= 0 and places[at] >= low else None


def split_text(text: str | None, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> list[dict]:
    """Pieces in order: start and end of the new text, the overlap before it, whether its end was forced, the text."""
    if text is None:
        return []
    if len(text) <= limit:
        return [{"start": 0, "end": len(text), "overlap": 0, "forced": False, "text": text}]
    out = []
    for start, end, forced in cut_places(text, limit, least, overlap):
        back = min(overlap, start, limit - (end - start))
        if back > 0:
            # The repeated part begins behind a blank or a sentence's end, if there is one in it.
            if found := re.search(r"[\s。！？]+", text[start - back : start - 1]):
                back -= found.end()
        out.append({"start": start, "end": end, "overlap": max(0, back), "forced": forced, "text": text[start - max(0, back) : end]})
    return out


PIECES = "array<struct<piece_no:int,start:int,end:int,overlap:int,forced:boolean,text:string>>"


def _split(limit: int):
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"piece_no": i, **p} for i, p in enumerate(split_text(t, limit))] for t in texts])

    return F.pandas_udf(split, PIECES)


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id, heading_path, text) of the current records whose text exceeds the limit.

    Only texts that may matter are shuffled: of the others, the time they were loaded.
    """
    long = F.char_length("text") > limit
    marked = chunks.select(
        "chunk_id",
        "loaded_at",
        F.coalesce(long, F.lit(False)).alias("long"),
        F.when(long, F.col("heading_path")).alias("heading_path"),
        F.when(long, F.col("text")).alias("text"),
    )
    return latest(marked, ["chunk_id"], ["loaded_at"], ["long", "text", "heading_path"]).filter("long").drop("long")


def split_chunks(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id, heading_path, piece_no, start, end, overlap, forced, text): the pieces of oversized current records.

    The pieces of a chunk are numbered from 0 in order. `text` is at most `limit` code points, of which the first
    `overlap` (at most 200) repeat the end of the piece before; new text runs from `start` to `end`. A text without
    any boundary for more than `limit` code points is cut by force there and nowhere else. Null and shorter texts
    give no pieces, repeated rows collapse, of several deliveries the latest counts, a null chunk_id is no record.
    """
    pieces = oversized(chunks, limit).select("chunk_id", "heading_path", F.explode(_split(limit)("text")).alias("p"))
    return pieces.select("chunk_id", "heading_path", *[F.col(f"p.{c}").alias(c) for c in ("piece_no", "start", "end", "overlap", "forced", "text")])


def split_kinds(chunks: DataFrame) -> DataFrame:
    """(chunk_id, cut): every oversized chunk, forced if any of its pieces had to end inside an unbroken run."""
    return split_chunks(chunks).groupBy("chunk_id").agg(F.when(F.bool_or("forced"), "forced").otherwise("natural").alias("cut"))
