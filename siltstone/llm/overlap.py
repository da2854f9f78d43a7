"""Same or nearly the same questions across splits: rare shingles of either question meet, verified exactly.

Copies that say the same in the same writing of names and figures form classes first, so that a text delivered any
number of times is compared once. The shingles of a class are put in one order for all, the rare ones first. Two
classes that are alike enough share one of the first shingles of both (as many as could be missing in the other, and
one), so a bucket is such a shingle together with what the rules for names and figures let both questions hold; only
classes from different splits meet in it, and every pair to find does. What meets is verified by the exact Jaccard
similarity of the shingles, the names and the figures, and then expanded to its members.

Here a shingle is two tokens (words, single ideographs) and the similarity 0.45 or more: the cases to find differ
in single words, typing errors and whole side remarks, which leaves short questions far below 0.8.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut
from siltstone.sources.tables import latest

SIMILARITY = 0.45
TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_一-鿿぀-ヿ가-힯]+(?:-[^\W\d_一-鿿぀-ヿ가-힯]+)*|[一-鿿぀-ヿ가-힯]")
INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤﻿]")
COMPOUND = re.compile(r"(?<![A-Za-z])[a-z]{2,}-[a-z]{2,}(?![a-z])", re.I)
NAME = re.compile(r"(?<![A-Za-z])[A-Z][a-z]+-[A-Z][a-z]+(?![A-Za-z])")
FIGURE = re.compile(r"\d+(?:\.\d+)?")
TORN = re.compile(r"(?<=\d)\s+(?=[\d.])|(?<=\d\.)\s+(?=\d)")
WINDOW = re.compile(r"(?<=([a-z]{2}))-(?=([a-z]{2}))")
RUN = re.compile(r"(?<![a-z])[a-z]+(?:-[a-z]+)+")
#: Shingles are counted by these bits of their hashes; the counts only order them, so that they may be shared.
PLACES = 1 << 14
#: Bucket rows made at once by a task, beside those of one long question.
MOST_ROWS = 1 << 17


def _hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def normal_writing(question: str) -> str:
    """Compatibility forms and invisible characters undone; a hyphen with a blank on one side closed up."""
    text = question if question.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", question))
    return re.sub(r"(?<=[A-Za-z])(?: -|- )(?=[A-Za-z])", "-", text) if " -" in text or "- " in text else text


#: Hashes of tokens met before by this Python worker; questions share most of their words.
_KNOWN: dict[str, int] = {}
_KNOWN_MOST = 1 << 20


def shingles_of(tokens: list[str]) -> np.ndarray:
    """The distinct hashes of neighbouring tokens, in order; of the token where there is but one."""
    if len(_KNOWN) > _KNOWN_MOST:
        _KNOWN.clear()
    for t in tokens:
        if t not in _KNOWN:
            _KNOWN[t] = _hash64(t)
    h = np.array([_KNOWN[t] for t in tokens], np.uint64)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(h) > 1 else h
        return np.unique(pairs ^ (pairs >> np.uint64(32))).view(np.int64)


def question_facts(text: str) -> dict:
    """Names and figures of normal writing, as the rules for them need them. What decides beside the shingles is all here."""
    low = text.lower()
    capital = sorted({n.lower() for n in NAME.findall(text)})
    raw = FIGURE.findall(low)
    return {
        "names": capital or sorted({n.lower() for n in COMPOUND.findall(text)}),
        "capital": bool(capital),
        "raw": " ".join(sorted(raw)),
        "closed": " ".join(sorted(FIGURE.findall(TORN.sub("", low)) if raw else raw)),
        # Whatever holds a name once the blanks are gone.
        "compact": " ".join(RUN.findall("".join(low.split()))) if "-" in low else "",
    }


def question_profile(question: str) -> dict:
    """What the stages need about one question that holds a token: shingles, names, figures, and the keys of its buckets.

    Questions that may be the same share a key of the one's train_keys and the other's held_keys. A capital name must
    stand in the other question without its blanks, so the letters around its hyphen stand around one there; where
    neither question has a capital name, both have other names or none. Either way the digits are the same.
    """
    text = normal_writing(question)
    facts = question_facts(text)
    digits = "".join(sorted(facts["raw"].replace(".", "").replace(" ", "")))
    windows = {"-".join(w) for w in WINDOW.findall(facts["compact"])}
    plain = set() if facts["capital"] else {"named" if facts["names"] else "nameless"}
    own = {"-".join(WINDOW.findall(facts["names"][0])[0])} if facts["capital"] else windows | plain

    def hashed(keys: set[str]) -> list[int]:
        return sorted(_hash64(f"{k}|{digits}") - (1 << 63) for k in keys)

    return {**facts, "shingles": shingles_of(TOKEN.findall(text.lower())), "train_keys": hashed(own), "held_keys": hashed(windows | plain)}


def first_shingles(shingles: pa.ListArray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, size, left) of the first shingles of each row: rare ones first, as many as must meet an alike row.

    Of `size` shingles at least similarity * size are shared with an alike row. `left` is how many there are from this
    one on, and so the most that are shared if this is the first shared one.
    """
    sizes = np.diff(shingles.offsets.to_numpy()).astype(np.int64)
    values = shingles.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    values = values[np.lexsort((values, counts[values & (len(counts) - 1)], row))]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(values))
    kept = left >= np.ceil(similarity * sizes - 1e-9)[row]
    return row[kept], values[kept], sizes[row[kept]], left[kept]


def marks_of(shingles: pa.ListArray) -> np.ndarray:
    """128 bits per row, one set per shingle, as two numbers: rows differ in at most one bit per shingle that only one has."""
    sizes = np.diff(shingles.offsets.to_numpy())
    bits = np.zeros((len(sizes), 128), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), (shingles.flatten().to_numpy() >> 20) & 127] = True
    return np.packbits(bits, axis=1).view(np.int64)


def bucket_rows(shingles: pa.ListArray, keys: pa.ListArray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, size, left): each of the first shingles with each key of its row."""
    row, shingle, size, left = first_shingles(shingles, counts, similarity)
    starts, many = keys.offsets.to_numpy()[:-1] - keys.offsets[0].as_py(), np.diff(keys.offsets.to_numpy())
    each = many[row]
    nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    key = keys.flatten().to_numpy()[np.repeat(starts[row], each) + nth].view(np.uint64)
    with np.errstate(over="ignore"):
        bucket = (np.repeat(shingle, each).view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) ^ (key * np.uint64(0xC4CEB9FE1A85EC53))
        bucket ^= bucket >> np.uint64(32)
    return np.repeat(row, each), bucket.view(np.int64), np.repeat(size, each), np.repeat(left, each)


PROFILE = "class_id binary, train boolean, held boolean, names array<string>, capital boolean, raw string, closed string, compact string, shingles array<bigint>, train_keys array<bigint>, held_keys array<bigint>"


def class_of(question: str) -> bytes | None:
    text = normal_writing(question)
    tokens = TOKEN.findall(text.lower())
    if not tokens:
        return None
    facts = question_facts(text)
    return md5("\n".join([" ".join(tokens), " ".join(facts["names"]), str(facts["capital"]), facts["closed"], facts["compact"]]).encode("utf-8", "surrogatepass")).digest()


def members_of(questions: DataFrame) -> DataFrame:
    """(id, side, class_id, question) of the questions of known splits, one per id (the latest created one).

    class_id tells apart what a question says after normalisation of its writing, and how it writes names and figures:
    all questions of a class are the same as the same others.
    """
    split = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    side = F.when(split == "train", "train").when(split.isin("dev", "holdout"), "held")
    one = latest(questions.select("id", side.alias("side"), "question", "created_at"), ["id"], ["created_at"], ["side", "question"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([class_of(q) for q in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, batch.column(2)], names=["id", "side", "class_id", "question"])

    made = one.filter("side is not null and question is not null").select("id", "side", "question").mapInArrow(run, "id string, side string, class_id binary, question string")
    return made.filter("class_id is not null")


def profiles(classes: DataFrame) -> DataFrame:
    """PROFILE of (class_id, train, held, question), one question per class."""
    names = [x.split()[0] for x in PROFILE.split(", ")]
    made = names[3:]
    types = [pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [question_profile(q) for q in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array([r[n] for r in rows], t) for n, t in zip(made, types)]], names=names)

    return classes.select("class_id", "train", "held", "question").mapInArrow(run, PROFILE)


def shingle_counts(about: DataFrame) -> np.ndarray:
    """How many shingles of all classes have each of the PLACES low bits: what reaches the driver doesn't grow."""
    counts = np.zeros(PLACES, np.int64)
    found = about.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(PLACES - 1).alias("place")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return counts


def placed(about: DataFrame, side: str, counts: np.ndarray, similarity: float) -> DataFrame:
    """(bucket, class_id, size, left, low, high): the buckets of the classes of one side, train or held, with their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.diff(batch.column(1).offsets.to_numpy()) * np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            starts = np.flatnonzero(np.diff((np.cumsum(made) - made) // MOST_ROWS, prepend=-1)).tolist()
            for at, to in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(at, to - at)
                row, bucket, size, left = bucket_rows(part.column(1), part.column(2), counts, similarity)
                low, high = marks_of(part.column(1))[row].T
                arrays = [pa.array(bucket), part.column(0).take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (size, left)], *[pa.array(np.ascontiguousarray(x)) for x in (low, high)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "class_id", "size", "left", "low", "high"])

    return about.filter(side).select("class_id", "shingles", f"{side}_keys").mapInArrow(run, "bucket bigint, class_id binary, size int, left int, low bigint, high bigint")


def split_overlaps(questions: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(train_id, held_id, similarity): all pairs of a train and a dev or holdout question that are the same.

    The same means: they name the same project, hold the same figures, and their shingles are at least `similarity`
    alike. Pairs within a split, and of dev with holdout, are none. Splits are told apart without regard to case
    and outer blanks; other splits, null questions and questions without any token take no part. Repeated rows
    collapse to one per id, the latest created. A question without a name only matches one without, or one whose
    capital names it holds across blanks. `similarity` is above 0; at any such value no pair is left out.
    """
    members = cut(members_of(questions))
    classes = members.groupBy("class_id").agg(F.bool_or(F.col("side") == "train").alias("train"), F.bool_or(F.col("side") == "held").alias("held"), F.min("question").alias("question"))
    sides = cut(classes)
    about = cut(profiles(sides))
    counts = shingle_counts(about)
    left, right = (placed(about, side, counts, similarity).select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("class_id", "size", "left", "low", "high")]) for side, x in (("train", "a"), ("held", "b")))
    sizes = F.col("size_a") + F.col("size_b")
    differ = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
    most = F.least(F.col("left_a"), F.col("left_b"), F.floor((sizes - differ) / 2))  # that may be shared
    met = left.join(right, "bucket").filter((F.col("class_id_a") != F.col("class_id_b")) & (most >= similarity * (sizes - most) - 1e-9))
    met = met.select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).distinct()
    about = about.drop("train", "held", "train_keys", "held_keys")
    one, two = (about.select(*[F.col(c).alias(f"{c}_{x}") for c in about.columns]) for x in "ab")
    facing = met.join(one, met.a == one.class_id_a).join(two, met.b == two.class_id_b)
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    alike = shared / (F.size("shingles_a") + F.size("shingles_b") - shared)
    figures = (F.col("raw_a") == F.col("raw_b")) | (F.col("closed_a") == F.col("closed_b")) | (F.col("raw_a") == F.col("closed_b")) | (F.col("closed_a") == F.col("raw_b"))

    def within(names: str, text: str):
        return F.forall(names, lambda n: F.col(text).contains(n))

    def near(names: str, others: str):
        return F.forall(F.array_except(names, others), lambda n: F.exists(others, lambda o: F.levenshtein(n, o) <= 3))

    named = (
        F.when(F.col("capital_a") & F.col("capital_b"), within("names_a", "compact_b") & within("names_b", "compact_a"))
        .when(F.col("capital_a"), within("names_a", "compact_b"))
        .when(F.col("capital_b"), within("names_b", "compact_a"))
        .otherwise(near("names_a", "names_b") & near("names_b", "names_a"))
    )
    verified = facing.withColumn("similarity", alike).filter(named & figures & (F.col("similarity") >= similarity)).select("a", "b", "similarity")
    own = sides.filter("train and held").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("similarity"))
    pairs = verified.unionByName(own)
    trained = members.filter("side = 'train'").select(F.col("class_id").alias("a"), F.col("id").alias("train_id"))
    held = members.filter("side = 'held'").select(F.col("class_id").alias("b"), F.col("id").alias("held_id"))
    return pairs.join(trained, "a").join(held, "b").select("train_id", "held_id", "similarity")


def overlap_counts(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(split, generator, overlapping, pairs): the held-out questions that occur in train, per split and generator.

    generator is spelled evenly and unknown where null. Counts are of one row per id.
    """
    facts = latest(
        questions.select("id", F.lower(F.regexp_replace("split", r"^\s+|\s+$", "")).alias("split"), F.coalesce(F.lower(F.regexp_replace("generator", r"^\s+|\s+$", "")), F.lit("unknown")).alias("generator"), "created_at"),
        ["id"],
        ["created_at"],
        ["split", "generator"],
    )
    per = pairs.groupBy(F.col("held_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return facts.join(per, "id").groupBy("split", "generator").agg(F.count(F.lit(1)).alias("overlapping"), F.sum("n").alias("pairs"))
