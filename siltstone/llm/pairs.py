"""Broken prompt and response pairs: empty, copied, refused, foreign and truncated answers.

Openings of answers, with names and figures masked, are clustered by verified MinHash over all turns. What marks a
refusal is the cluster, not the answer: its openings recur over unrelated prompts, and the answers that begin with
them are reluctant, or go on as reluctant answers do. An answer that opens with such a template and says nothing
else is a refusal; checks of copying, language and termination label the remaining defects.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.language import CODE, has_code, language_of, language_scores, mostly_ideographs
from siltstone.session import cut
from siltstone.sources.tables import latest

#: Words or ideographs of an opening.
LONG = 16
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
#: A template opens answers to PROMPTS unrelated prompts, and this share of them is reluctant; or in REVEALED of them, and in
#: that share, answers go on as reluctant ones do.
PROMPTS, RELUCTANT_SHARE, REVEALED, REVEALED_SHARE = 2, 0.5, 3, 0.1
#: Code points that an answer may hold beside its opening and closing sentences and still say nothing else.
BESIDE = 12

INVISIBLE = re.compile(r"[\s­​-‏‪-‮⁠-⁤﻿]+")
#: A capitalised word with a further capital or a hyphen inside is taken for a name.
NAME = re.compile(r"\b[A-Z][A-Za-z]*(?:-[A-Z]|[A-Z])[A-Za-z]*\b")
TOKEN = re.compile(r"\d+|[一-鿿]|[^\W\d_一-鿿]+(?:['’][^\W\d_一-鿿]+)*")
# Stand-ins for an answer, and labels without one.
STAND_IN = re.compile(
    r"""(?:\(?\ *(?:no\ answer|no\ response|empty|none|null|nil|nan|n\.?/?a\.?|undefined|blank|tbd|todo|missing|not\ available|leer|keine\ antwort|aucune\ réponse|sin\ respuesta|vide|vacío)\ *\)?|<\ *(?:empty|none|null|blank|no\ answer)\ *>|无|暂无|空|没有回答|无回答|（无）|（空）|暂无回答
    |\{\}|\[\]|\(\)|""|''|(?:answer|response|reply|a|assistant|antwort|réponse|reponse|respuesta|sources?|references?|quellen|fuentes|回答|答案|答|回复|来源|参考)\s*[:：]?)""",
    re.X | re.I,
)
#: More letters than any stand-in or label has.
WORDY = re.compile(r"(?:\w\W*){60}")
SOURCES = re.compile(r"(?:^|\n)\s*(?:sources?|references?|quellen|fuentes|来源|参考)\s*[:：]\s*(?:\n\s*\[\d+\][^\n]*)*\s*\Z", re.I)
# Who speaks (or what was asked) followed by a negation. Alone it decides nothing.
RELUCTANT = re.compile(
    r"""\b(?:I|we|my|this\ request|this\ question)\b[^.!?\n]*?\b(?:not|cannot|can['’]t|won['’]t|don['’]t|unable|decline|refuse|pass|outside|beyond)\b
    |(?:我|恕|这个请求)[^。！？\n]*?(?:无法|不能|不便|没办法|不可以|不会|拒绝|不谈|范围)
    |\bich\b[^.!?\n]*?\b(?:nicht|keine|ablehnen)\b|\bnicht\b[^.!?\n]*?\bich\b
    |\b(?:je\b|me\b|m['’])[^.!?\n]*?\b(?:pas|refuser|décliner)\b
    |\bno\ (?:puedo|me|estoy|tengo|se\ me)\b|\bdebo\ (?:declinar|rechazar)\b""",
    re.X | re.I,
)
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
ENDED = re.compile(r"[.!?。！？…][\"'”’」』）)\]*_`]*$|[)）\]】」』”\"`][.!?。！？]?$")
CITED = re.compile(r"(?:\s*\[\d+(?:\s*[,-]\s*\d+)*\]|\s*[\U0001F300-\U0001FAFF☀-➿️‍]+)+$")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)、])\s")
BARE_ITEM = re.compile(r"\n\s*(?:[-*+•]|\d{1,3}[.)、])\s*\Z")
SETTING = re.compile(r"^\s*[\w.\-]+\s*[=:]\s*\S+$")
ASKED = {
    "en": re.compile(r"\b(?:in|into)\ english|英文|英语|auf\ englisch|en\ anglais|en\ inglés", re.X | re.I),
    "de": re.compile(r"\b(?:in|into)\ german|德语|德文|auf\ deutsch|en\ allemand|en\ alemán", re.X | re.I),
    "fr": re.compile(r"\b(?:in|into)\ french|法语|法文|auf\ französisch|en\ français|en\ francés", re.X | re.I),
    "es": re.compile(r"\b(?:in|into)\ spanish|西班牙|auf\ spanisch|en\ espagnol|en\ español", re.X | re.I),
    "zh": re.compile(r"\b(?:in|into)\ (?:simplified\ |traditional\ )?(?:chinese|mandarin)|中文|汉语|auf\ chinesisch|en\ chinois|en\ chino", re.X | re.I),
}
OPENERS = re.compile(r"^(?:sure|of course|certainly|okay|ok|yes|no|好的|当然|可以|没问题|natürlich|gern|bien sûr|claro|por supuesto)\s*[!,.，。！:：]\s*", re.I)
WIDE = re.compile("[\u2e81-\U0010ffff]")
FIGURE = re.compile(r"\d+(?:[.,]\d+)*")
QUOTED = re.compile(r"^\s*>[^\n]*\n+")
SETTINGS = re.compile(r"(?m)^[\w.\-]+[ \t]*[=:][ \t]*\S+[ \t]*$")
LABELLED = re.compile(r"^\s*(?:>+\s?)|^\s*(?:question|frage|pregunta|user|q|问题|问|提问)\s*[:：]\s*", re.I | re.M)


def squeeze(text: str) -> str:
    """Letters and digits only, compatibility forms undone, case folded."""
    return re.sub(r"[\W_]+", "", (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    core = SOURCES.sub("", answer.strip())
    if WORDY.match(core):
        return False
    bare = INVISIBLE.sub(" ", answer).strip()
    core = INVISIBLE.sub(" ", re.sub(r"```\w*\s*```|~~~\w*\s*~~~", " ", core)).strip()
    core = core.strip(" .。…-–—_*#>`~,，;；!！?？|/\\\"'")
    return not core or not bare or bool(STAND_IN.fullmatch(core) or STAND_IN.fullmatch(bare))


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question, apart from writing, labels and quotation."""
    if not question:
        return False
    q, a = squeeze(question), squeeze(LABELLED.sub("", answer))
    if not a or not q:
        return False
    if a in q and len(a) >= 0.4 * len(q):
        return True
    if len(a) < 0.4 * len(q) or len(a) < 8:
        return False
    n = 2 if not a.isascii() and len(WIDE.findall(a)) > len(a) // 3 else 3
    # A copy has its grams in the question wherever one looks: at half of twelve places at least.
    if sum(a[at : at + n] in q for at in range(0, len(a) - n + 1, max(1, (len(a) - n + 1) // 12))) < 6:
        return False
    grams = {q[i : i + n] for i in range(len(q) - n + 1)}
    known = [a[i : i + n] in grams for i in range(len(a) - n + 1)]
    if not known or sum(known) < 0.75 * len(known):
        return False
    # What isn't in the question may be errors in writing here and there, but not a passage of its own.
    covered = bytearray(len(a))
    for i, k in enumerate(known):
        if k:
            covered[i : i + n] = b"\x01" * n
    longest = max((len(x) for x in bytes(covered).split(b"\x01")), default=0)
    return longest <= 10


def is_foreign(question: str | None, answer: str) -> bool:
    """In a language that is neither the question's nor asked for in it; code and names don't count."""
    if not question:
        return False
    if mostly_ideographs(question) and mostly_ideographs(answer):
        return False
    theirs = language_of(question)
    if theirs is None:
        return False
    body = SOURCES.sub("", QUOTED.sub("", answer)) if "\n" in answer else answer
    body = OPENERS.sub("", body.strip())
    scores = language_scores(SETTINGS.sub(" ", body) if "\n" in body else body)
    if not scores:
        return False
    best = max(scores, key=lambda k: (scores[k], k))
    if best == theirs or scores[best] < 2.5 or scores.get(theirs, 0.0) * 2 > scores[best]:
        return False
    return not (best in ASKED and ASKED[best].search(question))


def is_truncated(answer: str) -> bool:
    """Breaks off: an open code block or bracket, an item without content, or a last line of prose without an end."""
    text = answer.strip()
    if ("```" in text or "~~~" in text) and any(len(re.findall(rf"(?m)^\s*{mark}", text)) % 2 for mark in ("```", "~~~")):
        return True
    if text.endswith(("```", "~~~")) and re.search(r"(?m)^\s*(?:```|~~~)\Z", text):
        return False
    tail = SOURCES.sub("", text).rstrip() or text
    if BARE_ITEM.search(tail):
        return True
    last = tail.split("\n")[-1].strip()
    bare = bare_end(last).rstrip()
    if not bare:
        return False
    if re.search(r"https?://\S+$", bare):
        return False
    if re.search(r"[,，、;；:：=(（\[【「“\-–—/&+]$", bare):
        return True
    if bare.count("(") > bare.count(")") or bare.count("（") > bare.count("）"):
        return True
    # A point after a figure in a text whose sentences end in an ideographic stop is a decimal point.
    if re.search(r"[一-鿿] ?\d+\.$", bare):
        return True
    if ENDED.search(bare):
        return False
    if ITEM.match(last):
        return bool(re.search(r"\b(?:and|or|the|a|an|to|of|with|for|in|how|choosing|und|der|die|das|et|le|la|de|y|el)$|[与和的]$", bare, re.I)) or not re.sub(ITEM, "", last + " ").strip()
    if bare.startswith("|") or SETTING.match(last) and len(last) < 60:
        return False
    if bare.startswith("#"):
        return False
    # A word or a figure alone is a short answer.
    prose = len(bare) if re.search(r"[一-鿿]", bare) else 2.5 * len(bare.split())
    return prose > 6


def defect_of(question: str | None, answer: str | None) -> str | None:
    """empty, copy, other_language, truncated or None; the first that holds. Refusals are told by their clusters only."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    if is_foreign(question, answer):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def opening_of(text: str, many: int = LONG) -> str:
    """The first words (or ideographs) of a masked text, apostrophes left out."""
    return " ".join(m[0].replace("'", "").replace("’", "") for m in islice(TOKEN.finditer(text), many))


def _hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def masked(text: str) -> str:
    """Names and figures masked, lower case."""
    return FIGURE.sub("0", NAME.sub("name", text)).lower()


def bare_end(text: str) -> str:
    """The text without citation marks and pictographs at its end."""
    text = text.strip()
    return CITED.sub("", text) if text[-1:] == "]" or text[-1:] > "\u2600" else text


def speech_of(answer: str) -> tuple[str | None, bool, list[int], list[int]]:
    """(opening, reluctant, later, lengths): how an answer opens, and the sentences after its opening one.

    The opening is the first sentence - with the next, where the first is but a word such as "Sorry." - up to LONG
    tokens. later holds the hashes of the masked other sentences that aren't reluctant, lengths their code points.
    """
    text = masked(bare_end(answer))
    said = [s for s in SENTENCES.split(text) if s and not s.isspace()]
    first = 2 if len(said) > 1 and len(said[0]) <= BESIDE else 1
    hesitant = [bool(RELUCTANT.search(s)) for s in said] if RELUCTANT.search(text) else [False] * len(said)
    others = [s for s, h in zip(said[first:], hesitant[first:]) if not h]
    return opening_of(" ".join(said[:first])) or None, any(hesitant), [_hash64(s) for s in others], [len(s) for s in others]


PROFILE = "id string, created_at double, prompt bigint, opening string, reluctant boolean, later array<bigint>, lengths array<int>, defect string"


def profiles(turns: DataFrame) -> DataFrame:
    """PROFILE of every delivered row: its defect but for refusals, and how its answer opens and goes on.

    prompt is the hash of the user_text with names and figures masked, so that the same question about another thing
    is no unrelated prompt. Empty and copied answers, and answers with code, have no opening.
    """
    types = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in PROFILE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, question, answer, created in zip(*(c.to_pylist() for c in batch.columns)):
                defect = defect_of(question, answer)
                silent = defect in ("empty", "copy") or has_code(answer) and CODE.search(answer)
                rows.append((i, created, _hash64(masked(question or "")), *((None, False, [], []) if silent else speech_of(answer)), defect))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)

    wanted = turns.select(F.col("id").cast("string"), "user_text", "answer", F.col("created_at").cast("double"))
    return wanted.filter("id is not null").mapInArrow(run, PROFILE)


_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**61, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**61, BANDS * ROWS, dtype=np.uint64)


def shingles_of(opening: str) -> list[int]:
    tokens = opening.split(" ")
    return sorted({_hash64(" ".join(tokens[i : i + SHINGLE])) for i in range(max(1, len(tokens) - SHINGLE + 1))})


def bands_of(shingles: list[list[int]]) -> np.ndarray:
    """(rows, BANDS) hashes of the bands of the rows' MinHash signatures; every row has at least one shingle."""
    sizes = np.fromiter(map(len, shingles), np.int64, len(shingles))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = np.concatenate([np.array(s, np.int64) for s in shingles]).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (values ^ (values >> np.uint64(31)))[:, None] * _A + _B
        least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), starts, axis=0).reshape(len(shingles), BANDS, ROWS)
        out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) * np.ones((len(shingles), 1), np.uint64)
        for r in range(ROWS):
            out = (out ^ least[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _signed(classes: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                shingles = [shingles_of(o) for o in part.column(0).to_pylist()]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(shingles) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands_of(shingles).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), bands], names=["form", "bands"])

    return classes.select("form").mapInArrow(sign, "form string, bands array<bigint>")


def _forms() -> F.Column:
    """The opening as a whole, and every run of SHINGLE tokens in it, which recur under more leads and endings."""
    t = F.split("opening", " ")
    runs = F.when(F.size(t) > SHINGLE, F.transform(F.sequence(F.lit(1), F.size(t) - SHINGLE + 1), lambda i: F.array_join(F.slice(t, i, SHINGLE), " "))).otherwise(F.array())
    return F.array_distinct(F.concat(F.array("opening"), runs))


def refusal_templates(brief: DataFrame) -> DataFrame:
    """(form): openings, or runs of five tokens of them, whose cluster is a refusal template.

    brief holds (prompt, opening, evident) of the answers that say nothing beside their opening. The cluster of a form
    are all forms whose five-word shingles are at least 0.8 alike to its own by exact Jaccard similarity, found in the
    bands of their MinHash signatures, and itself. A template's cluster opens answers to at least PROMPTS prompts, and
    half of these answers are evidently reluctant: they say so, or go on as reluctant answers do. Going on so reveals
    a template in which nothing is reluctant by itself: a tenth of the answers, in REVEALED prompts, is enough.
    """
    # Prompts are made distinct per form before they are counted, so an opening that a third of all turns share is
    # counted in parts.
    per = brief.select(F.explode(_forms()).alias("form"), "prompt", "reluctant", "evident").groupBy("form", "prompt").agg(F.max("reluctant").alias("reluctant"), F.max("evident").alias("evident"))
    classes = cut(per.groupBy("form").agg(F.count(F.lit(1)).alias("prompts"), F.count_if("reluctant").alias("reluctant"), F.count_if("evident").alias("evident")))
    signed = cut(_signed(classes))

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [(x, y, set(shingles_of(x)), set(shingles_of(y))) for x, y in zip(a, b)]
        return pd.Series([x == y or len(s & t) >= SIMILARITY * len(s | t) for x, y, s, t in pairs], dtype=bool)

    def near(some: DataFrame) -> DataFrame:
        """(form, near): the forms alike to some forms, themselves too."""
        placed = signed.select(F.col("form").alias("near"), F.explode("bands").alias("band"))
        met = signed.join(some, "form", "left_semi").select("form", F.explode("bands").alias("band")).join(placed, "band").select("form", "near").distinct()
        return met.filter(F.pandas_udf(alike, "boolean")("form", "near"))

    # Only clusters that hold an evidently reluctant form can pass; those are found first.
    holding = near(classes.filter("evident > 0").select("form")).select(F.col("near").alias("form")).distinct()
    verified = near(holding).join(classes.withColumnRenamed("form", "near"), "near")
    sums = verified.groupBy("form").agg(*[F.sum(c).alias(c) for c in ("prompts", "reluctant", "evident")])
    half, revealed = F.col("reluctant") >= RELUCTANT_SHARE * F.col("prompts"), (F.col("evident") >= REVEALED) & (F.col("evident") >= REVEALED_SHARE * F.col("prompts"))
    return sums.filter((F.col("prompts") >= PROMPTS) & (half | revealed)).select("form")


def refusal_closings(speech: DataFrame) -> DataFrame:
    """(said): sentences said, word for word but for names and figures, in at least REVEALED prompts, after reluctance in half of them."""
    per = speech.select(F.explode("later").alias("said"), "prompt", "reluctant").groupBy("said", "prompt").agg(F.max("reluctant").alias("reluctant"))
    counted = per.groupBy("said").agg(F.count(F.lit(1)).alias("n"), F.count_if("reluctant").alias("r"))
    return counted.filter((F.col("n") >= REVEALED) & (F.col("r") >= RELUCTANT_SHARE * F.col("n"))).select("said")


def broken_pairs(turns: DataFrame) -> DataFrame:
    """(id, defect) of the defective turns: empty, copy, refusal, other_language or truncated.

    One row per id, of its latest delivery (a null created_at is the earliest). A null answer is empty; with a null
    user_text only empty, refused and truncated answers can be told. A null id is left out. Of several defects the
    first in the order above counts. Texts are read in the scan; only profiles are shuffled. A wording that doesn't
    recur in unrelated prompts is no template, so a handful of turns holds no refusals.
    """
    one = cut(latest(profiles(turns), ["id"], ["created_at"], ["prompt", "opening", "reluctant", "later", "lengths", "defect"]))
    closings = refusal_closings(one)
    # What an answer says beside its opening: its other sentences, less those that close refusals.
    opened = one.filter("opening is not null")
    said = opened.select("id", F.explode(F.arrays_zip("later", "lengths")).alias("s")).select("id", F.col("s.later").alias("said"), F.col("s.lengths").alias("length"))
    closing = said.join(closings, "said", "left_semi").groupBy("id").agg(F.sum("length").alias("closing"))
    beside = F.aggregate("lengths", F.lit(0), lambda a, b: a + b) - F.coalesce("closing", F.lit(0))
    brief = opened.join(closing, "id", "left").filter(beside <= BESIDE)
    brief = cut(brief.select("id", "prompt", "opening", "reluctant", (F.col("reluctant") | F.col("closing").isNotNull()).alias("evident")))
    refused = brief.select("id", F.explode(_forms()).alias("form")).join(refusal_templates(brief), "form", "left_semi").select("id", F.lit("refusal").alias("defect"))
    order = F.expr("array_position(array('empty', 'copy', 'refusal', 'other_language', 'truncated'), defect)")
    every = one.filter("defect is not null").select("id", "defect").unionByName(refused)
    return every.groupBy("id").agg(F.min_by("defect", order).alias("defect"))
