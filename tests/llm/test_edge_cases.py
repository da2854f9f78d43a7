"""Every dealt operator with nulls in any column, empty and long texts, ties, repeats, no rows, clashing columns."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone.llm import budget, consensus, encoding, markup, overlap, packing, pairs, residue, splitting

T0 = dt.datetime(2026, 1, 1)
T1 = dt.datetime(2026, 1, 2)
CHUNKS = "chunk_id string, doc_id string, source_id string, url string, heading_path string, text string, token_estimate int, loaded_at timestamp"
QUESTIONS = "id string, split string, question string, generator string, created_at timestamp"
TURNS = "id string, user_text string, answer string, created_at double"
DOCUMENTS = "doc_id bigint, text string, url string, source string, lang string"
QRELS = "query_id string, chunk_id string, relevance int, annotator string, updated_at string"
AUDITS = "query_id string, chunk_id string, llm_relevance int, codex_relevance int, human_relevance int"
CLASH = ["bucket", "rank", "host", "key", "n", "t", "_best", "tokens", "length", "kind", "drop", "family", "opening", "band", "block", "container", "line", "share"]


def clash(df):
    """The table with columns of names that the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


OPERATORS = {
    "p1": (lambda a, b: consensus.consensus(a, b)[0].select("query_id", "chunk_id", "relevance"), (QRELS, AUDITS)),
    "p2": (splitting.split_kinds, (CHUNKS,)),
    "p3": (pairs.broken_pairs, (TURNS,)),
    "p4": (markup.markup_families, (CHUNKS,)),
    "p5": (overlap.split_overlaps, (QUESTIONS,)),
    "p7": (budget.wrong_estimates, (CHUNKS,)),
    "p8": (encoding.encode_texts, (DOCUMENTS,)),
    "p9": (packing.pack_documents, (DOCUMENTS,)),
    "p10": (residue.template_residue, (DOCUMENTS,)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    operator, schemas = OPERATORS[name]
    assert operator(*[clash(spark.createDataFrame([], s)) for s in schemas]).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_nulls(spark, name):
    operator, schemas = OPERATORS[name]
    tables = [clash(spark.createDataFrame([tuple([None] * len(s.split(", ")))] * 3, s)) for s in schemas]
    found = rows(operator(*tables))
    assert found == {"p8": [(None, [])] * 3, "p9": [(None, 0, 0, 0, None)] * 3}.get(name, [])


def test_consensus_cases(spark):
    good = [("q", "c", 2, a, "2026-01-01T00:00:00Z") for a in ("A", "b", "c")]
    dirty = [
        ("q", "c", 2, " a ", "2026-01-01T00:00:00Z"),  # the same annotator and instant
        ("q", "c", 0, "b", "2025-12-31T23:00:00-05:00"),  # later than b's other grade
        ("q", "c", 9, "x", None),
        ("q", "c", None, "y", None),
        ("q", "c", 1, None, None),
        (None, "c", 1, "a", None),
    ]
    qrels = spark.createDataFrame(good + good + dirty, QRELS)
    audits = spark.createDataFrame([("q", "c", 2, None, 2), ("q", "c", 2, None, 2)], AUDITS)
    used = rows(consensus.usable_grades(clash(qrels), clash(audits)))
    assert used == [("q", "c", "a", 2), ("q", "c", "b", 0), ("q", "c", "c", 2), ("q", "c", "spot_audit.human", 2), ("q", "c", "spot_audit.llm", 2)]
    found = consensus.consensus(qrels, audits, least=3)[0].collect()
    assert [(r.relevance, r.n_grades) for r in found] == [(2, 5)]
    assert consensus.consensus(qrels, audits, least=6)[0].count() == 0


def test_current_record_decides(spark):
    long = "word " * 1000
    table = spark.createDataFrame(
        [
            ("a", "d", "s", "u", "h", long, None, T0),
            ("a", "d", "s", "u", "h", "short now", 2, T1),
            ("b", "d", "s", "u", "h", "short", 2, T0),
            ("b", "d", "s", "u", "h", "x" * 4000, 9, T1),
            ("b", "d", "s", "u", "h", "x" * 4000, 9, T1),
            ("c", "d", "s", "u", "h", "", 0, None),
            ("e", "d", "s", "u", "h", "", 1, T0),
            (None, "d", "s", "u", "h", long, 1, T0),
        ],
        CHUNKS,
    )
    assert rows(splitting.split_kinds(clash(table))) == [("b", "forced")]
    assert [r[0] for r in rows(budget.wrong_estimates(clash(table)))] == ["b", "e"]


def test_documents_cases(spark):
    long = "The quick brown fox. " * 20_000
    table = clash(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (3, "  \n", None, None, None), (4, long, None, None, None), (5, "a b", None, None, None), (5, "a b", None, None, None)], DOCUMENTS))
    sizes = {r.doc_id: len(r.ids) for r in encoding.encode_texts(table).collect()}
    assert sizes[1] == sizes[2] == 0 and sizes[3] > 0 and sizes[4] > 80_000
    packed = packing.pack_documents(table).collect()
    assert {r.container for r in packed if r.doc_id in (1, 2)} == {None}
    assert sum(r.length for r in packed if r.doc_id == 4) == sizes[4] and sum(r.doc_id == 5 for r in packed) == 2
    assert residue.template_residue(table).count() == 0


def test_questions_cases(spark):
    same = "How does project Aba-Bebe set the cutoff to 12 for long manuals today?"
    table = [
        ("t1", "TRAIN ", same, "g", T0), ("t1", "TRAIN ", same, "g", T0), ("t2", "train", None, "g", T0), ("t3", "train", "", "g", T0),
        ("d1", "Dev", same.upper(), None, T0), ("h1", "holdout", same.replace("12", "13"), "g", T0), ("h2", " holdout", same.replace("Aba-Bebe", "Cici-Dodo"), "g", T0),
        ("d2", None, same, "g", T0), ("d3", "other", same, "g", T0), (None, "dev", same, "g", T0), ("h3", "holdout", same, "g", T0),
    ]
    frame = clash(spark.createDataFrame(table, QUESTIONS))
    found = overlap.split_overlaps(frame)
    assert rows(found.select("train_id", "held_id")) == [("t1", "d1"), ("t1", "h3")]
    counts = rows(overlap.overlap_counts(found, frame))
    assert counts == [("dev", "unknown", 1, 1), ("holdout", "g", 1, 1)]


def test_turns_cases(spark):
    asked = "How should I set the cutoff of Aba-Bebe when the cache is full and slow?"
    table = [
        ("1", asked, None, 1.0), ("2", None, "(no answer)", 1.0), ("3", asked, "> " + asked, None), ("4", asked, "Sorry, I cannot help with that.", 1.0), ("5", "Why so slow?", "Sorry, I cannot help with that.", 1.0), ("11", asked, "I will not speak of it.", 1.0), ("12", asked, "I will not speak of it.", 1.0),
        ("6", asked, "Der Index wird jede Nacht neu aufgebaut, damit der Filter aktuell bleibt.", 1.0), ("7", asked, "The cache is rebuilt every night, and then the", 1.0), ("8", asked, "Use 12.", 1.0),
        ("9", asked, None, 1.0), ("9", asked, "Set it to 12 and restart the cache afterwards.", 2.0), ("9", asked, "Set it to 12 and restart the cache afterwards.", 2.0), (None, asked, None, 1.0),
        ("10", asked, "word " * 50_000 + "end.", 1.0),
    ]
    found = dict(rows(pairs.broken_pairs(clash(spark.createDataFrame(table, TURNS)))))
    assert found == {"1": "empty", "2": "empty", "3": "copy", "4": "refusal", "5": "refusal", "6": "other_language", "7": "truncated"}


def test_markup_cases(spark):
    nav = "<nav><a href='/x'>Home of the docs</a></nav>"
    table = [(f"n{i}", f"d{i}", "s", "https://h.example/a", "h", f"{nav}<p>Page number {i} says this</p>", 1, T0) for i in range(6)]
    table += [("o", "o", None, None, None, "**bold**", 1, T0), ("o", "o", None, None, None, "plain", 1, T1), ("p", "p", "s", "u", "Head $x$", None, 1, T0), ("q", "q", "s", "u", "h", "# " + "long " * 40_000, 1, T0)]
    frame = clash(spark.createDataFrame(table + table, CHUNKS))
    assert rows(markup.markup_families(frame)) == [*((f"n{i}", "html") for i in range(6)), ("p", "latex"), ("q", "markdown")]
    clean = {r.chunk_id: r for r in markup.clean_chunks(frame).collect()}
    assert clean["n3"].text == "Page number 3 says this" and clean["o"].text == "plain" and clean["p"].text is None


def test_budget_rollup_cases(spark):
    docs = spark.createDataFrame([(1, "one two three", None, " S1 ", "EN"), (1, "one two three", None, " S1 ", "EN"), (2, None, None, None, None), (3, "中文字", None, "zz", "und")], DOCUMENTS)
    chunks = spark.createDataFrame([("a", "d", "s1", "u", "h", "one", 1, T0), ("a", "d", "s1", "u", "h", "one two", 1, T1), (None, "d", "s1", "u", "h", "x", 1, T0)], CHUNKS)
    manifest = spark.createDataFrame([("s1", "Vector DB "), ("s1", "Vector DB "), ("s2", None), (None, "x")], "source_id string, category string")
    found = {tuple(r)[:4]: tuple(r)[4:] for r in budget.budget_rollup(clash(docs), clash(chunks), clash(manifest)).collect()}
    assert found[("documents", None, None, None)] == (3, 4 + 0 + 3)
    assert found[("documents", "s1", "en", "vector db")] == (1, 4) and found[("documents", "unknown", None, None)] == (2, 3)
    assert found[("chunks", None, None, None)] == (1, 2)
