"""Snippets of the SQL that the queries are compared with; each says the same as a column function, in RE2."""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\x0b]+', ''), '[\s\x0b]+$', '')"


def squash(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[\s\x0b]+', ' ', 'g')")


def preview(x: str, length: int) -> str:
    return f"substr({squash(x)}, 1, {length})"


def tidy(x: str) -> str:
    even = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    return strip(rf"regexp_replace(regexp_replace({even}, '[ \t]+', ' ', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")


def estimate(x: str) -> str:
    return rf"""CAST(floor(1.2::DOUBLE * (length({x}) - length(regexp_replace({x}, '[\x{{4E00}}-\x{{9FFF}}]', '', 'g')))
 + 1.3::DOUBLE * len(regexp_extract_all({x}, '[A-Za-z0-9_]+')) + length(regexp_replace({x}, '[A-Za-z0-9_\x{{4E00}}-\x{{9FFF}}]', '', 'g')) / 4.0::DOUBLE) AS INTEGER)"""


def tokens(x: str, folded: bool = True) -> str:
    text = f"replace(lower({x}), 'ß', 'ss')" if folded else f"lower({x})"
    spans = rf"regexp_extract_all({text}, '[\x{{4E00}}-\x{{9FFF}}]+')"

    def grams(n: int) -> str:
        return f"flatten(list_transform(list_filter({spans}, lambda s: length(s) >= {n}), lambda s: list_transform(range(1, length(s) - {n - 2}), lambda i: substr(s, i, {n}))))"

    return rf"(regexp_extract_all({text}, '[a-z0-9][a-z0-9_\-]{{1,}}') || list_filter({spans}, lambda s: length(s) = 1) || {grams(2)} || {grams(3)})"


#: One row per chunk: the latest delivered one, ties to the greater text.
CURRENT = """current AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST, title DESC NULLS LAST, category DESC NULLS LAST, heading_path DESC NULLS LAST, source_id DESC NULLS LAST, doc_id DESC NULLS LAST, url DESC NULLS LAST, text_hash DESC NULLS LAST) = 1)"""
#: One row per question.
QUESTIONS = """questions AS (SELECT * FROM natural_queries WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, question DESC NULLS LAST) = 1)"""
#: Every question whose number is divisible by 50.
ASKED = QUESTIONS + r""",
asked AS (SELECT id AS query_id, question FROM questions WHERE CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT) % 50 = 0)"""
#: One usable grade per pair: the highest of the usable ones, whoever gave it.
GRADES = """grades AS (SELECT query_id, chunk_id, max(relevance) AS grade FROM qrels WHERE relevance BETWEEN 0 AND 3 GROUP BY 1, 2)"""
#: One row per turn.
TURNS = """spoken AS (SELECT * FROM turns WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, user_text DESC NULLS LAST, answer DESC NULLS LAST) = 1)"""
