"""Column functions on text: cleaning, hashing, tokens. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What page chrome leaves behind in converted documentation.
TAIL_MARKERS = ("\n[Previous", "\nPrevious\n", "\n## On this page", "\nWas this page helpful?", "\n[Edit this page", "\nEdit this page", "\nPowered by", "\nNote for AI agents:")
NOISY_TITLES = ("documentation index", "docs by langchain", "developer documentation")
CHROME_LINES = (
    r"^\[Skip to .*?\]\(#.*?\)$",
    r"^Search\.\.\.$",
    r"^Search `?CtrlK`?$",
    r"^⌘K$",
    r"^Auto$",
    r"^Light$",
    r"^Dark$",
    r"^Copy page(\s*Copy page)?\s*$",
    r"^Copy Markdown$",
    r"^On this page\s*$",
    r"^\*\*Copy Markdown\*\*$",
    r"^\*\*View as Markdown\*\*$",
    r"^Open in \*\*.*?\*\*$",
    r"^Install in .*$",
    r"^Copy Claude Code command$",
    r"^Copy Codex config$",
    r"^Documentation search MCP$",
    r"^Copy MCP URL$",
    r"^Learn more$",
    r"^Report GitHub Issue$",
    r"^\[Button: .*?\]$",
    r"^!\[.*?\]\(.*?\)$",
    r"^\[Section titled .*?\]\(#.*?\)$",
    r"^</?(Note|Tip|Warning|Info|Card|CardGroup).*>$",
    r"^(Tip|Note|Warning|Info)$",
)
CHROME = "(?i)" + "|".join(f"(?:{p})" for p in CHROME_LINES)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"^\s+", ""), r"\s+$", "")


def squash(x: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return strip(F.regexp_replace(_c(x), r"\s+", " "))


def preview(x: Column | str, length: int) -> Column:
    return F.substring(squash(x), 1, length)


def tidy(x: Column | str) -> Column:
    """Line ends evened, runs of blanks to one, at most two empty lines in a row, none at the ends."""
    even = F.regexp_replace(_c(x), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(even, r"[ \t]+", " "), r"\n{4,}", "\n\n\n"))


def without_frontmatter(x: Column | str) -> Column:
    return strip(F.regexp_replace(strip(x), r"(?s)\A---\n.*?\n---\n*", ""))


def without_source_lines(x: Column | str) -> Column:
    kept = F.filter(F.split(_c(x), "\n"), lambda line: ~strip(line).rlike(r"(?i)^Source:\s+https?://"))
    return tidy(F.array_join(kept, "\n"))


def from_first_title(x: Column | str, source_type: Column | str) -> Column:
    """From the first level-one heading on; from the second where the first is a known site name.

    Papers without a later level-one heading stay whole.
    """
    body = _c(x)
    first = F.regexp_instr(body, F.lit(r"(?m)^#\s+\S"))
    name = F.lower(strip(F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1)))
    rest = F.regexp_replace(F.substr(body, first), r"\A#[^\n]*", "")
    second = F.regexp_instr(rest, F.lit(r"(?m)^#\s+\S"))
    cut = (
        F.when(first == 0, body)
        .when(name.isin(*NOISY_TITLES), F.when(second > 0, F.substr(rest, second)).otherwise(body))
        .otherwise(F.substr(body, first))
    )
    return F.when((_c(source_type) == "paper") & ~body.contains("\n# "), body).otherwise(cut)


def without_tail(x: Column | str) -> Column:
    """Cut at the earliest tail marker that stands behind 35 % of the text."""
    body = _c(x)
    found = F.array(*[F.locate(m, body) - 1 for m in TAIL_MARKERS])
    far = F.filter(found, lambda p: p > 0.35 * F.char_length(body))
    return F.when(F.size(far) > 0, F.substr(body, F.lit(1), F.array_min(far))).otherwise(body)


def without_chrome(x: Column | str) -> Column:
    """Without lines that are only page chrome; blank lines stay."""
    lines = F.transform(F.split(_c(x), "\n"), lambda line: F.when(strip(line) == "", "").otherwise(line))
    return F.array_join(F.filter(lines, lambda line: ~strip(line).rlike(CHROME)), "\n")


def without_anchors(x: Column | str) -> Column:
    heads = F.regexp_replace(_c(x), r"(?m)^(#{1,6})\s+\[.*?\]\(#.*?\)\s*", "$1 ")
    return F.regexp_replace(heads, r"(?m)^\[.*?†(.+?)\]\s*$", "$1")


def without_leading_title(x: Column | str) -> Column:
    return strip(F.regexp_replace(_c(x), r"(?s)\A#\s+.+?\n+", ""))


def with_clean_body(df: DataFrame, text: str, source_type: str, name: str = "body") -> DataFrame:
    """Adds `name`, the text after the whole cleaning pipeline.

    Each step is a column of its own: steps look at their text several times, and nested in one expression they
    would be computed over and over.
    """
    steps = [
        lambda c: strip(F.regexp_replace(tidy(c), r"(?s)\A---\n.*?\n---\n+", "")),
        lambda c: from_first_title(c, source_type),
        without_tail,
        without_chrome,
        lambda c: tidy(without_leading_title(without_anchors(c))),
    ]
    out = df.withColumn(name, F.col(text))
    for step in steps:
        out = out.withColumn(name, step(F.col(name)))
    return out


def clean_heading(x: Column | str) -> Column:
    """White space to single blanks, links to their text, no blanks or hashes at the ends."""
    linked = F.regexp_replace(F.regexp_replace(_c(x), r"\s+", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(linked, r"^[ #]+|[ #]+$", "")


def sha256(x: Column | str) -> Column:
    return F.sha2(_c(x), 256)


def estimate(x: Column | str) -> Column:
    """The project's token estimate of a text."""
    text = _c(x)
    ideographs = F.char_length(text) - F.char_length(F.regexp_replace(text, "[一-鿿]", ""))
    words = F.size(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1)))
    others = F.char_length(F.regexp_replace(text, "[A-Za-z0-9_一-鿿]", ""))
    return F.floor(1.2 * ideographs + 1.3 * words + others / 4).cast("int")


def fold(x: Column | str) -> Column:
    """Lower case, with the one letter of the corpus for which folding differs."""
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def token_count(x: Column | str) -> Column:
    """How many search tokens a text has, without making them."""
    text = fold(x)
    words = F.regexp_extract_all(text, F.lit(r"([a-z0-9][a-z0-9_\-]{1,})"), F.lit(1))
    spans = F.transform(F.regexp_extract_all(text, F.lit("([一-鿿]+)"), F.lit(1)), F.char_length)
    return F.size(words) + F.aggregate(spans, F.lit(0), lambda n, size: n + F.greatest(F.lit(1), 2 * size - 3))


def _grams(spans: Column, n: int) -> Column:
    long = F.filter(spans, lambda s: F.char_length(s) >= n)
    return F.flatten(F.transform(long, lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))))


def search_tokens(x: Column | str, folded: bool = True) -> Column:
    """Words of at least two characters, then single ideographs, bigrams and trigrams of ideograph runs (a bag)."""
    text = fold(x) if folded else F.lower(_c(x))
    words = F.regexp_extract_all(text, F.lit(r"([a-z0-9][a-z0-9_\-]{1,})"), F.lit(1))
    spans = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), F.lit(1))
    return F.concat(words, F.filter(spans, lambda s: F.char_length(s) == 1), _grams(spans, 2), _grams(spans, 3))
