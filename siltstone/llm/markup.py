"""Markup residue: HTML, Markdown, wiki and LaTeX become clean text that keeps its structure.

Site templates go first: every element subtree of a page is hashed bottom-up, the hashes are counted per host over
all pages, and subtrees that recur on many pages of a host are deleted. What is left is converted; headings, lists,
tables, code blocks and formulas stay as such, in one plain notation. What stands inside a code block is content.
"""

from __future__ import annotations

import html
import re
from html.entities import html5
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import latest

#: A subtree on at least so many pages of a host, and on this share of them, belongs to the site's template.
PAGES, SHARE = 5, 0.05

# HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TAGS = frozenset(
    """a abbr address article aside audio b blockquote body button canvas caption center cite code dd del details dfn div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6
    head header html i iframe ins kbd label legend li main map mark nav noscript object ol optgroup option p picture pre q s samp script section select small span strike strong style sub summary sup
    svg table tbody td template textarea tfoot th thead time title tr tt u ul var video""".split()
) | VOID
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hr html legend main nav ol p pre section table tbody tfoot thead title tr ul".split())
GENERIC = frozenset("b i s u p q a br hr em tt td th tr li ul ol dl dt dd del ins sub sup var map mark main link time font title label code data object option section select source style summary table text".split())

FENCE = re.compile(r"(?ms)^[ \t]{0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)")
CODE_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
PRE = re.compile(r"(?is)<(pre|code|samp|kbd|syntaxhighlight|source|nowiki)\b([^<>]*)>(.*?)</\1\s*>")
VERBATIM = re.compile(r"(?s)\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\\end\{\1\}")
TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z_:@][\w:.\-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*)\s*(/?)>""")
COMMENT = re.compile(r"(?s)<!--.*?-->|<!DOCTYPE\b[^>]*>|<\?xml\b[^>]*\?>", re.I)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
ENTITIES = frozenset(n[:-1] for n in html5 if n.endswith(";"))

DISPLAY = re.compile(r"(?s)\$\$(?!\$)(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(.+?)\\end\{\3\4\}")
INLINE = re.compile(r"\\\((.+?)\\\)|(?<![\w$\\])\$(?![\s$])((?:\\.|[^$\n\\])+?)(?<![\s\\])\$(?![\w$])")
COMMAND = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph|subparagraph|textbf|textit|texttt|textsc|emph|underline|cite[tp]?|ref|eqref|autoref|label|footnote|url|href|caption|title|author|usepackage|documentclass|includegraphics|begin|end|input|bibliography|mathbf|mathrm|frac|sqrt|text)\*?(?:\[[^\]\n]*\])?\{")
ITEM = re.compile(r"(?m)^[ \t]*\\item\b(?:\[[^\]\n]*\])?")
TEX_WORD = re.compile(r"\\(?:alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|sum|prod|int|cdot|times|leq?|geq?|neq|infty|partial|nabla|ldots|dots|maketitle|newline|noindent|hline|centering|par)\b(?![\\/])")

WIKI_HEADING = re.compile(r"(?m)^(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$")
WIKI_LINK = re.compile(r"\[\[(?![\s\[])([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_CALL = re.compile(r"\{\{(?:[#:A-Za-z一-鿿][^{}\n|]*)(?:\|[^{}]*)?\}\}")
WIKI_TABLE = re.compile(r"(?ms)^[ \t]*\{\|(.*?)^[ \t]*\|\}[ \t]*$")
WIKI_OPEN = re.compile(r"(?m)^[ \t]*(?:\{\|[^\n]*|\|\}|\|-+[^\n|]*)[ \t]*$")
WIKI_SWITCH = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOGALLERY|NOINDEX|INDEX|HIDDENCAT|NEWSECTIONLINK|STATICREDIRECT|DISAMBIG)__")
WIKI_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?!')([^'\n]+?)\1(?!')")
WIKI_URL = re.compile(r"(?<![\w\]\[])\[((?:https?|ftp)://[^\s\[\]]+)\s+([^\[\]\n]+)\](?!\()")
WIKI_REF = re.compile(r"(?is)<ref\b[^<>]*?(?:/>|>.*?</ref>)")

ATX = re.compile(r"(?m)^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"(?m)^(?!\s*(?:[-*+>|=]|\d+[.)]|\Z))([^\n]+)\n {0,3}(={2,}|-{3,})[ \t]*$")
STRONG = re.compile(r"(?<![\w*\\])\*\*(?![\s*])([^*\n]+?)(?<![\s*])\*\*(?![\w*])|(?<![\w_\\.])__(?![\s_])([^_\n]+?)(?<![\s_])__(?![\w_(])|(?<=[一-鿿。，；：！？）])\*\*(?![\s*])([^*\n]+?)(?<![\s*])\*\*|(?<![\w*\\])\*\*(?![\s*])([^*\n]+?)(?<![\s*])\*\*(?=[一-鿿])")
STRIKE = re.compile(r"(?<![\w~])~~(?![\s~])([^~\n]+?)(?<![\s~])~~(?![\w~])")
EMPHASIS = re.compile(r"(?<![\w*\\/])\*(?![\s*])([^*\n]+?)(?<![\s*])\*(?![\w*(])")
IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]+)>?(?:\s+\"[^\"\n]*\")?\s*\)")
LINK = re.compile(r"(?<![\w\]!])\[([^\[\]\n]+)\]\(\s*<?([^()\s<>]*)>?(?:\s+\"[^\"\n]*\")?\s*\)|(?<=[一-鿿])\[([^\[\]\n]+)\]\(\s*<?([^()\s<>]+)>?\s*\)")
LINK_REF = re.compile(r"(?m)^ {0,3}\[[^\]\n]+\]:[ \t]+\S+.*$")
QUOTE = re.compile(r"(?m)^ {0,3}>+[ \t]\S")
MD_TABLE = re.compile(r"(?m)^[ \t]*\|?[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
CODE_LOOK = re.compile(r"\*\*(?:kwargs|args)\b")

SUSPECT = r"[<&\\$`*~_\[{]|''|(?m)^\s{0,3}>|(?m)^\s{0,3}#|(?m)^\s*==|(?m)^(={2,}|-{3,})\s*$|(?m)^\s*\|"


class Shelf:
    """Passages that conversion must leave alone, put aside under a mark that occurs in no text."""

    def __init__(self) -> None:
        self.kept: list[str] = []

    def put(self, passage: str) -> str:
        self.kept.append(passage)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def back(self, text: str) -> str:
        while "\ue000" in text:  # a passage may hold marks of passages put aside before it
            text = re.sub("\ue000(\\d+)\ue001", lambda m: self.kept[int(m[1])] if int(m[1]) < len(self.kept) else "", text)
        return text


def is_tag(m: re.Match, text: str) -> bool:
    """Whether a match of TAG is markup: a known element that isn't a type parameter such as List<String>."""
    name = m[2].lower()
    if name not in TAGS:
        return False
    before = text[m.start() - 1 : m.start()]
    if m[1] or m[3].strip() or m[4] or name in VOID or not before or not (before.isascii() and (before.isalnum() or before == "_")):
        return True
    return f"</{name}" in text[m.end() :].lower()


def is_reference(m: re.Match) -> bool:
    return m[1] is None or m[1] in ENTITIES


#: Length of the least subtree that may be a template; shorter ones - a bold word, a line break - are inline marks.
LEAST = 20


class Node(NamedTuple):
    start: int
    end: int
    hash: int
    code: bool


def elements(text: str, shelf: Shelf) -> list[Node]:
    """The element subtrees of a page whose code is on the shelf, hashed bottom-up; code says that one holds code.

    A node's hash is that of its name, attributes and the hashes and texts of its children in order; an element
    that isn't closed ends with its parent. Void elements are nodes without children.
    """
    out: list[Node] = []
    stack: list[tuple[str, int, list[str]]] = []

    def add(start: int, end: int, parts: list[str]) -> None:
        value = xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)
        out.append(Node(start, end, value, "\ue000" in text[start:end]))
        if stack:
            stack[-1][2].append(str(value))

    def close(end: int) -> None:
        _, start, parts = stack.pop()
        add(start, end, parts)

    at = 0
    for m in TAG.finditer(text):
        name = m[2].lower()
        if not is_tag(m, text):
            continue
        if stack and (words := " ".join(shelf.back(text[at : m.start()]).split())):
            stack[-1][2].append(words)
        at = m.end()
        if m[1]:
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    close(m.start())
                close(m.end())
            else:
                add(m.start(), m.end(), [f"/{name}"])
        elif name in VOID or m[4]:
            add(m.start(), m.end(), [f"{name} {' '.join(sorted(m[3].split()))}"])
        else:
            if name in ("li", "tr", "td", "th", "p", "option", "dt", "dd") and stack and stack[-1][0] == name:
                close(m.start())
            stack.append((name, m.start(), [f"{name} {' '.join(sorted(m[3].split()))}"]))
    while stack:
        close(len(text))
    return out


def subtrees(text: str, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the element subtrees of at least `least` characters that hold no code, outside code."""
    shelf = Shelf()
    shelved = _shelve_code(text, shelf, set())
    return [(n.start, n.end, n.hash) for n in elements(shelved, shelf) if n.end - n.start >= least and not n.code]


def without(text: str, drop: set[int], shelf: Shelf | None = None) -> str:
    """The text, its code on the shelf, without the subtrees whose hash is in `drop`; of nested ones the outermost goes.

    What stands inside a code block is content and no part of a template.
    """
    nodes = elements(text, shelf or Shelf())
    out, at = [], 0
    for start, end in sorted((n.start, n.end) for n in nodes if n.hash in drop and n.end - n.start >= LEAST and not n.code):
        if start >= at:
            out.append(text[at:start])
            at = end
    out.append(text[at:])
    return "".join(out)


def _shelve_code(text: str, shelf: Shelf, found: set[str]) -> str:
    def fence(m: re.Match) -> str:
        found.add("markdown")
        return shelf.put("```\n" + m[2].rstrip("\n") + "\n```")

    def span(m: re.Match) -> str:
        found.add("markdown")
        return shelf.put(f"`{m[2]}`")

    def pre(m: re.Match) -> str:
        found.add("html" if m[1].lower() in TAGS else "wiki")
        inner = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", m[3])) if m[1].lower() in ("pre", "code") else html.unescape(m[3])
        return shelf.put(f"`{inner}`") if "\n" not in inner and m[1].lower() not in ("pre", "syntaxhighlight") else "\n" + shelf.put("```\n" + inner.strip("\n") + "\n```") + "\n"

    def verbatim(m: re.Match) -> str:
        found.add("latex")
        return shelf.put("```\n" + m[2].rstrip("\n") + "\n```")

    if "```" in text or "~~~" in text:
        text = FENCE.sub(fence, text)
    if "\\begin{" in text:
        text = VERBATIM.sub(verbatim, text)
    if "</" in text:
        text = PRE.sub(pre, text)
    if "`" in text:
        text = CODE_SPAN.sub(span, text)
    return text


def _is_math(body: str) -> bool:
    """Between two dollar signs: a formula rather than two amounts of money."""
    return not re.match(r"\d[\d,.]*(?:\s|$)", body) or bool(re.search(r"[\\^_{}=+]", body))


def _shelve_formulas(text: str, shelf: Shelf, found: set[str]) -> str:
    def display(m: re.Match) -> str:
        found.add("latex")
        return shelf.put("$$ " + " ".join((m[1] or m[2] or m[5]).split()) + " $$")

    def inline(m: re.Match) -> str:
        body = m[1] if m[1] is not None else m[2]
        if m[1] is None and not _is_math(body):
            return m[0]
        found.add("latex")
        return shelf.put("$" + body.strip() + "$")

    if "$" in text or "\\" in text:
        text = DISPLAY.sub(display, text)
        text = INLINE.sub(inline, text)
    return text


def _html(text: str, found: set[str]) -> str:
    def reference(m: re.Match) -> str:
        if not is_reference(m):
            return m[0]
        found.add("html")
        return html.unescape(m[0]).replace("\xa0", " ")

    if "<" in text:
        text, many = COMMENT.subn(" ", text)
        if many:
            found.add("html")
        source = text

        def tag(m: re.Match) -> str:
            if not is_tag(m, source):
                return m[0]
            name, closing = m[2].lower(), bool(m[1])
            if re.fullmatch(r"h[1-6]", name):
                return "\n\n" if closing else "\n\n" + "#" * int(name[1]) + " "
            if name == "li":
                return "" if closing else "\n- "
            if name in ("td", "th"):
                return "" if closing else " | "
            if name == "tr":
                return " |" if closing else "\n"
            if name == "br":
                return "\n"
            if name == "img":
                alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[3], re.I)
                return (alt[1] or alt[2] or "") if alt else ""
            return "\n\n" if name in BLOCKS else ""

        source = text = re.sub(r"(?is)<(script|style|noscript|svg|template)\b[^<>]*>.*?</\1\s*>", " ", text)
        text = TAG.sub(tag, text)
    if "&" in text:
        text = REFERENCE.sub(reference, text)
    return text


def _wiki(text: str, found: set[str]) -> str:
    def seen(make):
        def change(m: re.Match) -> str:
            found.add("wiki")
            return make(m)

        return change

    def table(m: re.Match) -> str:
        rows, row = [], []
        for line in m[1].split("\n")[1:]:
            line = line.strip()
            if line.startswith("|-"):
                rows.append(row)
                row = []
            elif line[:1] in "|!" and line:
                row += [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
        rows.append(row)
        return "\n".join("| " + " | ".join(r) + " |" for r in rows if r)

    def link(m: re.Match) -> str:
        if re.match(r"(?:category|file|image|分类|文件|kategorie|datei|catégorie|categoría)\s*:", m[1], re.I):
            return ""
        return m[2] if m[2] else m[1]

    if "{|" in text:
        text = WIKI_TABLE.sub(seen(table), text)
        text = WIKI_OPEN.sub(seen(lambda m: ""), text) if "{|" in text or "|}" in text else text
    if "==" in text:
        text = WIKI_HEADING.sub(seen(lambda m: "#" * len(m[1]) + " " + m[2]), text)
    if "[[" in text:
        text = WIKI_LINK.sub(seen(link), text)
    if "{{" in text:
        text = WIKI_CALL.sub(seen(lambda m: ""), text)
    if "__" in text:
        text = WIKI_SWITCH.sub(seen(lambda m: ""), text)
    if "''" in text:
        text = WIKI_QUOTES.sub(seen(lambda m: m[2]), text)
    if "[" in text:
        text = WIKI_URL.sub(seen(lambda m: m[2]), text)
    return text


def _latex(text: str, found: set[str]) -> str:
    if "\\" not in text:
        return text
    before = text
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}", lambda m: "#" * {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}[m[1]] + " " + m[2], text)
    while True:
        text, many = re.subn(r"\\(?:textbf|textit|texttt|textsc|emph|underline|text|mathrm|mathbf|caption|title|author|footnote|url)\{([^{}]*)\}", r"\1", text)
        if not many:
            break
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"[~ ]?\\(?:cite[tp]?|ref|eqref|autoref|label|includegraphics|usepackage|documentclass|bibliography|input)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    text = ITEM.sub("- ", text)
    text = re.sub(r"(?m)^[ \t]*\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?[ \t]*\n?", "", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}", "", text)
    if COMMAND.search(before) or ITEM.search(before) or TEX_WORD.search(before):
        found.add("latex")
    return text


def _markdown(text: str, found: set[str]) -> str:
    def seen(make):
        def change(m: re.Match) -> str:
            found.add("markdown")
            return make(m)

        return change

    first = lambda m: next(g for g in m.groups() if g is not None)
    if "](" in text:
        text = IMAGE.sub(seen(lambda m: m[1]), text)
        text = LINK.sub(seen(lambda m: m[1] or m[3]), text)
    if "**" in text or "__" in text:
        text = STRONG.sub(seen(first), text)
    if "~~" in text:
        text = STRIKE.sub(seen(first), text)
    if "*" in text and not CODE_LOOK.search(text):
        text = EMPHASIS.sub(seen(lambda m: m[1]), text)
    return text


def _markdown_blocks(text: str, found: set[str]) -> str:
    def seen(make):
        def change(m: re.Match) -> str:
            found.add("markdown")
            return make(m)

        return change

    if re.search(r"\n {0,3}(?:==|---)", text):
        text = SETEXT.sub(lambda m: seen(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip())(m) if re.search(r"\w", m[1]) else m[0], text)
    if "#" in text:
        text = ATX.sub(seen(lambda m: f"{m[1]} {m[2]}"), text)
    if ">" in text and QUOTE.search(text):
        found.add("markdown")
        text = re.sub(r"(?m)^ {0,3}>+[ \t]?", "", text)
    if "|" in text and MD_TABLE.search(text):
        found.add("markdown")
        text = re.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*\n?", "", text)
    if "]:" in text:
        text = LINK_REF.sub(seen(lambda m: ""), text)
    return text


def convert(text: str | None, drop: set[int] = frozenset()) -> tuple[set[str], str | None]:
    """(families of markup found, clean text). Null stays null; text without markup comes back as it is."""
    if not text:
        return set(), text
    found: set[str] = set()
    shelf = Shelf()
    out = text.replace("\ue000", "").replace("\ue001", "")
    out = _shelve_code(out, shelf, found)
    if "<" in out and elements(out, shelf):
        # Whatever the templates are, a page with elements holds HTML; what is left of them is converted below.
        found.add("html")
        out = without(out, drop, shelf) if drop else out
    out = _markdown_blocks(out, found)
    out = _shelve_formulas(out, shelf, found)
    out = _html(out, found)
    out = _wiki(out, found)
    out = _latex(out, found)
    out = _markdown(out, found)
    if not found:
        return found, text
    out = re.sub(r"[ \t]+(?=\n)", "", re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", out))
    return found, re.sub(r"\n{3,}", "\n\n", shelf.back(out)).strip()


def host_of() -> Column:
    host = F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.when(host != "", host), F.lower(F.trim(F.col("source_id"))), F.lit(""))


def template_subtrees(chunks: DataFrame, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash): element subtrees that recur on many pages of a host, counted over all pages.

    A page counts once per subtree. Pages are told apart by doc_id. Only hashes are shuffled.
    """

    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({h for _, _, h in subtrees(t)}) if t else [])

    placed = chunks.select(host_of().alias("host"), F.coalesce("doc_id", "chunk_id").alias("page"), "text")
    of = placed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    marked = placed.filter(F.col("text").rlike(r"<[A-Za-z][^<>]*>")).select("host", "page", F.explode(F.pandas_udf(hashes, "array<bigint>")("text")).alias("hash"))
    counted = marked.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= pages)
    return counted.join(of, "host").filter(F.col("n") >= share * F.col("of")).select("host", "hash")


def clean_records(chunks: DataFrame, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """Every delivered row as (chunk_id, loaded_at, families, text, heading_path, clean_text, clean_heading).

    families is the sorted list of html, latex, markdown and wiki found in text or heading_path.
    """
    numbered = chunks.select("chunk_id", "doc_id", "source_id", "url", "loaded_at", "text", "heading_path")
    templates = template_subtrees(numbered, pages, share)
    # The templates of a host that a row may hold are brought to it by host, as one list per host of hashes that each
    # stand on a good share of the host's pages: at most a few per page, whatever the number of pages.
    lists = templates.groupBy("host").agg(F.collect_set("hash").alias("drop"))
    html_row = F.coalesce(F.col("text").rlike(r"<[A-Za-z][^<>]*>"), F.lit(False))
    with_host = numbered.filter(html_row).withColumn("host", host_of()).join(lists, "host", "left")
    others = numbered.filter(~html_row).withColumn("drop", F.lit(None).cast("array<bigint>"))
    rows = with_host.drop("host").unionByName(others)

    def run(texts: pd.Series, headings: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, heading, drop in zip(texts, headings, drops):
            found, clean = convert(text, set(drop.tolist()) if drop is not None and len(drop) else frozenset())
            more, path = convert(heading)
            out.append((sorted(found | more), clean, path))
        return pd.DataFrame(out, columns=["families", "text", "heading"])

    struct = "families array<string>, text string, heading string"
    suspect, doubtful = F.when(F.col("text").rlike(SUSPECT), F.col("text")), F.when(F.col("heading_path").rlike(SUSPECT), F.col("heading_path"))
    done = rows.withColumn("c", F.pandas_udf(run, struct)(suspect, doubtful, "drop"))
    return done.select("chunk_id", "loaded_at", F.col("c.families").alias("families"), "text", "heading_path", F.coalesce("c.text", "text").alias("clean_text"), F.coalesce("c.heading", "heading_path").alias("clean_heading"))


def markup_families(chunks: DataFrame) -> DataFrame:
    """(chunk_id, markup): one row per current record and family of markup in its text or heading_path.

    The current record of a chunk_id is the latest loaded; repeated rows collapse, a null loaded_at is the
    earliest, a null chunk_id is no record, null and empty texts hold no markup.
    """
    rows = clean_records(chunks).select("chunk_id", "loaded_at", "families")
    return latest(rows, ["chunk_id"], ["loaded_at"], ["families"]).select("chunk_id", F.explode("families").alias("markup"))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, heading_path, text, markup) of the current records with their text cleaned; markup is the families."""
    rows = clean_records(chunks)
    best = latest(rows, ["chunk_id"], ["loaded_at"], ["clean_text", "clean_heading", "families"])
    return best.select("chunk_id", F.col("clean_heading").alias("heading_path"), F.col("clean_text").alias("text"), F.concat_ws(",", "families").alias("markup"))
