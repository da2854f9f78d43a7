"""Template residue and error pages: recurrent lines of a host are subtracted, what is left is looked at for evidence.

Lines are normalised (case, figures, outer blanks) and counted per host over all documents. Those that recur on a
host, or on several hosts, are boilerplate - menus, footers - unless they hold evidence themselves and stand on few of
the host's pages. The residual decides: a slot left unfilled, but not where a text explains or quotes it; a filler
passage; or a page of little else than errors, access checks or script notices. Sentences that carry slots are
counted too, with the slot masked: where the same sentence carries slots in other documents, a word such as
"undefined" in the slot's place is residue, and elsewhere it isn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut

try:
    from re import _constants as op
    from re import _parser as parser
except ImportError:  # Python 3.10
    import sre_constants as op
    import sre_parse as parser

#: A line on so many pages of a host is boilerplate, and one on so many pages altogether of so many hosts; with evidence
#: in it, only from this share of the host's pages on.
PAGES, EVERYWHERE, HOSTS, SHARE = 3, 9, 3, 0.2
#: A sentence carries slots if it has them, unfilled, in so many documents.
CARRIED = 3

# What a slot left unfilled looks like.
SLOT = re.compile(
    r"""\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|[$\#]\{[\w.\- ]+\}|\{\d{1,2}\}|\{[A-Za-z_]\w*(?:\.\w+)*\}
    |%\(\w+\)[sdf]|%%[A-Za-z_]+%%|%[A-Za-z]+_[A-Za-z_]+%|<<[\w .\-]+>>|\[\[[\w .\-]+\]\]|\$\$[A-Za-z_]\w*\$\$|@[A-Za-z]+(?:[._][A-Za-z]+)+@
    |\#\#[A-Za-z_]+\#\#|__[A-Z]+(?:_[A-Z]+)+__|<(?:your|insert|enter|add|replace)[_ ][\w ]+>|\[(?:insert|your|enter|add|replace|company|product|customer|author|date|todo|tbd)\b[^\]\n]*\]
    |[【「\[（][^】」\]）\n]{0,6}(?:请填写|此处填写|此处插入|待填写|请输入|填写)[^】」\]）\n]{0,12}[】」\]）]|\bTBD(?:_\w+)+\b|\bXX/XX/XXXX\b|XX(?:X{0,2})年XX?月|\[object\ Object\]""",
    re.X | re.I,
)
# What is printed in a slot's place where there was nothing to fill in.
JUNK = re.compile(r"(?<![A-Za-z0-9_])(?:(?:NaN|undefined|null|None|nil|TBD[A-Za-z0-9_]*|TODO|X{2,})(?![A-Za-z0-9_])|N/A)|\[object Object\]|\?{2,}")
EXPLAINS = re.compile(
    r"templat|placeholder|\bslots?\b|variable|format string|shell script|environment|\bprompt|\bparser|\breturns?\b|syntax|\bsample command|such as|for example|e\.g\.|rendered|expands|replaced by|stands for|模板|变量|占位符|语法|例如|比如|表示|参数",
    re.I,
)
# Filler passages.
FILLER = re.compile(
    r"""\blorem\ ipsum\ dolor\b|(?:\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|eiusmod|tempor|incididunt|labore|magna|aliqua|veniam|nostrud|ullamco|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|exercitation|minim|quis|laboris|nisi|enim|nulla)\b[\s,.]*(?:\b(?:sed|sit|et|ut|do|ea|ex|ad|in)\b[\s,.]*)*){6,}
    |\byour\ (?:text|content|title)\ goes\ here\b|\b(?:description|text|content|caption|title)\ goes\ here\b|\bthis\ is\ (?:sample|dummy|placeholder|filler)\ text\b|\breplace\ (?:it|this(?:\ text)?)\ with\ your\ own\ (?:content|text)\b
    |\btext\ block\ number\ \d+|\bdummy\ (?:paragraph|text)\ used\b|\bblah\ blah\ blah\b|\basdf\ asdf\b|\bqwer\ qwer\b|\btest\ test\ test\b|\badd\ a\ short\ summary\ of\ this\b
    |(?:此处|这里)(?:为|是)(?:占位|示例)(?:文本|文字)|测试测试测试|内容内容内容|请替换为正式内容|\bplatzhaltertext\b\.|\bbitte\ vor\ der\ freigabe\ ersetzen\b|\btexte\ de\ remplissage\b\.|\btexto\ de\ relleno\b\.""",
    re.X | re.I,
)
FILLER_TALK = re.compile(r"load tests?|used lorem|as filler|压测|填充，|\bwords? like\b|such as|called|known as", re.I)
# What an error page, an access or robot check, or a script notice says.
_FAILS = r"""could\ not\ be\ (?:loaded|found|displayed|shown)|failed\ to\ (?:render|load)|(?:was|were|has\ been)\ (?:moved|deleted|removed)|moved\ or\ deleted|moved\ permanently|is\ blocked\ for|took\ too\ long|is\ being\ restored
    |cannot\ be\ (?:shown|displayed|found)|not\ available\ (?:right\ now|in\ your|at\ the\ moment)|does\ not\ exist|not\ found\b|no\ longer\ (?:exists|available)|temporarily\ unavailable|can't\ find\ that\ page|went\ wrong|under\ maintenance"""
EVIDENCE = re.compile(
    rf"""^(?:(?:sorry|oops)[.!,]?\s*)?(?:http\ )?(?:error\ )?[\[(]?(?:4\d\d|5\d\d)[\])]?(?:[:.]|\ |$)(?!.*\b(?:results|records|items|pages|thousand)\b)|^error\ \d+\W*$|{_FAILS}
    |access\ (?:is\ )?denied|do\ not\ have\ permission|not\ authori[sz]ed|not\ a\ robot|are\ you\ (?:a\ )?human|captcha|too\ many\ requests|has\ been\ limited|unusual\ traffic|session\ has\ expired|sign\ in\ again
    |application\ error|an\ exception\ occurred|rendererror|traceback\ \(most|^\s*file\ ".*",\ line\ \d+|^fatal:|could\ not\ connect\ to|query\ aborted|^warning:\ \w+\(|no\ such\ file|nosuchpage|<error>|"status":\ ?\d+|^\{{"error"|^\{{"status"|^\{{"code"|^\{{"message"
    |gave\ up\ \(|before\ the\ first\ byte|did\ not\ answer\ in\ time|gateway\ time-?out|bad\ gateway|internal\ server\ error
    |(?:require[sd]?|need(?:s|ed)?|rel(?:y|ies)\ on|(?:cannot|does\ not|will\ not)\ (?:run|work)\ without|enable|activate|allow|block(?:s|ed)?|support|disabled|turned?\ off)\b[^.]{{0,60}}(?:javascript|\bscripts?\b|scripting)
    |(?:javascript|\bscripts?\b|scripting)\b[^.]{{0,40}}(?:required|needed|disabled|turned\ off|switched\ off|must\ be|is\ off|to\ work)|browser\ does\ not\ support\ it
    |javascript\ (?:aktivieren|einschalten)|aktivieren\ sie\ javascript|activer\ javascript|activ[ae]\ javascript|habilit[ae]\ javascript
    |seite\ nicht\ gefunden|zugriff\ verweigert|nicht\ (?:verfügbar|erreichbar)|introuvable|accès\ refusé|erreur\ \d+|no\ está\ disponible|no\ (?:se\ )?encontr|acceso\ denegado|página\ no\ encontrada|error\ \d{{3}}
    |错误\s*\d|错误码|(?:页面|栏目|文档|文章|内容|地址|网页)[^，。]{{0,10}}(?:不存在|已被删除|已删除|正在维护|无法访问|暂时无法|加载失败|响应超时|需要登录|找不到)|不存在或已|已被删除|正在维护|加载失败|响应超时|登录后才能|没有权限|服务器开小差|访问过于频繁|完成验证|人机验证
    |(?:需要|必须|依赖|启用|开启|禁用)[^。]{{0,12}}(?:脚本|javascript)|未启用脚本|禁用脚本""",
    re.X | re.I,
)
COMPANIONS = re.compile(
    r"""try\ again|contact\ the|go\ back|reload|refresh|start\ page|home\ page|search\ box|^(?:sorry|oops|whoops|hm+|loading|please\ wait)\W*$|^code\W*\w+\W*$|reference:|^request\b|^ref\b|turn\ (?:it|them)\ on|switch\ (?:it|them)\ on|allow\ it|continue\ reading|may\ take\ a
    |some\ features|not\ be\ shown|redirected|follow\ the\ link|vermutlich\ veraltet|späte?r|réessayer|accueil|intente|inténte|más\ tarde|返回首页|自动跳转|稍后再试|请联系|刷新|更换浏览器|编号|^提示|^抱歉|^trace\b|^id\b|in\ show|page\.php|^seconds|\.inc\b|^inc\)""",
    re.X | re.I,
)
TALK = re.compile(
    r"crawler|抓取|headless|无头|logged|never be indexed|收录|并发|when a page|页面返回|retries|重试|the short reply|explain|for example|such as|例如|should be\b|应当|come back nearly empty",
    re.I,
)
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`", re.S)
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")


def needed(pattern: re.Pattern) -> set[str] | None:
    """Lower-case strings of which every match of the pattern holds one; None where there are none of two characters."""

    def best(items) -> set[str] | None:
        found: list[set[str]] = []
        run = ""
        for kind, value in [*items, (None, None)]:
            if kind is op.LITERAL:
                run += chr(value).lower()
                continue
            if run:
                found.append({run})
                run = ""
            if kind is op.SUBPATTERN:
                inner = [best(value[3])]
            elif kind is op.BRANCH:
                inner = [best(b) for b in value[1]]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                inner = [best(value[2])]
            else:
                continue
            if None not in inner:
                found.append(set().union(*inner))
        return max(reversed(found), key=lambda f: min(map(len, f)), default=None)

    return best(parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE))


def alternatives(pattern: re.Pattern) -> list[re.Pattern]:
    """The alternatives at the top of a verbose pattern, each as a pattern of its own."""
    parts, depth, at, held = [], 0, 0, False
    text = pattern.pattern
    for i, c in enumerate(text):
        if i and text[i - 1] == "\\" and not (i > 1 and text[i - 2] == "\\"):
            continue
        if c == "[" and not held:
            held = True
        elif c == "]" and held:
            held = False
        elif not held:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                parts.append(text[at:i])
                at = i + 1
    return [re.compile(p, pattern.flags & ~re.UNICODE) for p in [*parts, text[at:]]]


class Finder:
    """Where a pattern of many alternatives may match: texts that hold what one of the alternatives needs.

    The strings come from the pattern itself, so no match is lost; alternatives that need none are searched for.
    """

    def __init__(self, pattern: re.Pattern, least: int = 2) -> None:
        self.automaton, self.rest = ahocorasick.Automaton(), []
        for part in alternatives(pattern):
            strings = needed(part)
            if strings is None or min(map(len, strings)) < least:
                self.rest.append(part)
            else:
                for x in strings:
                    self.automaton.add_word(x, x)
        self.automaton.make_automaton()

    def __call__(self, text: str, low: str | None = None) -> bool:
        low = text.lower() if low is None else low
        if next(self.automaton.iter(low), None) is not None:
            return True
        return any(p.search(text) for p in self.rest)


may_be_slot, may_be_filler, may_be_evidence = Finder(SLOT, 1), Finder(FILLER), Finder(EVIDENCE)


def masked(sentence: str) -> str:
    """The sentence with slots and what stands for them masked, figures too, in lower case and single blanks."""
    text = JUNK.sub("{}", SLOT.sub("{}", sentence))
    return " ".join(re.sub(r"[0-9]+", "#", re.sub(r"(?:\{\})+", "{}", text)).lower().split())


def carrier(sentence: str) -> int:
    return xxhash.xxh64_intdigest(masked(sentence)) - (1 << 63)


def slots(lines: list[str]) -> tuple[bool, list[int], list[int]]:
    """(whether a slot is left unfilled, carriers of such slots, carriers of words that may stand in one).

    Slots in quotation marks, and sentences that explain, are none. lines are those of a text without its code.
    """
    unfilled, open_, doubtful = False, [], []
    for line in lines:
        if not may_be_slot(line) and not JUNK.search(line):
            continue
        for sentence in SENTENCES.split(line):
            if not sentence:
                continue
            explains = None
            for m in SLOT.finditer(sentence):
                before = sentence[: m.start()]
                explains = bool(EXPLAINS.search(sentence)) if explains is None else explains
                if not (explains or before.count('"') % 2 or before.count("“") > before.count("”")):
                    unfilled = True
                    open_.append(carrier(sentence))
                    break
            else:
                if JUNK.search(sentence):
                    doubtful.append(carrier(sentence))
    return unfilled, open_, doubtful


def has_filler(lines: list[str]) -> bool:
    return any(may_be_filler(line) and FILLER.search(line) and not FILLER_TALK.search(line) for line in lines)


def prose(text: str) -> list[str]:
    """The lines of a text without its code, blank where there was some."""
    return (CODE.sub(lambda m: "\n" * m[0].count("\n"), text) if "`" in text or "~~~" in text else text).split("\n")


def is_evidence(part: str) -> bool:
    return bool(may_be_evidence(part) and EVIDENCE.search(part) and not TALK.search(part))


def holds_evidence(text: str) -> bool:
    """Whether any line or sentence is evidence of an error; only then can what is left of the text be an error page."""
    for line in text.split("\n"):
        if may_be_evidence(line) and any(is_evidence(p.strip()) for p in (line, *SENTENCES.split(line))):
            return True
    return False


def is_error_page(residual: str) -> bool:
    """Evidence of an error, check or notice, and no more text beside it and its companions than they have themselves."""
    said = left = 0
    evident = False
    for line in residual.split("\n"):
        if line.lstrip().startswith("©"):  # a copyright line is boilerplate, whoever is named in it
            continue
        parts = [p for p in map(str.strip, SENTENCES.split(line)) if re.search(r"\w", p)]
        found = [is_evidence(p) for p in parts]
        if not any(found) and is_evidence(line.strip()):  # the split took it apart
            found = [True] * len(parts)
        for part, told in zip(parts, found):
            evident |= told
            if told or COMPANIONS.search(part):
                said += len(part)
            else:
                left += len(part)
    return evident and left <= said


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(line)), r"[0-9]+", "#")


def hashes_of(text: Column) -> Column:
    """Hashes of the normalised lines in order; 0 for blank lines (a null would turn all hashes into floats in pandas)."""
    return F.transform(F.transform(F.split(text, r"\n"), normal_line), lambda x: F.when(x != "", F.xxhash64(x)).otherwise(F.lit(0).cast("bigint")))


def lines_of(text: Column) -> Column:
    """The distinct hashes of the lines that aren't blank; empty for a null text."""
    return F.coalesce(F.array_remove(F.array_distinct(hashes_of(text)), F.lit(0).cast("bigint")), F.array())


def host_of(url: str = "url", source: str = "source") -> Column:
    """The URL's host, else the source, so that documents without a URL still have neighbours."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.when(host != "", host), F.lower(F.trim(F.col(source))), F.lit(""))


def recurrent_lines(documents: DataFrame, lines: DataFrame | None = None, pages: int = PAGES) -> DataFrame:
    """(host, line, share): hashes of boilerplate lines, and the share of the host's pages that hold them.

    Boilerplate is on at least `pages` documents of the host, or on EVERYWHERE documents of HOSTS hosts. A document
    counts once per line, however often it holds it; the counts cover all documents. Lines are counted as hashes, so
    what is shuffled doesn't grow with their length; `lines` (line) restricts what is counted to lines that are asked
    for, not the documents they are counted in.
    """
    placed = documents.select(host_of().alias("host"), lines_of(F.col("text")).alias("lines"))
    told = placed.select("host", F.explode("lines").alias("line"))
    told = told if lines is None else told.join(lines, "line", "left_semi")
    counted = cut(told.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")))
    shared = counted.groupBy("line").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("hosts")).filter((F.col("all") >= EVERYWHERE) & (F.col("hosts") >= HOSTS)).select("line", F.lit(True).alias("shared"))
    often = counted.join(shared, "line", "left").filter((F.col("n") >= pages) | F.col("shared"))
    total = documents.select(host_of().alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    return often.join(total, "host").select("host", "line", (F.col("n") / F.col("of")).alias("share"))


CANDIDATE = "doc_id bigint, host string, text string, carriers array<bigint>, doubtful array<bigint>"


def candidates(documents: DataFrame) -> DataFrame:
    """CANDIDATE of the documents with any evidence in their text; what has none has none in its residual either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for doc, text, host in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or text.isspace():
                    continue
                lines = prose(text)
                _, open_, doubtful = slots(lines)
                if open_ or doubtful or has_filler(lines) or holds_evidence(text):
                    rows.append((doc, host, text, open_, doubtful))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], names=["doc_id", "host", "text", "carriers", "doubtful"])

    return documents.select("doc_id", "text", host_of().alias("host")).mapInArrow(run, CANDIDATE)


def slot_carriers(seen: DataFrame) -> DataFrame:
    """(carrier): sentences, slots masked, that carry unfilled slots in at least CARRIED documents."""
    per = seen.select("host", F.explode(F.array_distinct("carriers")).alias("carrier")).groupBy("host", "carrier").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("carrier").agg(F.sum("n").alias("n")).filter(F.col("n") >= CARRIED).select("carrier")


def residue_of(text: str | None, boilerplate: dict[int, float] | None = None, codes: list[int] | None = None, carriers: set[int] = frozenset(), share: float = SHARE) -> str | None:
    """slot, filler, error or None: what the text holds without its host's boilerplate.

    codes are the hashes of its lines; boilerplate has their shares; carriers the sentences known to carry slots.
    """
    if not text or text.isspace():
        return None
    lines, boilerplate = text.split("\n"), boilerplate or {}
    codes = codes if codes is not None else [0] * len(lines)
    bare = prose(text)
    kept = []
    for i, (line, code) in enumerate(zip(lines, codes)):
        often = boilerplate.get(code)
        if often is None or often < share and (EVIDENCE.search(line.strip()) or SLOT.search(line) or JUNK.search(line) or FILLER.search(line)):
            kept.append(i)
    left = [bare[i] for i in kept if i < len(bare)]
    unfilled, _, doubtful = slots(left)
    if unfilled or not carriers.isdisjoint(doubtful):
        return "slot"
    if has_filler(left):
        return "filler"
    return "error" if is_error_page("\n".join(lines[i] for i in kept)) else None


def template_residue(documents: DataFrame, pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(doc_id, kind): the records that are no usable text, with kind slot, filler or error.

    A record has one row, of the first kind that holds in that order. Null, empty and blank texts are none of
    these. Repeated rows collapse; a null doc_id keeps its row; columns other than doc_id, text, url and source
    don't matter, and url and source may be null.
    """
    seen = cut(candidates(documents).withColumn("key", F.xxhash64("doc_id", "host", "text")).dropDuplicates(["key"]))
    lines = seen.select("key", "host", F.explode(lines_of(F.col("text"))).alias("line"))
    often = recurrent_lines(documents, lines.select("line").distinct(), pages)
    own = lines.join(often, ["host", "line"]).groupBy("key").agg(F.collect_list(F.struct("line", "share")).alias("boilerplate"))
    doubtful = seen.select("key", F.explode("doubtful").alias("carrier")).join(slot_carriers(seen), "carrier", "left_semi")
    known = doubtful.groupBy("key").agg(F.collect_set("carrier").alias("known"))

    def judge(texts: pd.Series, hashes: pd.Series, boilerplate: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for text, codes, often, carriers in zip(texts, hashes, boilerplate, known):
            shares = {r["line"]: r["share"] for r in often} if often is not None else {}
            out.append(residue_of(text, shares, codes.tolist(), set(carriers) if carriers is not None else set(), share))
        return pd.Series(out, dtype=object)

    beside = seen.select("key", "doc_id", "text").join(own, "key", "left").join(known, "key", "left")
    judged = beside.select("doc_id", F.pandas_udf(judge, "string")("text", hashes_of(F.col("text")), "boilerplate", "known").alias("kind"))
    return judged.filter("kind is not null").groupBy("doc_id").agg(F.max("kind").alias("kind"))


def usable_documents(documents: DataFrame) -> DataFrame:
    """The documents without residue, and without null, empty or blank texts; all columns as they are."""
    bad = template_residue(documents).select("doc_id")
    return documents.filter(F.regexp_replace("text", r"\s+", "") != "").join(bad, "doc_id", "left_anti")
