"""The dealt operators against brute force, exact round trips and planted truth."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import budget, consensus, encoding, markup, overlap, packing, pairs, residue, splitting
from siltstone.llm.bpe import PATTERN, BytePairs, encoder, rank_file
from siltstone.llm.language import language_of


def test_encoding_equals_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    own = encoder(rank_file())
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = "abcdefg  \n\t\r'’sé中文字符。，😀👩‍💻0123<|endoftext|>\u200b\ufeffßÆ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["", " ", "<|endoftext|>", "don't we'll I'M", "a" * 5000, "的" * 3000, " " * 3000, "\n\n\n x  y"]
    for text in texts:
        assert own.encode(text) == other.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_encoding_round_trip(text):
    own = encoder(rank_file())
    assert own.decode(own.encode(text)) == text


def test_merges_by_brute_force():
    own = encoder(rank_file())

    def slow(part: bytes) -> list[int]:
        symbols = [part[i : i + 1] for i in range(len(part))]
        while True:
            ranks = [(own.ranks[symbols[i] + symbols[i + 1]], i) for i in range(len(symbols) - 1) if symbols[i] + symbols[i + 1] in own.ranks]
            if not ranks:
                return [own.ranks[s] for s in symbols]
            _, i = min(ranks)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    rng = random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("aeinrst 中文é") for _ in range(rng.randint(1, 24)))
        assert list(own._piece(piece)) == slow(piece.encode())


def test_estimate_equals_its_formula():
    import re

    def formula(text):
        words = re.findall(r"[A-Za-z0-9_]+", text)
        ideographs = len(re.findall("[一-鿿]", text))
        return int(1.2 * ideographs + 1.3 * len(words) + (len(text) - ideographs - sum(map(len, words))) / 4)

    rng = random.Random(1)
    estimate = budget.Estimator()
    for _ in range(500):
        text = "".join(rng.choice("ab_9 -中文。é\n\u3000😀") for _ in range(rng.randint(0, 300)))
        assert estimate(text) == formula(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_fills_without_overflow(counts):
    plan, made = packing.plan_containers(counts, 64)
    used, seen = {}, dict.fromkeys(counts, 0)
    by = {}
    for length, first, each, container in sorted(plan):
        by.setdefault(length, []).append((first, each, container))
    for length, many in counts.items():
        spans = by[length]
        for rank in range(many):
            first, each, container = max(s for s in spans if s[0] <= rank)
            at = container + (rank - first) // each
            used[at] = used.get(at, 0) + length
            seen[length] += 1
    assert seen == counts and set(used) == set(range(made))
    assert all(v <= 64 for v in used.values())
    # As many containers as best-fit decreasing over the single items makes.
    rooms: list[int] = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(64 - length)
    assert made == len(rooms)


def test_plan_stays_small_whatever_the_counts():
    rng = random.Random(2)
    counts = {k: rng.randint(1, 1_000_000) for k in range(1, 2049)}
    plan, made = packing.plan_containers(counts)
    assert len(plan) < 40_000 and made >= sum(k * v for k, v in counts.items()) // 2048


def test_packing_is_whole(spark):
    texts = [(i, "word " * random.Random(i).randint(0, 6000)) for i in range(120)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    packed = packing.pack_documents(frame).toPandas()
    sizes = encoding.count_tokens(frame).toPandas().set_index("doc_id").n_tokens
    assert (packed.groupby("doc_id").length.sum() == sizes).all()
    filled = packed.dropna(subset="container").groupby("container").length.sum()
    assert filled.max() <= 2048 and set(filled.index) == set(range(len(filled)))
    divided = packed[packed.doc_id.isin(packed[packed.piece > 0].doc_id)]
    assert (sizes[divided.doc_id.unique()] > 2048).all()
    summary = packing.packing_summary(packing.pack_documents(frame)).first()
    assert summary.tokens == sizes.sum() and summary.containers <= summary.fewest + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "wort ", "。", "\n", "\n\n", "x" * 900, "y" * 3600, ". ", "句子。", " " * 5]), min_size=1, max_size=40), st.integers(1, 12))
def test_split_properties(parts, times):
    text = "".join(parts) * times
    pieces = splitting.split_text(text)
    assert "".join(p["text"][p["overlap"] :] for p in pieces) == text
    assert all(len(p["text"]) <= 3500 and p["overlap"] <= 200 for p in pieces)
    assert all(a["end"] == b["start"] for a, b in zip(pieces, pieces[1:]))
    if len(text) > 3500:
        longest = max(map(len, splitting.UNBROKEN.findall(text)), default=0)
        assert any(p["forced"] for p in pieces) == (longest > 3500)


def test_edits_alter_only_neighbours():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(6000))
    edited = text[:15_000] + " some words were put in here " + text[15_000:]
    before, after = ({p["text"] for p in splitting.split_text(t)} for t in (text, edited))
    assert len(before - after) <= 3 and len(after - before) <= 4


def _planted(rng, items, people, per):
    truth = rng.choice(4, items, p=[0.35, 0.27, 0.22, 0.16])
    good = np.full((4, 4), 0.05) + 0.8 * np.eye(4)
    shapes = {"good": good, "reverse": good[:, ::-1], "guess": np.full((4, 4), 0.25), "two": np.tile([0.05, 0.05, 0.85, 0.05], (4, 1))}
    kinds = ["good"] * (people - 4) + ["reverse", "guess", "guess", "two"]
    labels = []
    for i in range(items):
        for j in rng.choice(people, per, replace=False):
            labels.append((f"q{i}", "c", int(rng.choice(4, p=shapes[kinds[j]][truth[i]])), f"a{j}", None))
    return truth, labels, kinds


def test_consensus_recovers_planted_grades(spark):
    truth, labels, kinds = _planted(np.random.default_rng(4), 1500, 12, 5)
    qrels = spark.createDataFrame(labels, "query_id string, chunk_id string, relevance int, annotator string, updated_at string")
    audits = spark.createDataFrame([], "query_id string, chunk_id string, llm_relevance int, codex_relevance int, human_relevance int")
    judged, model = consensus.consensus(qrels, audits)
    own = np.array([r.relevance for r in sorted(judged.collect(), key=lambda r: int(r.query_id[1:]))])
    votes = np.zeros((1500, 4))
    for q, _, g, _, _ in labels:
        votes[int(q[1:]), g] += 1
    right, majority = (own == truth).mean(), (votes.argmax(1) == truth).mean()
    assert right > 0.9 and right > majority + 0.02
    report = {r.annotator: r.reliability for r in consensus.annotator_report(model, spark).collect()}
    assert min(report[f"a{j}"] for j, k in enumerate(kinds) if k == "good") > 0.7 > max(report[f"a{j}"] for j, k in enumerate(kinds) if k != "good")


def test_posteriors_by_brute_force():
    rng = np.random.default_rng(1)
    log_confusion, log_prior = rng.normal(size=(3, 4, 4)), rng.normal(size=4)
    who, grade, ends = np.array([0, 1, 2, 0]), np.array([3, 0, 1, 2]), np.array([0, 2, 3, 4])
    q = consensus._posteriors(who, grade, ends, log_confusion, log_prior)
    for i in range(3):
        p = np.array([np.exp(log_prior[c] + sum(log_confusion[who[k], c, grade[k]] for k in range(ends[i], ends[i + 1]))) for c in range(4)])
        assert np.allclose(q[i], p / p.sum())


def test_overlap_equals_all_pairs(spark):
    rng = random.Random(8)
    words = "cache index filter query recall latency shard token batch score prompt judge".split()
    rows = []
    for i in range(60):
        name = f"{rng.choice(['Ab', 'Cd', 'Ef'])}ra-{rng.choice(['Go', 'Hi'])}lo"
        base = [rng.choice(words) for _ in range(18)] + [name, str(rng.choice([5, 7]))]
        rows.append((f"t{i}", "train", " ".join(base)))
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(18)] = rng.choice(words)
        rows.append((f"d{i}", "dev", " ".join(copy)))
    frame = spark.createDataFrame([(*r, "g", None) for r in rows], "id string, split string, question string, generator string, created_at timestamp")
    got = {tuple(r) for r in overlap.split_overlaps(frame).select("train_id", "held_id").collect()}
    profile = {i: overlap.question_profile(q) for i, _, q in rows}
    want = set()
    for a, s, _ in rows:
        for b, t, _ in rows:
            if s == "train" and t == "dev":
                x, y = profile[a], profile[b]
                one, two = set(x["shingles"]), set(y["shingles"])
                if x["names"] == y["names"] and x["raw"] == y["raw"] and len(one & two) / len(one | two) >= overlap.SIMILARITY:
                    want.add((a, b))
    # Bands are chosen for 0.93 at the least similarity and nearly 1 above.
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 20


def overlaps(spark, rows, *args):
    frame = spark.createDataFrame([(*r, "g", None) for r in rows], "id string, split string, question string, generator string, created_at timestamp")
    return sorted((r.train_id, r.held_id) for r in overlap.split_overlaps(frame, *args).collect())


@pytest.mark.parametrize("similarity", [0.3, overlap.SIMILARITY, 0.7])
def test_overlap_leaves_no_nameless_pair_out(spark, similarity):
    rng = random.Random(3)
    words = "cache index filter query recall latency shard token batch score prompt judge merge probe".split()
    rows = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.randint(1, 24))]
        copy = [rng.choice(words) if rng.random() < 0.15 else w for w in base]
        # The longest words of either are never those of the other.
        rows += [(f"t{i}", "train", " ".join([*base, "comprehensively", "unquestionably"])), (f"d{i}", rng.choice(["dev", "holdout"]), " ".join([*copy, "notwithstanding", "circumstances"]))]
    told = {i: set(overlap.shingles_of(q.split()).tolist()) for i, _, q in rows}
    want = sorted((a, b) for a in told for b in told if a[0] == "t" and b[0] == "d" and len(told[a] & told[b]) / len(told[a] | told[b]) >= similarity)
    assert overlaps(spark, rows, similarity) == want and len(want) > 10


def test_overlap_meets_however_names_are_written(spark):
    asked = "How do we tune the {} cache for long pages each night?"
    held = {"apart": "Bezor - Vili", "torn": "Bezo r-Vili", "left": "Bezor-V ili", "glued": "xBezor-Vilis", "upper": "BEZOR-VILI"}
    rows = [("t", "train", asked.format("Bezor-Vili")), *((i, "dev", asked.format(n)) for i, n in held.items()), ("other", "dev", asked.format("Bezor-Vala"))]
    assert overlaps(spark, rows) == sorted(("t", i) for i in held)
    # A copy in capitals holds no name like Bezor-Vili; it must not speak for the question that does.
    both = [rows[0], ("u", "train", asked.format("Bezor-Vili").upper()), rows[1]]
    assert overlaps(spark, both) == [("t", "apart")]
    small = asked.lower()
    assert overlaps(spark, [("t", "train", small.format("bezor-vili")), ("d", "dev", small.format("bexor-vyli"))]) == [("t", "d")]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Hello {{ name }}, here is your weekly digest.", "slot"), ("Contact NaN for access.", "slot"), ("负责人：undefined，版本：3。", "slot"), ("Real text first.\n\nThis page was last updated on XX/XX/XXXX.", "slot"),
        ("In the template language, {{ name }} prints a variable and {% if %} opens a branch.", None), ("Shell scripts read ${HOME} and ${TMPDIR} before the cache starts.", None), ("```\nHello {{ name }}, here is your weekly digest.\n```", None),
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", "filler"), ("Load tests used lorem ipsum as filler, which made recall look better than it was.", None), ("Good text.\nYour text goes here.", "filler"),
        ("404 Not Found\nThe page you requested does not exist on this server.", "error"), ("Skip to content\nOur site requires JavaScript and cookies.", "error"), ("错误 500：此栏目加载失败（编号 a1b2）", "error"),
        ("When a page answers 404, the crawler marks the link as gone and retries 3 times on a 503.", None), ("Pages that require JavaScript come back nearly empty, so we render them in a headless browser first.", None),
        ("", None), ("  \n ", None), (None, None), ("The cache is not available right now in this chapter because it is explained later, in the part on storage.", None),
    ],
)
def test_residue(text, kind):
    known = {residue.carrier(s) for s in ("Contact {{ team }} for access.", "负责人：${owner}，版本：${version}。", "负责人：{{a}}，版本：3。")}
    assert residue.residue_of(text, carriers=known) == kind


def test_every_match_holds_what_its_pattern_needs():
    for pattern, may_be in ((residue.SLOT, residue.may_be_slot), (residue.FILLER, residue.may_be_filler), (residue.EVIDENCE, residue.may_be_evidence)):
        for text in ("Hello {{ a }}", "${HOME}", "##NAME##", "<your name>", "XXXX年X月", "[object Object]", "此处为占位文本", "your text goes here", "asdf asdf", "lorem ipsum dolor", "amet elit sed et magna aliqua duis aute irure ex velit esse", "404 Not Found", "Error 17", "This needs SCRIPTS to work", "页面不存在", '{"status": 504}', "the scripts are turned off"):
            assert not pattern.search(text) or may_be(text)
    assert residue.needed(residue.re.compile("a(?:bc|de)f+|gh")) == {"f", "gh"} or residue.needed(residue.re.compile("a(?:bc|de)f+|gh")) == {"bc", "de", "gh"}


def site(spark):
    nav = "Overview of all the parts and pages and services of this site for everyone who comes here to read"
    words = ["Mail {} about the keys.", "The owner is {} since spring."]
    texts = [(f"h{i % 4}", f"{nav}\nReal text number {i} about caches, long enough to be one. {words[0].format('{{ owner }}') if i < 4 else ''}") for i in range(16)]
    texts += [("h0", f"{nav}\nThis page does not exist."), ("h1", "Real text here, and more of it. " + words[0].format("undefined")), ("h2", "Real text here, and more of it. " + words[1].format("undefined"))]
    return spark.createDataFrame([(i, t, f"https://{h}.example/x", "s", None) for i, (h, t) in enumerate(texts)], "doc_id long, text string, url string, source string, lang string")


def test_what_recurs_decides(spark, monkeypatch):
    """Boilerplate makes the error page one, and counted carriers the word in the slot's place; without either both are lost."""
    frame = site(spark)
    found = {r.doc_id: r.kind for r in residue.template_residue(frame).collect()}
    assert found == {0: "slot", 1: "slot", 2: "slot", 3: "slot", 16: "error", 17: "slot"}
    with monkeypatch.context() as m:
        m.setattr(residue, "recurrent_lines", lambda *a, **k: spark.createDataFrame([], "host string, line bigint, share double"))
        assert 16 not in {r.doc_id for r in residue.template_residue(frame).collect()}
    monkeypatch.setattr(residue, "slot_carriers", lambda seen: spark.createDataFrame([], "carrier bigint"))
    assert 17 not in {r.doc_id for r in residue.template_residue(frame).collect()}


def test_recurrent_lines_are_subtracted(spark):
    banner = "Sections about caching and retrieval that every page of this documentation repeats in its long header line"
    rows = [(i, f"{banner}\nThe page could not be loaded.", "https://a.example/x", "s", None) for i in range(5)]
    rows += [(10 + i, f"{banner}\nA real text about caches number {i} with several words, long enough to be one.", "https://a.example/y", "s", None) for i in range(60)]
    rows += [(99, f"{banner}\nThe page could not be loaded.", "https://b.example/x", "s", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, url string, source string, lang string")
    assert sorted(r.doc_id for r in residue.template_residue(frame).collect()) == [0, 1, 2, 3, 4]
    assert residue.usable_documents(frame).count() == 61


@pytest.mark.parametrize(
    "text, families",
    [
        ("if a < b and c > 60 for R&D", set()), ("List<Chunk> or Map<Key, Value>", set()), ("C:\\data\\runs\\vi on $5 to $40, see [1] and [6], 2 ** 7, 5 * 3 * 48", set()), ("**kwargs and *args; the check a == b == c; cfg[0][1]; C# and F#", set()),
        ("<p>text</p>", {"html"}), ("R&amp;D &#8212; ok", {"html"}), ("<!-- note -->", {"html"}), ("# Title", {"markdown"}), ("**bold** text", {"markdown"}), ("```\n<p>code</p> \\section{x}\n```", {"markdown"}), ("[a](#sec)", {"markdown"}),
        ("Title\n=====\ntext", {"markdown"}), ("| a | b |\n|---|:---:|\n| 1 | 2 |", {"markdown"}), ("== Head ==", {"wiki"}), ("[[Category:X]]", {"wiki"}), ("{{Infobox|k=2}}", {"wiki"}), ("[https://w.example/3 label]", {"wiki"}),
        ("\\section{Head}", {"latex"}), ("so $x = \\frac{1}{2}$ holds", {"latex"}), ("as in Table~\\ref{tab:a}", {"latex"}), ("\\(\\alpha \\le 0.5\\)", {"latex"}), ("~~~\n# no heading\n~~~", {"markdown"}),
    ],
)
def test_families(text, families):
    assert markup.convert(text)[0] == families


def test_conversion_keeps_structure():
    _, text = markup.convert("<h2>Head</h2><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><td>1</td></tr></table><script>x()</script><pre>keep <b>it</b>\nall</pre>")
    assert text == "## Head\n\n- one\n- two\n\n | a | 1 |\n\n```\nkeep it\nall\n```"
    assert markup.convert("\\section{Head}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n$$ a = b $$")[1] == "## Head\n- one\n$$ a = b $$"
    assert markup.convert("== Head ==\n{|\n|-\n| a || 1\n|}\n'''b''' [[x|y]]")[1] == "## Head\n| a | 1 |\nb y"
    assert markup.convert("plain text")[1] == "plain text" and markup.convert(None) == (set(), None)


def test_subtree_hashes_are_structural():
    a, b = markup.subtrees("<div class='n'><p>same words here</p></div>"), markup.subtrees("x <div  class='n'>\n<p>same   words here</p></div>")
    assert {h for _, _, h in a} == {h for _, _, h in b}
    assert {h for _, _, h in a}.isdisjoint(h for _, _, h in markup.subtrees("<div class='m'><p>other words here</p></div>"))
    assert markup.without("k<div class='n'><p>same words here</p></div>l", {h for _, _, h in a}) == "kl"


def test_code_is_no_template(spark):
    block = "```python\nhtml = \"<div class='hit'><b>title of the hit</b></div>\"\n```"
    rows = [(f"c{i}", f"d{i}", "s", "https://h.example/a", None, f"<footer><p>All rights of the docs</p></footer>\n<p>Page number {i} says this much</p>\n{block}", 1) for i in range(8)]
    rows += [("w", "w", "s", "https://h.example/a", None, "only '{}bold'{} here".replace("{}", "''"), 1), ("v", "v", "s", "https://h.example/a", None, block, 1)]
    frame = spark.createDataFrame(rows, "chunk_id string, doc_id string, source_id string, url string, heading_path string, text string, loaded_at int")
    assert len(markup.template_subtrees(frame).collect()) == 2
    clean = {r.chunk_id: r for r in markup.clean_chunks(frame).collect()}
    assert "All rights" not in clean["c1"].text and "title of the hit" in clean["c1"].text and clean["c1"].markup == "html,markdown"
    assert clean["w"].markup == "wiki" and clean["v"].markup == "markdown" and clean["v"].text == block.replace("python", "")


def test_long_marks_and_deep_nesting():
    words = "word " * 200
    assert markup.convert(f"${'x + ' * 100}y$")[0] == {"latex"} and markup.convert(f"[[{words}end|b]]")[0] == {"wiki"} and markup.convert(f"*{words}end*")[0] == {"markdown"}
    assert markup.convert("\\textbf{" * 6 + "in" + "}" * 6)[1] == "in"


QUESTION = "We keep two copies of the index. On Aba-Bebe the cache feeds a small filter and holds 12 rows, how should I set the cutoff?"


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), ("N/A", "empty"), ("Answer:", "empty"), ("```\n```", "empty"), ("\u200b", "empty"), ("Sources:\n", "empty"), (QUESTION, "copy"), (QUESTION.upper(), "copy"), ("Question: " + QUESTION, "copy"),
        ("> " + QUESTION + "\n\nSet the cutoff to 4 and rebuild the filter in the night, then compare the recall.", None), ("Yes.", None), ("Use 12.", None), ("No, not Aba-Bebe.", None),
        ("I'm sorry, but I'm not allowed to assist with this request. Feel free to ask me anything else.", None), ("很遗憾，我没办法处理这个请求，请换个话题。", "other_language"), ("I can't confirm the figure for Aba-Bebe. With 8 workers the filter finishes in an hour.", None),
        ("The filter refuses unsigned writes and cannot be updated in place.", None), ("Le cache est reconstruit chaque nuit afin que le filtre reste à jour.", "other_language"), ("```\nfor row in rows:\n    emit(row)\n```", None),
        ("Set it to 4.\n\n```\nfor row in rows:", "truncated"), ("The cutoff depends on the size of the", "truncated"), ("Set it to four. See also:\n- cache size\n- filter order", None), ("It works well. [3]", None), ("More at https://kb.example/tri", None),
        ("Set it to four. See also:\n\n1. Cache size\n2. Filter order\n3.", "truncated"), ("It went from 3.2 to 6.", None),
    ],
)
def test_defects(answer, defect):
    assert pairs.defect_of(QUESTION, answer) == defect


def test_asked_language_is_no_defect():
    french = "Le cache est reconstruit chaque nuit afin que le filtre reste à jour."
    assert pairs.defect_of(QUESTION + " Please reply in French.", french) is None
    assert pairs.is_truncated("延迟预算设为四之后，重复率从6.") and not pairs.is_truncated("延迟预算设为四之后，重复率从6降到3。")
    assert language_of("这是一个中文句子，没有别的。") == "zh" and language_of("Der Index wird nicht gelesen.") == "de" and language_of("12 34") is None


def turns_of(spark, answers):
    asked = ["Why is the cache slow?", "Which filter comes first?", "Do I need the index?", "How many copies are kept?", "Where is the log written?", "When does the job start?"]
    rows = [(f"{n}-{i}", asked[i % 6] + " And " + "then " * (i // 6) + "what?", a, 1.0) for n, (a, many) in enumerate(answers) for i in range(many)]
    return spark.createDataFrame(rows, "id string, user_text string, answer string, created_at double")


def test_refusals_are_told_by_recurring_openings(spark):
    closing = "You are welcome to bring up some other matter."
    frame = turns_of(spark, [
        ("I'm sorry, but I'm not allowed to assist with this request. " + closing, 4), ("很遗憾，我没办法处理这个请求，请换个话题。", 3),  # reluctant, recurring
        ("Let us look at the stars tonight instead.", 6), ("Let us look at the stars tonight instead. " + closing, 4),  # revealed by what follows refusals
        ("I cannot say whether the cache is cold.", 1),  # reluctant, but in one answer only
        *((f"I can't confirm that figure. The {x} is rebuilt every night and then the filter is read again.", 1) for x in ("cache", "index", "log", "copy", "job")),  # goes on
        ("The cache cannot be updated in place.", 6), ("Yes.", 6), ("The cache is rebuilt every night so that the filter stays fresh.", 6),
    ])
    found = pairs.broken_pairs(frame).collect()
    assert {r.defect for r in found} == {"refusal"}
    assert Counter(r.id.split("-")[0] for r in found) == {"0": 4, "1": 3, "2": 6, "3": 4}


def test_without_templates_no_refusal_is_left(spark, monkeypatch):
    frame = turns_of(spark, [("I'm sorry, but I cannot help with that.", 4), ("", 2)])
    assert Counter(r.defect for r in pairs.broken_pairs(frame).collect()) == {"refusal": 4, "empty": 2}
    monkeypatch.setattr(pairs, "refusal_templates", lambda brief: spark.createDataFrame([], "form string"))
    assert Counter(r.defect for r in pairs.broken_pairs(frame).collect()) == {"empty": 2}


def test_alike_openings_share_a_cluster(spark):
    words = [f"w{i}" for i in range(15)]
    u, d, u2 = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[:-1] + ["y"])
    brief = lambda many: spark.createDataFrame([(p, o, r, r) for o, n, r in ((u, 1, False), (d, 2, True), (u2, many, False)) for p in range(n)], "prompt long, opening string, reluctant boolean, evident boolean")
    assert u not in {r.form for r in pairs.refusal_templates(brief(10)).collect()}
    assert {u, d, u2} <= {r.form for r in pairs.refusal_templates(brief(1)).collect()}


def test_bands_of_alike_sets_meet():
    sets = [sorted({pairs._hash64(f"{s}{i}") for i in range(12)}) for s in "ab"]
    near = [pairs._hash64("z"), *sets[0][1:]]
    bands = pairs.bands_of([*sets, near])
    assert (bands[0] == bands[2]).any() and not (bands[0] == bands[1]).any() and bands.shape == (3, pairs.BANDS)
