"""Language of a short text from its script and its function words."""

from __future__ import annotations

import re

#: Frequent function words, told apart by language.
WORDS = {
    "en": "the and is are was were of to in for with that this it not from by which when what how should you your i we they on at as be or if do does can a an has have its into then than but there so my our",
    "de": "der die das und ist nicht ein eine einen einem einer eines mit von für auf den dem des im zu sich auch wird werden wie als bei nach vor wenn sind aus dass ich wir oder nur kann keine durch über jede jeder wurde",
    "fr": "le la les des est et un une du de dans pour que qui ne pas avec sur au aux ce cette sont par plus comment pourquoi nous vous je se sans chaque si ou mais être son sa il elle lorsque alors",
    "es": "el la los las de del y es un una en que con por para no se su al lo como más cada cómo qué si hasta sin sobre son pero está cuando esta este desde entre solo ya nos",
}
WEIGHTS: dict[str, dict[str, float]] = {}
for _language, _words in WORDS.items():
    for _word in _words.split():
        WEIGHTS.setdefault(_word, {})[_language] = 1.0
for _word, _of in WEIGHTS.items():
    for _language in _of:
        _of[_language] = 1.0 / len(_of)
#: Letters that one of the languages uses and the others hardly do.
LETTERS = {"de": "äöüß", "fr": "àâçèêëîïôœùû", "es": "ñ¿¡áíóú"}
LATIN = re.compile(r"[a-zà-öø-ÿœ]+")
IDEOGRAPH = re.compile(r"[一-鿿]")
KANA = re.compile(r"[぀-ヿ]")
OTHER = {"ko": re.compile(r"[가-힯]"), "ru": re.compile(r"[Ѐ-ӿ]"), "ar": re.compile(r"[؀-ۿ]"), "hi": re.compile(r"[ऀ-ॿ]")}
#: A capitalised word with a further capital or a hyphen inside is a name and says nothing about the language.
NAMES = re.compile(r"\b[A-Z][A-Za-z]*(?:-[A-Z]|[A-Z])[A-Za-z]*\b")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|https?://\S+", re.S)


def has_code(text: str) -> bool:
    """Whether CODE can match; plain searches are far cheaper."""
    return "`" in text or "~~~" in text or "://" in text


def language_scores(text: str) -> dict[str, float]:
    """Evidence per language; ideographs count for zh at half a word each."""
    bare = NAMES.sub(" ", CODE.sub(" ", text) if has_code(text) else text)
    scores: dict[str, float] = {}
    wide = not bare.isascii()
    ideographs = len(IDEOGRAPH.findall(bare)) if wide else 0
    if ideographs:
        kana = len(KANA.findall(bare))
        scores["ja" if kana * 5 > ideographs else "zh"] = (ideographs + kana) / 2
    for language, script in OTHER.items() if wide else ():
        if n := len(script.findall(bare)):
            scores[language] = n / 3
    low = bare.lower()
    for word in LATIN.findall(low):
        if word in WEIGHTS:
            for language, weight in WEIGHTS[word].items():
                scores[language] = scores.get(language, 0.0) + weight
    for language, letters in LETTERS.items() if wide else ():
        if n := sum(low.count(c) for c in letters):
            scores[language] = scores.get(language, 0.0) + n / 2
    return scores


def mostly_ideographs(text: str) -> bool:
    """Whether a third of the text is ideographs and none of it kana; then no other language can score as high as zh."""
    return not text.isascii() and 3 * len(IDEOGRAPH.findall(text)) >= len(text) and not KANA.search(text)


def language_of(text: str | None, least: float = 1.5) -> str | None:
    """zh, en, de, fr, es or another script's language; None where the text says too little."""
    if not text:
        return None
    scores = language_scores(text)
    if not scores:
        return None
    best = max(scores, key=lambda k: (scores[k], k))
    return best if scores[best] >= least else None
