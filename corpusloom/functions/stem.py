"""The Porter2 English stemmer, written from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

from . import words

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI = "cdeghkmnrt"
#: Words with stems of their own. Fixed values of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.search(r"[aeiouy][^aeiouy]", w[start:])
        return start + m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = word.removeprefix("'")
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if re.search(r"[aeiouy]", base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif base.endswith(DOUBLES):
                        w = base[:-1]
                    elif len(base) <= r1 and _short_syllable(base):
                        w = base + "e"
                    else:
                        w = base
                break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    for end, to in STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and not w.endswith("logi")) and not (end == "li" and w[-3:-2] not in LI):
                w = w[: -len(end)] + to
            break
    # 3
    for end, to in STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    # 4
    for end in STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and not (end == "ion" and w[-4:-3] not in "st"):
                w = w[: -len(end)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@lru_cache(1 << 16)
def index_term(token: str) -> str:
    """A token as it is indexed and searched: in lower case; stemmed, each part between hyphens, unless it is an identifier or technical."""
    lower = token.lower()
    if lower in words.TECHNICAL or identifier(token, lower):
        return lower
    return "-".join(p if p in words.UNSTEMMED else stem(p) for p in lower.split("-"))


def identifier(token: str, lower: str) -> bool:
    """As ``text.is_code_identifier`` says of columns."""
    letter = re.search("[a-z]", lower)
    return bool(
        re.search("[._]", lower) or letter and re.search("[0-9]", lower) or len(token) >= 2 and letter and token == token.upper() or re.search("[A-Z]", token[1:])
    )
