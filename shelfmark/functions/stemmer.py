"""English suffix stripping (the published Porter2 rules) for one lower-case word."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"

# Whole-word exceptions and words left alone after the first step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
# Suffix tables of steps 2, 3 and 4, longest match wins.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
)
_BY_LENGTH = {
    name: sorted(table, key=len, reverse=True)
    for name, table in (("2", STEP2), ("3", STEP3), ("4", STEP4))
}
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Start of R1 and R2: after the first non-vowel that follows a vowel, once and twice."""
    prefix = re.match(r"gener|commun|arsen", word)
    if prefix:
        r1 = prefix.end()
    else:
        hit = _REGION.search(word)
        r1 = hit.end() if hit else len(word)
    hit = _REGION.search(word, r1)
    return r1, (hit.end() if hit else len(word))


def _ends_short(word: str) -> bool:
    return bool(
        re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word)
    )


def _suffix(word: str, table: str) -> str | None:
    return next((s for s in _BY_LENGTH[table] if word.endswith(s)), None)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that acts as a consonant is written Y until the end.
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)

    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")):
        if re.search(r"[aeiouy]", word[:-2]):
            word = word[:-1]
    if word in FINAL_AFTER_PLURAL:
        return word

    hit = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", word)
    if hit:
        base = word[: hit.start()]
        if hit.group().startswith("eed"):
            if hit.start() >= r1:
                word = base + "ee"
        elif re.search(r"[aeiouy]", base):
            word = base
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _ends_short(word):
                word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _suffix(word, "2")
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        allowed = {"ogi": before.endswith("l"), "li": before[-1:] in tuple(LI_ENDINGS)}
        if allowed.get(end, True):
            word = before + STEP2[end]

    end = _suffix(word, "3")
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]

    end = _suffix(word, "4")
    if end and len(word) - len(end) >= r2:
        before = word[: -len(end)]
        if end != "ion" or before.endswith(("s", "t")):
            word = before

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
