"""English suffix stemming: the published rules of the second Porter stemmer, word by word.

Meant for tables of distinct words; a corpus has few of them.
"""

from __future__ import annotations

import re

# Fixed values of the published rules.
_VOWELS = "aeiouy"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_PLURAL_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_REGION_STARTS = ("gener", "commun", "arsen")
_LI_BEFORE = "cdeghkmnrt"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "", "ative": "",
}
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion",
)

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _after(word: str, start: int) -> int:
    """Where the region after the first vowel and non-vowel from ``start`` begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _short(word: str, first: int) -> bool:
    return first >= len(word) and bool(_SHORT_END.search(word))


def _without_plural(word: str) -> str:
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    ending = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        return word[:-2]
    if ending in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if ending == "s" and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _without_tense(word: str, first: int) -> str:
    ending = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        return word[: -len(ending)] + "ee" if len(word) - len(ending) >= first else word
    if ending and _has_vowel(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            return word + "e"
        if word.endswith(_DOUBLES):
            return word[:-1]
        if _short(word, first):
            return word + "e"
    return word


def stem(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    start = next((len(p) for p in _REGION_STARTS if word.startswith(p)), None)
    first = start if start is not None else _after(word, 0)
    second = _after(word, first)

    word = _without_plural(word)
    if word in _PLURAL_KEPT:
        return word
    word = _without_tense(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    ending = _ending(word, _STEP_2)
    if ending and len(word) - len(ending) >= first:
        before = word[: -len(ending)]
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or before[-1:] in tuple(_LI_BEFORE)):
            word = before + _STEP_2[ending]
    ending = _ending(word, _STEP_3)
    if ending and len(word) - len(ending) >= (second if ending == "ative" else first):
        word = word[: -len(ending)] + _STEP_3[ending]
    ending = _ending(word, _STEP_4)
    if ending and len(word) - len(ending) >= second:
        before = word[: -len(ending)]
        if ending != "ion" or before.endswith(("s", "t")):
            word = before
    if word.endswith("e"):
        place = len(word) - 1
        if place >= second or (place >= first and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.replace("Y", "y")
