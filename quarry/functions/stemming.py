"""Analysis of English text for search: words, stop words and the suffix-stripping stemmer of Porter (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

WORD = re.compile(r"[^\W_]+")
#: Words that are not indexed (their places count).
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Suffixes and what takes their place where the measure of the rest is positive.
STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(stem: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return len(re.findall("v+c+", shape(stem)))


def short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with letters beyond a-z, and of one or two letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (end := longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and short_end(word):
            word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        end = longest(word, table)
        if end and measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = longest(word, STEP4)
    if end and measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def analyze(text: str | None) -> tuple[dict[str, list[int]], int]:
    """The places (from 1) of each stem in a text, and the number of words."""
    places: dict[str, list[int]] = {}
    at = 0
    for at, m in enumerate(WORD.finditer((text or "").lower()), 1):
        if m[0] not in STOP:
            places.setdefault(stem(m[0]), []).append(at)
    return places, at
