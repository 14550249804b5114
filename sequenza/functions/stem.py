"""Stems of English words (Porter's algorithm of 1980) and of Russian ones (the Snowball algorithm); other words stay as they are.

Words are stemmed once for each distinct one of an Arrow batch.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

_ENGLISH, _RUSSIAN = re.compile("[a-z]+"), re.compile("[а-яё]+")


def _classes(word: str) -> str:
    """v for each vowel and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How many times a consonant follows a vowel."""
    return len(re.findall("vc", re.sub("(.)\\1+", "\\1", _classes(stem))))


def _short(stem: str) -> bool:
    return len(stem) > 2 and _classes(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def english(word: str) -> str:
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif stem := next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _classes(word[: -len(e)])), None):
        word = stem
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _classes(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _classes(word[:-1]):
        word = word[:-1] + "i"
    for step in (_STEP2, _STEP3):
        for end, new in sorted(step, key=lambda x: -len(x[0])):
            if word.endswith(end):
                word = word[: -len(end)] + new if _measure(word[: -len(end)]) else word
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if word.endswith(end):
            stem = word[: -len(end)]
            word = stem if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else word
            break
    if word.endswith("e"):
        stem = word[:-1]
        word = stem if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem) else word
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _endings(after_a: str, plain: str) -> re.Pattern:
    """The longest of the endings; the first ones count after а or я alone."""
    by_length = lambda s: "|".join(sorted(s.split(), key=lambda x: -len(x)))
    return re.compile(f"(?:(?<=[ая])(?:{by_length(after_a)})|(?:{by_length(plain)}))$" if after_a else f"(?:{by_length(plain)})$")


_GERUND = _endings("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = _endings("", "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_PARTICIPLE = _endings("ем нн вш ющ щ", "ивш ывш ующ")
_VERB = _endings("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_NOUN = _endings("", "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
_VOWELS = "аеиоуыэюя"


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    first = re.search(f"[{_VOWELS}]", word)
    if not first:
        return word
    head, rest = word[: first.end()], word[first.end() :]
    region = re.search(f"[{_VOWELS}][^{_VOWELS}].*?[{_VOWELS}][^{_VOWELS}]", word)
    second = region.end() if region else len(word)

    def without(pattern: re.Pattern, text: str) -> str | None:
        found = pattern.search(text)
        return text[: found.start()] if found else None

    if (cut := without(_GERUND, rest)) is not None:
        rest = cut
    else:
        rest = re.sub("(?:ся|сь)$", "", rest)
        if (cut := without(_ADJECTIVE, rest)) is not None:
            rest = cut if (more := without(_PARTICIPLE, cut)) is None else more
        elif (cut := without(_VERB, rest)) is not None or (cut := without(_NOUN, rest)) is not None:
            rest = cut
    rest = re.sub("и$", "", rest)
    if (found := re.search("ость?$", rest)) and len(head) + found.start() >= second:
        rest = rest[: found.start()]
    if rest.endswith("нн"):
        rest = rest[:-1]
    elif found := re.search("ейше?$", rest):
        rest = re.sub("нн$", "н", rest[: found.start()])
    elif rest.endswith("ь"):
        rest = rest[:-1]
    return head + rest


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    return english(word) if _ENGLISH.fullmatch(word) else russian(word) if _RUSSIAN.fullmatch(word) else word


def stems(words: Column) -> Column:
    """An array of lower-case words as the array of their stems; null stays null."""

    @arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(lists.flatten())
        values = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null()) if lists.null_count else pa.ListArray.from_arrays(offsets, values)

    return run(words)
