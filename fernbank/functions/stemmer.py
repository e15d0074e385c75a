"""A simplified Porter stemmer. Among suffixes that overlap, the longest applies."""

from __future__ import annotations

import re

# Suffixes and their replacements in each step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_GROUP = re.compile(r"[aeiou]+[^aeiou]")
_VOWEL = re.compile(r"[aeiou]")
_SHORT_END = re.compile(r"[^\W\d_aeiou][aeiou][^\W\d_aeiouwxy]\Z")
_DOUBLE = re.compile(r"([^\W\d_aeioulsz])\1\Z")


def measure(word: str) -> int:
    """How often a run of vowels is followed by something else."""
    return len(_GROUP.findall(word))


def _longest(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix) and measure(stem := word.removesuffix(suffix)) > 0:
            return stem + table[suffix]
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if re.search(r"[^s]s\Z", word) and len(word.encode()) > 3 else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word.removesuffix(suffix)
            if not _VOWEL.search(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _DOUBLE.search(stem):
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and _SHORT_END.search(stem) else stem
    return word


def _ending(word: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix) and measure(stem := word.removesuffix(suffix)) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            return stem
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _SHORT_END.search(word[:-1])):
            return word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stem(word: str) -> str:
    """The stem of a word; words of fewer than three bytes are kept."""
    word = word.lower()
    if len(word.encode()) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    return _final(_ending(_longest(_longest(word, STEP_2), STEP_3)))
