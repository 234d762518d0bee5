"""Stems of English words by the Snowball algorithm (Porter2), as published by M. F. Porter and R. Boulton."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: words with stems of their own, words that stay after the first step, and suffixes.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SPECIAL |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: The longer ones first.
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouwxyY]|\A[aeiouy][^aeiouy])\Z")


def _after(word: str, at: int) -> int:
    m = _REGION.search(word, at)
    return m.end() if m else len(word)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case; words that aren't of ASCII letters and digits stay as they are."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(r"\Ay|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub(r"(?:'s'|'s|')\Z", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w
    # past and progressive forms
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if _VOWEL.search(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _SHORT.search(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derived forms
    for end in sorted((*_STEP2, "ogi", "li"), key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
                else:
                    w = w[: -len(end)] + _STEP2[end]
            break
    for end in sorted((*_STEP3, "ative"), key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ative":
                    w = w[:-5] if len(w) - 5 >= r2 else w
                else:
                    w = w[: -len(end)] + _STEP3[end]
            break
    for end in (*_STEP4, "ion"):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(words: Column) -> Column:
    """An array of words as an array of their stems; the order and repeats stay."""

    @F.arrow_udf("array<string>")
    def run(v: pa.Array) -> pa.Array:
        flat = v.flatten().dictionary_encode()
        known = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        lengths = v.value_lengths().fill_null(0).to_numpy()
        offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, known.take(flat.indices))

    return run(words)
