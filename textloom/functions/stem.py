"""A suffix-stripping English stemmer, applied to distinct terms in Arrow batches.

A y that begins a word, or the first one after a vowel, is a consonant and written as 3 while a word is worked on; so
every 3 of a word comes out as a y.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: words with a stem of their own, and words that keep their ending
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "proceed", "exceed", "succeed", "earring")
# fixed values: beginnings after which the first region starts
BEGINNINGS = ("gener", "commun", "arsen")
# fixed values: suffixes by step, and what takes their place
STEP2 = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less",
    "iviti": "ive", "ousli": "ous", "ation": "ate", "entli": "ent", "alism": "al", "aliti": "al", "fulli": "ful",
    "alli": "al", "ator": "ate", "izer": "ize", "enci": "ence", "anci": "ance", "abli": "able",
    "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
VOWELS = "aeiouy"


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel; the word's length if it were empty."""
    for i in range(start + 1, len(word) - 1):
        if word[i - 1] in VOWELS and word[i] not in VOWELS:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int]:
    """Where the first and the second region of a word begin."""
    first = _after(word, 0)
    if first < len(word):
        first = next((len(x) for x in BEGINNINGS if word.startswith(x)), first)
    return first, _after(word, first)


def _voiced(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if word[:1] in VOWELS and word and (len(word) == 1 or len(word) == 2 and word[1] not in VOWELS):
        return True
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wx3"


def _longest(word: str, suffixes) -> str:
    return max((x for x in suffixes if word.endswith(x)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses") and len(w) > 4:
        return w[:-2]
    if w.endswith(("ied", "ies")) and len(w) > 3:
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not (w.endswith(("us", "ss")) and len(w) > 2) and _voiced(w[:-2]):
        return w[:-1]
    return w


def _past(w: str) -> str:
    held = _longest(w, ("eed", "eedly"))
    if held:
        return w[: len(w) - len(held)] + "ee" if len(w) - len(held) >= regions(w)[0] else w
    cut = _longest(w, ("ed", "edly", "ing", "ingly"))
    left = w[: len(w) - len(cut)]
    if not cut or not _voiced(left):
        return w
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if left.endswith(DOUBLES):
        return left[:-1]
    return left + "e" if _short(left) and regions(left)[0] == len(left) else left


def _derived(w: str) -> str:
    x = _longest(w, STEP2)
    left = w[: len(w) - len(x)]
    if not x or len(left) < regions(w)[0] or x == "ogi" and not left.endswith("l") or x == "li" and left[-1:] not in [*BEFORE_LI]:
        return w
    return left + STEP2[x]


def _formed(w: str) -> str:
    x = _longest(w, STEP3)
    left, (first, second) = w[: len(w) - len(x)], regions(w)
    if not x or len(left) < first or x == "ative" and len(left) < second:
        return w
    return left + STEP3[x]


def _ended(w: str) -> str:
    x = _longest(w, STEP4)
    left = w[: len(w) - len(x)]
    return w if not x or len(left) < regions(w)[1] or x == "ion" and not left.endswith(("s", "t")) else left


def _last(w: str) -> str:
    first, second = regions(w)
    if w.endswith("e"):
        return w[:-1] if len(w) > second or len(w) > first and not _short(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and len(w) > second else w


def stem(word: str) -> str:
    """Lower-cased; words of fewer than three letters are their own stem."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if w[0] == "y":
        w = "3" + w[1:]
    at = next((i for i in range(1, len(w)) if w[i] == "y" and w[i - 1] in "aeiou"), 0)
    if at:
        w = f"{w[:at]}3{w[at + 1 :]}"
    for end in (("'s", "\u2019s"), ("s'", "s\u2019"), ("'", "\u2019")):
        w = next((w[: len(w) - len(x)] for x in end if w.endswith(x)), w)
    w = _plural(w)
    if w not in KEPT:
        w = _past(w)
        if len(w) > 2 and w[-1] in "y3" and w[-2] not in VOWELS:
            w = w[:-1] + "i"
        for step in (_derived, _formed, _ended, _last):
            w = step(w)
    return w.replace("3", "y")


def stems(terms: DataFrame) -> DataFrame:
    """terms (term, ...) with a column stem; that of null is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.append_column("stem", pa.array([None if t is None else stem(t) for t in x.column("term").to_pylist()], pa.string()))

    return terms.mapInArrow(run, StructType([*terms.schema.fields, StructField("stem", StringType())]))
