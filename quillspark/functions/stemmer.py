"""The 1980 Porter stemmer as ordered suffix tables, and a vectorised column function over term arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL_RUN = re.compile(r"v+c+")
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """v or c for each letter: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VOWEL_RUN.findall(_shape(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, endings: list[str]) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Words of up to two letters are left alone."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = _longest(w, [a for a, _ in rules])
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + dict(rules)[end]
    end = _longest(w, _STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stemmed(terms: Column) -> Column:
    """Stems of an array of terms, in place.  A batch's distinct terms are stemmed once each, and the arrays are made from these."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        coded = rows.flatten().dictionary_encode()
        stems = pa.array([None if t is None else stem(t) for t in coded.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(rows), 0)
        off = np.zeros(len(rows) + 1, np.int32)
        np.cumsum(np.asarray(sizes), out=off[1:])
        offsets = pa.array(off, mask=np.r_[np.asarray(rows.is_null()), False])
        return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))

    return run(terms)
