"""English stemming as an Arrow UDF over token arrays (each worker remembers some words)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published English stemming algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
    ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"),
    ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"),
    ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", ""), ("icate", "ic"),
    ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "ion", "al", "er", "ic"]
_V = "[aeiouy]"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    head = re.match(r"gener|commun|arsen", word)
    if head:
        r1 = head.end()
    else:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, (m.end() if m else len(word))


def stem_word(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word[0] == "y":
        word = "Y" + word[1:]
    word = re.sub(r"([aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_V, word[:-2]):
        word = word[:-1]
    if word in _KEEP:
        return word

    if word.endswith(("eed", "eedly")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                base = word[: -len(end)]
                if re.search(_V, base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif _DOUBLE.search(base):
                        base = base[:-1]
                    elif r1 >= len(base) and _SHORT_END.search(base):
                        base += "e"
                    word = base
                break

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    for end, new in _STEP2:
        if word.endswith(end):
            base = word[: -len(end)]
            if len(base) >= r1:
                if end == "ogi":
                    word = base + new if base.endswith("l") else word
                elif end == "li":
                    word = base if base and base[-1] in "cdeghkmnrt" else word
                else:
                    word = base + new
            break
    for end, new in _STEP3:
        if word.endswith(end):
            base = word[: -len(end)]
            if len(base) >= (r2 if end == "ative" else r1):
                word = base + new
            break
    for end in _STEP4:
        if word.endswith(end):
            base = word[: -len(end)]
            if len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break

    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


MEMO_WORDS = 100_000

_seen: dict[str, str] = {}


def _stem_cached(word: str) -> str:
    got = _seen.get(word)
    if got is None:
        if len(_seen) >= MEMO_WORDS:
            _seen.clear()
        got = _seen[word] = stem_word(word)
    return got


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_terms(terms: pa.Array) -> pa.Array:
    """Every distinct word of a batch becomes a Python string once; rows stay Arrow arrays."""
    coded = terms.flatten().dictionary_encode()
    stems = pa.array([_stem_cached(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), stems, mask=terms.is_null())
