"""The Porter2 stemmer for English, from its published description, run once for each distinct word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the algorithm: exceptions, doubles, endings.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
VALID_LI = "cdeghkmnrt"
VOWEL = "aeiouy"
REGION = re.compile(f"[{VOWEL}][^{VOWEL}]")
SPECIAL_R1 = re.compile("^(gener|commun|arsen)")


def _regions(word: str) -> tuple[int, int]:
    if m := SPECIAL_R1.match(word):
        first = m.end()
    else:
        first = m.end() if (m := REGION.search(word)) else len(word)
    return first, (m.end() if (m := REGION.search(word, first)) else len(word))


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWEL and word[1] not in VOWEL
    return len(word) > 2 and word[-1] not in VOWEL + "wxY" and word[-2] in VOWEL and word[-3] not in VOWEL


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    word = word.lower()
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if word in INVARIANT:
        return word
    word = word.lstrip("'")
    word = "".join("Y" if c == "y" and (k == 0 or word[k - 1] in VOWEL) else c for k, c in enumerate(word))
    r1, r2 = _regions(word)
    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    ending = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and any(c in VOWEL for c in word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and any(c in VOWEL for c in word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _ends_short(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWEL:
        word = word[:-1] + "i"
    ending = _longest(word, (*STEP_2, "ogi", "li"))
    if ending and len(word) - len(ending) >= r1:
        if ending == "ogi":
            word = word[:-1] if word[-4:-3] == "l" else word
        elif ending == "li":
            word = word[:-2] if word[-3:-2] and word[-3] in VALID_LI else word
        else:
            word = word[: -len(ending)] + STEP_2[ending]
    ending = _longest(word, (*STEP_3, "ative"))
    if ending and len(word) - len(ending) >= r1:
        if ending != "ative":
            word = word[: -len(ending)] + STEP_3[ending]
        elif len(word) - 5 >= r2:
            word = word[:-5]
    ending = _longest(word, (*STEP_4, "ion"))
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(StringType())
def stem_column(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else stem(w))


def with_stems(words: DataFrame, column: str = "lexeme", into: str = "stem") -> DataFrame:
    """words with the stem of each: the UDF sees distinct words only."""
    stems = words.select(column).distinct().withColumn(into, stem_column(column))
    return words.join(stems, column, "left")
