"""One consistent form for text that looks the same but differs in its characters."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and of Greek that look like a Latin letter, in alphabetical order of the foreign letter.
CYRILLIC_LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјԛԝорсухһӏк", "ABESIJKMHOPCTYXGQWaesijqwopcyxhlk"))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιικνορτυϲϳ", "ABEZHIKMNOPTYXaiikvoptucj"))
# Hyphens that stand for the plain one, and characters that Unicode lets a renderer ignore by default.
HYPHENS = "‐‑‒–—―−﹘﹣"
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U000e0000-\U000e0fff"
PLAIN = r"^[\x20-\x7e]*$"

_IGNORE = re.compile(f"[{IGNORABLE}]")
_SPACE = re.compile(r"[^\S ]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_FOREIGN = re.compile("[\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]")
_LOOKS = CYRILLIC_LOOKS | GREEK_LOOKS
_BACK = {"CYRILLIC": {v: k for k, v in reversed(CYRILLIC_LOOKS.items())}, "GREEK": {v: k for k, v in reversed(GREEK_LOOKS.items())}}


def script(ch: str) -> str | None:
    """LATIN, CYRILLIC, GREEK or None for anything else."""
    if not ch.isalpha():
        return None
    head = unicodedata.name(ch, "").split(" ", 1)[0]
    return head if head in _BACK or head == "LATIN" else None


def one_alphabet(text: str) -> str:
    """Look-alike letters become letters of the alphabet that the text is written in.

    Greek and Cyrillic text with no Latin letter stays. In a mixed text the Latin alphabet wins unless letters without a
    Latin look-alike outnumber the Latin ones; of the losing letters those without a look-alike stay as they are.
    """
    text = unicodedata.normalize("NFD", text)
    if not _FOREIGN.search(text):
        return unicodedata.normalize("NFC", text)
    kinds = [script(c) for c in text]
    seen = set(kinds) - {None}
    if len(seen) < 2:
        return unicodedata.normalize("NFC", text)
    latin = kinds.count("LATIN")
    for other in ("CYRILLIC", "GREEK"):
        own = sum(k == other and c not in _LOOKS for c, k in zip(text, kinds))
        if own > latin:
            back = _BACK[other]
            return unicodedata.normalize("NFC", "".join(back.get(c, c) if k == "LATIN" else c for c, k in zip(text, kinds)))
    return unicodedata.normalize("NFC", "".join(_LOOKS.get(c, c) if k in _BACK else c for c, k in zip(text, kinds)))


def consistent(text: str) -> str:
    """Composed compatibility form, plain spaces and hyphens, no ignorable characters, one alphabet; case stays."""
    out = _IGNORE.sub("", text)
    out = _HYPHEN.sub("-", _SPACE.sub(" ", unicodedata.normalize("NFKC", out)))
    return one_alphabet(_IGNORE.sub("", out))


def comparable(text: str) -> str:
    """The consistent form under full case folding, with runs of spaces as one and none outside."""
    return " ".join(unicodedata.normalize("NFKC", consistent(text).casefold()).split())


def _per_distinct(f):
    def run(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        done = np.array([f(v) for v in values] + [None], dtype=object)
        return pd.Series(done[codes], index=s.index)

    return run


def consistent_col(c: Column | str) -> Column:
    """The consistent form of a column, worked out once per distinct value of a batch; null stays null, empty stays empty."""
    return F.pandas_udf(_per_distinct(consistent), "string")(c)


def comparable_col(c: Column | str) -> Column:
    return F.pandas_udf(_per_distinct(comparable), "string")(c)


def forms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with consistent_form, compare_form and is_changed.

    Text of printable ASCII is consistent as it is and never reaches Python. Doubled or outer plain spaces are no change.
    Null text has null forms and is_changed false. Repeated rows stay; very long texts are handled whole.
    """
    c = F.col(text)
    plain = df.where(c.isNull() | c.rlike(PLAIN)).withColumn("consistent_form", c).withColumn("compare_form", F.lower(F.trim(F.regexp_replace(c, " +", " "))))
    odd = df.where(c.isNotNull() & ~c.rlike(PLAIN)).withColumn("consistent_form", consistent_col(c)).withColumn("compare_form", comparable_col(c))
    return plain.unionByName(odd).withColumn("is_changed", F.coalesce(F.col("consistent_form") != c, F.lit(False)))


def changed(df: DataFrame, text: str) -> DataFrame:
    """The rows whose text must change to reach the consistent form."""
    c = F.col(text)
    return df.where(c.isNotNull() & ~c.rlike(PLAIN)).withColumn("consistent_form", consistent_col(c)).where(F.col("consistent_form") != c)
