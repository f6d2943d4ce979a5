"""Cleaning functions on columns; null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce
from html.entities import codepoint2name

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.functions import rules, tables

PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
SEP = "**"


def stdize_case(c: Column) -> Column:
    return F.upper(c)


@F.pandas_udf(T.StringType())
def remove_diacritics(s: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks; letters such as ß, Ø and ł stay. Worked out once per distinct value of a batch."""
    done = {v: "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)) for v in s.dropna().unique()}
    return s.map(done, na_action="ignore").astype(object).where(s.notna(), None)


def _ascii_table() -> dict[str, str]:
    """Windows-1252 characters in ASCII: the fixed values, and accented letters by decomposition."""
    letters = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in range(0xC0, 0x100) if chr(i) not in tables.ASCII}
    return tables.ASCII | letters


ASCII = _ascii_table()
_WINDOWS = {bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}
HTML = {c: a if c in tables.NO_HTML_NAME else f"&{tables.HTML_NAMES.get(c, codepoint2name.get(ord(c), ''))};" for c, a in ASCII.items()}


def _spelled(c: Column, table: dict[str, str]) -> Column:
    """Characters by a table: those with one character by one translation, the others by replacement. Results hold no character of the table."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    return reduce(lambda o, kv: F.replace(o, F.lit(kv[0]), F.lit(kv[1])), [kv for kv in table.items() if len(kv[1]) != 1], out)


def ascii_fold(c: Column, windows_only: bool = False) -> Column:
    """Windows-1252 text in ASCII; ``windows_only``: only the characters that Latin-1 lacks."""
    return _spelled(c, {k: v for k, v in ASCII.items() if not windows_only or k in _WINDOWS})


@F.pandas_udf(T.StringType())
def html_fold(s: pd.Series) -> pd.Series:
    """Windows-1252 text in ASCII with HTML names, once per distinct value of a batch."""
    table = str.maketrans(HTML)
    done = {v: v.translate(table) for v in s.dropna().unique()}
    return s.map(done, na_action="ignore").astype(object).where(s.notna(), None)


def plain_quotes(c: Column) -> Column:
    """The characters that Windows-1252 has and Latin-1 lacks, in ASCII."""
    return ascii_fold(c, windows_only=True)


def decode_latin1(c: Column) -> Column:
    """Bytes (or a text's bytes) read as Latin-1."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def encode_utf8(c: Column) -> Column:
    """A text's bytes in UTF-8."""
    return F.encode(c, "UTF-8")


def convert_html(c: Column) -> Column:
    return rules.apply_rules(c, rules.CONVERT_HTML)


def convert_sgml(c: Column) -> Column:
    return rules.apply_rules(c, rules.CONVERT_SGML)


def single_space(c: Column) -> Column:
    return rules.apply_rules(c, rules.SINGLE_SPACE)


def ampersand(c: Column) -> Column:
    return rules.apply_rules(c, rules.AMPERSAND)


def us_uk(c: Column) -> Column:
    return rules.apply_words(c, rules.spelling_words())


def uk_us(c: Column) -> Column:
    return rules.apply_words(c, rules.spelling_words(back=True))


def abbreviate(c: Column, table: dict[str, list[str]] | None = None) -> Column:
    return rules.apply_words(c, rules.abbreviation_words(table))


def clean_symbols(c: Column) -> Column:
    return rules.apply_rules(c, rules.CLEAN_SYMBOLS)


def concatenators(c: Column) -> Column:
    return rules.apply_rules(c, rules.CONCATENATORS)


def leading_asterisks(c: Column) -> Column:
    return rules.apply_rules(c, rules.LEADING_ASTERISKS)


def name_chain(c: Column) -> Column:
    """The rule chain for names and addresses, on text in upper case."""
    return rules.apply_steps(c, rules.NAME_STEPS)


def coauthor_chain(c: Column) -> Column:
    """The rule chain for lists of coauthors: separators first, symbols stay, leading asterisks go."""
    return rules.apply_steps(c, rules.COAUTHOR_STEPS)


def test_chain(c: Column) -> Column:
    """The steps of the name chain in the other published order, which begins with HTML."""
    return rules.apply_steps(c, rules.TEST_STEPS)


def legal_ids(c: Column, legacy: bool = False) -> Column:
    """The legal forms in a name, joined by ``**``, in the order they stand; empty if none."""
    return F.array_join(F.regexp_extract_all(c, F.lit(rules.legal_pattern(legacy)), F.lit(0)), SEP)


def without_legal_ids(c: Column, legacy: bool = False) -> Column:
    return F.regexp_replace(c, rules.legal_pattern(legacy), "")


def clean_full_name(c: Column) -> Column:
    """Diacritics, case, rule chain; legal forms are split off afterwards by ``legal_ids`` and ``without_legal_ids``."""
    return name_chain(stdize_case(remove_diacritics(c)))


def ipc_clean(c: Column) -> Column:
    return F.regexp_replace(c, r"\s|/", "")


def preprocess(c: Column) -> Column:
    """ASCII, single spaces, line breaks as spaces, outer spaces and quotes off, lower case."""
    flat = F.regexp_replace(ascii_fold(c), r"\s+", " ")
    return F.lower(F.trim(F.regexp_replace(F.trim(flat), r"""^["']+|["']+$""", "")))


def ascii_series(c: Column) -> Column:
    """Transliterated, commas and full stops as spaces, single spaces, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(ascii_fold(c), r"[,.]", " "), r"\s+", " "))


def strip_matches(c: Column, pattern: str = r"[,.]") -> Column:
    return F.trim(F.regexp_replace(c, pattern, ""))


def punctuation_to_space(c: Column) -> Column:
    """Punctuation as spaces, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, PUNCTUATION, " "), r"\s+", " ")))


def translate_punctuation(c: Column) -> Column:
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return F.translate(c, marks, " " * len(marks))


def sort_name(c: Column, least: int = 2, pattern: str = r"[,.]") -> Column:
    """Tokens of at least ``least`` letters, sorted and joined, without commas and full stops."""
    return strip_matches(F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: F.length(t) >= least)), " "), pattern)


def format_name(c: Column, least: int = 2) -> Column:
    """As ``sort_name``, from all tokens if none is long enough."""
    long = F.filter(F.split(c, " "), lambda t: F.length(t) >= least)
    return F.array_join(F.array_sort(F.when(F.size(long) > 0, long).otherwise(F.split(c, " "))), " ")


def sort_class(c: Column, n: int = 4) -> Column:
    """Class codes cut to ``n`` characters, lower case, distinct and sorted, joined by ``**``."""
    codes = F.transform(F.split(c, r"\*\*"), lambda v: F.lower(F.substring(v, 1, n)))
    return F.array_join(F.array_sort(F.array_distinct(codes)), SEP)


def delimiter_to_space(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(SEP), F.lit(" ")), F.lit(""))


def strip_titles(c: Column, titles: tuple[str, ...] = ("ing", "phd")) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\b(?:" + "|".join(titles) + r")\b", ""), " +", " "))


def strip_co(c: Column) -> Column:
    return F.substring_index(F.lower(c), "c/o", 1)


def split_multi_names(c: Column, sep: str = ",") -> Column:
    """The pieces between separators, unless one of them is a single word: then the whole text. A null text gives null."""
    parts = F.split(c, sep)
    single = F.exists(parts, lambda p: F.size(F.filter(F.split(p, " "), lambda t: t != "")) == 1)
    return F.when((F.size(parts) > 1) & ~single, parts).when(c.isNotNull(), F.array(c))


NUMBER = r"(?<=[\p{L}\p{M}\p{N}_])\s+[0-9]{2,}\s+(?=[\p{L}\p{N}_])"


def parse_name(c: Column) -> Column:
    """struct(name, address): text before and after the first number of two digits or more; without one the address is null."""
    parts = F.split(c, NUMBER, 2)
    return F.struct(parts[0].alias("name"), F.get(parts, F.lit(1)).alias("address"))


def has_late_number(c: Column) -> Column:
    """Whether a number of two digits or more stands in the last half of the text."""
    half = F.ceil(F.length(c) / 2).cast("int")
    return F.coalesce(F.regexp_extract(F.right(c, half), r"[0-9]{2,}", 0) != "", F.lit(False))


def country_tail(c: Column) -> Column:
    """struct(country, rest): the two-letter code at the end of an address, null if absent, and the text without it."""
    code = F.regexp_extract(c, r"\s([a-z]{2})$", 1)
    return F.struct(F.when(code != "", code).alias("country"), F.regexp_replace(c, r"\s[a-z]{2}$", "").alias("rest"))


def split_at_comma(c: Column) -> Column:
    """struct(name, address): split at the second comma from the end; without two commas the address is null."""
    head = F.regexp_extract(c, r"(?s)^(.*?)(,[^,]*,[^,]*)\z", 1)
    tail = F.regexp_extract(c, r"(?s)^(.*?),([^,]*,[^,]*)\z", 2)
    return F.struct(F.when(tail != "", head).otherwise(c).alias("name"), F.when(tail != "", F.trim(tail)).alias("address"))


def positions(c: Column, value: str) -> Column:
    """Start offsets, from 0, of a literal in a text."""
    n = len(value)
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - n, F.lit(0)))
    return F.filter(starts, lambda i: F.substring(c, i + 1, F.lit(n)) == value)


def ngrams(c: Column, n: int, overlapping: bool = True) -> Column:
    """Sorted distinct n-grams; the last one is left out, as in the published windows. Shorter texts give an empty list."""
    step = 1 if overlapping else n
    last = F.length(c) - n - 1
    grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda i: F.substring(c, i + 1, F.lit(n)))
    return F.when(last >= 0, F.array_sort(F.array_distinct(grams))).when(c.isNotNull(), F.array().cast("array<string>"))


def reformat_file_name(c: Column) -> Column:
    """The name of a reformatted file: its trailing letters become ``reformat``."""
    return F.regexp_replace(c, r"[a-zA-Z]+$", "reformat")
