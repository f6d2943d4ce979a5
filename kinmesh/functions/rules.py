"""Rule lists for names and addresses, and the engines that run them. The word tables are in ``tables``."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.functions.tables import ABBREVIATIONS, AND_WORDS, LATE_FORMS, LEGAL_FORMS, UK_US

Rule = tuple[str, str]  # pattern, replacement
Words = tuple[tuple[str, tuple[str, ...]], ...]  # (replacement, the texts that it replaces), in order

CONVERT_HTML: list[Rule] = [(r"<\s*BR\s*>", " ")]
CONVERT_SGML: list[Rule] = [("&AMP;|&OACUTE;|&SECT;|&UACUTE;|&#8902;|&BULL;|&EXCL;", "")]
CLEAN_SYMBOLS: list[Rule] = [(r"(?U)[^\s\w\-.,;&]", "")]
CONCATENATORS: list[Rule] = [(r"(?<=[a-zA-Z\d])[-.,;](?=[a-zA-Z\d])", " "), (r"(?<=[a-zA-Z\d])[-.,;](?=\s)|^[-.,;]|[-.,;]$", "")]
SINGLE_SPACE: list[Rule] = [(r"\s+", " ")]
LEADING_ASTERISKS: list[Rule] = [(r"^[*]{0,2}", "")]
AMPERSAND: list[Rule] = [(r"(?<=\s)(?:" + "|".join(AND_WORDS) + r")(?=\s)", "&")]



def spelling_words(back: bool = False) -> Words:
    """American spellings by British ones in the table's order; ``back``: British by American."""
    if back:
        return tuple((us, (uk,)) for uk, us in UK_US.items())
    # the published pattern for FIBERGLASS asks for an E behind it
    return tuple((uk + "E", (us + "E",)) if us == "FIBERGLASS" else (uk, (us,)) for uk, us in UK_US.items())


def abbreviation_words(table: dict[str, list[str]] | None = None) -> Words:
    """The short forms in the table's order, the longest text of each first; another table may be given."""
    return tuple((short, tuple(sorted(texts, key=len, reverse=True))) for short, texts in (ABBREVIATIONS if table is None else table).items())


#: The steps of the name chain, of the coauthor chain, and another published order of the former.
NAME_STEPS = (AMPERSAND, CONVERT_SGML, SINGLE_SPACE, spelling_words(), abbreviation_words(), CLEAN_SYMBOLS, CONCATENATORS)
COAUTHOR_STEPS = (AMPERSAND, CONCATENATORS, CONVERT_SGML, SINGLE_SPACE, spelling_words(), abbreviation_words(), LEADING_ASTERISKS)
TEST_STEPS = (CONVERT_HTML, CONVERT_SGML, CLEAN_SYMBOLS, CONCATENATORS, SINGLE_SPACE, AMPERSAND, spelling_words(), abbreviation_words())


def apply_rules(c: Column, rules: list[Rule]) -> Column:
    """The column after every rule in order, inside the JVM; for short chains."""
    return reduce(lambda col, r: F.regexp_replace(col, r[0], r[1].replace("\\", "\\\\").replace("$", "\\$")), rules, c)


@lru_cache(maxsize=16)
def _table(words: Words):
    """An automaton that finds every text of a table in one pass, with the numbers of the rules that it belongs to, and the rules."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for i, (_, texts) in enumerate(words):
        for t in texts:
            of.setdefault(t, []).append(i)
    auto = ahocorasick.Automaton()
    for t, ids in of.items():
        auto.add_word(t, tuple(ids))
    auto.make_automaton()
    return auto, [(re.compile("|".join(map(re.escape, texts))), short) for short, texts in words]


def replace_words(value: str, words: Words) -> str:
    """The text after every rule of a table in order; substrings are replaced, with no word boundaries.

    Only rules whose texts stand in the value run; after each the value is searched again, since a rule may make the text of a later one.
    """
    auto, ready = _table(words)
    at = 0
    while due := [i for _, ids in auto.iter(value) for i in ids if i >= at]:
        at = min(due)
        pattern, short = ready[at]
        value = pattern.sub(lambda _, s=short: s, value)
        at += 1
    return value


def apply_words(c: Column, *tables: Words) -> Column:
    """The column after one or more word tables, once per distinct value of a batch.

    Hundreds of nested expressions would be compiled anew for each chain, so the tables run as one vectorised function.
    """

    def run(s: pd.Series) -> pd.Series:
        done = {v: reduce(replace_words, tables, v) for v in s.dropna().unique()}
        return s.map(done, na_action="ignore").astype(object).where(s.notna(), None)

    return F.pandas_udf(run, T.StringType())(c)


def apply_steps(c: Column, steps: tuple) -> Column:
    """A chain of rule lists (inside the JVM) and word tables; neighbouring tables share one function."""
    run: list[Words] = []
    for step in (*steps, None):
        if isinstance(step, tuple):
            run.append(step)
            continue
        if run:
            c, run = apply_words(c, *run), []
        if step is not None:
            c = apply_rules(c, step)
    return c


def legal_pattern(legacy: bool = False) -> str:
    forms = [f for f in LEGAL_FORMS if not (legacy and f in LATE_FORMS)]
    return "|".join(rf"\b{f}\b" for f in forms)
