"""Which texts of a source are kept."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.constants import MAX_CHARS, MIN_CHARS
from corpusmill.functions.text import alnum_fraction, bound, contains_any, keyword_hits

#: Keywords of the source filters.
SQL_FILE_WORDS = ("SELECT", "FROM", "CREATE", "INSERT")
MARKDOWN_WORDS = ("SELECT", "FROM", "WHERE", "JOIN", "TABLE", "CREATE", "INSERT", "UPDATE", "DELETE")
PYTHON_FIRST, PYTHON_THEN = "SELECT", ("FROM", "WHERE", "JOIN")
RUBY_PATHS = ("migration", "schema")


def not_empty(text: Column) -> Column:
    return F.length(text) > 0


def length_ok(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    return F.length(text).between(low, high)


def sql_file(text: Column, words=SQL_FILE_WORDS, alnum: float = 0.25) -> Column:
    # The cheap test first: generated code evaluates the second only where it holds.
    return contains_any(text, words) & (alnum_fraction(text) >= alnum)


def markdown_file(text: Column, words=MARKDOWN_WORDS, least: int = 2) -> Column:
    return keyword_hits(text, words) >= least


def python_file(text: Column, first: str = PYTHON_FIRST, then=PYTHON_THEN) -> Column:
    # One scan for both conditions.
    return bound(F.upper(text), lambda upper: F.contains(upper, F.lit(first)) & functools.reduce(Column.__or__, [F.contains(upper, F.lit(k)) for k in then], F.lit(False)))


def path_has(path: Column, parts=RUBY_PATHS) -> Column:
    lower, found = F.lower(F.coalesce(path, F.lit(""))), F.lit(False)
    for p in parts:
        found = found | F.contains(lower, F.lit(p))
    return found


def first_turns(role: Column, lang: Column | None = None, want_role: str = "prompter", want_lang: str = "en") -> Column:
    keep = role == want_role
    return keep if lang is None else keep & (lang == want_lang)
