"""Text expressions. All are built-in functions but NFC, which Spark lacks."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


_nfc = _nfc.asNondeterministic()  # else a filter on the result would evaluate it twice


def nfc(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` in Unicode normal form C.

    Rows of ASCII text only, most of them, go past the Python workers: a text whose bytes are as many as its characters
    is in that form already.
    """
    ascii_only = F.col(column).isNull() | (F.length(column) == F.octet_length(column))
    return df.where(ascii_only).unionByName(df.where(~ascii_only).withColumn(column, _nfc(F.col(column))))


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def strip(x: Column) -> Column:
    """Without white space (all of Unicode's) at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def alnum_fraction(x: Column) -> Column:
    """The share of letters and digits among a text's code points; 0 for an empty text."""
    return F.when(F.length(x) == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) / F.length(x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyword_hits(x: Column, keywords) -> Column:
    """How many different keywords occur in the upper-cased text, also inside longer words and overlapping ones."""
    return bound(F.upper(x), lambda upper: sum((F.contains(upper, F.lit(k)).cast("int") for k in keywords), F.lit(0)))


def contains_any(x: Column, keywords) -> Column:
    return bound(F.upper(x), lambda upper: functools.reduce(Column.__or__, [F.contains(upper, F.lit(k)) for k in keywords], F.lit(False)))


def word_count(x: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(x, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def normalise_sql(x: Column) -> Column:
    """For exact match: stripped, without semicolons at the end, in lower case, runs of white space as one blank."""
    return F.regexp_replace(F.lower(F.regexp_replace(strip(x), ";+$", "")), r"(?U)\s+", " ")


def identifier(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\W+", "_")


def preview(x: Column, chars: int = 120) -> Column:
    return F.replace(F.replace(F.substring(x, 1, chars), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def warmup_stable_cosine(step: Column, peak: float, low: float, warmup: int, stable: int, decay: int) -> Column:
    """A learning rate: up in a line, level, then down along a half cosine to ``low``, where it stays."""
    at = F.least(step - (warmup + stable), F.lit(decay)) / decay
    down = (peak - low) * 0.5 * (1 + F.cos(F.pi() * at)) + low
    return F.when(step < warmup, peak * step / warmup).when(step < warmup + stable, F.lit(peak)).otherwise(down)


def warmup_cosine(step: Column, peak: float, low: float, warmup: int, total: int) -> Column:
    return warmup_stable_cosine(step, peak, low, warmup, 0, total - warmup)
