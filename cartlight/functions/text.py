"""Column expressions over text."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: named entities of everyday markup, "&amp;" last
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
]


def unescape_html(text: Column) -> Column:
    """Common entities only; see ``unescape_html_full`` for the whole table."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def unescape_html_full(text: Column) -> Column:
    """The full entity table, one Arrow batch at a time."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return F.when(text.contains("&"), convert(text)).otherwise(text)


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, 0 for blank text."""
    trimmed = normalize_space(text)
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def occurrences(text: Column, needle: str) -> Column:
    """How often a fixed string occurs."""
    gone = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(gone)) / len(needle)).cast("int")
