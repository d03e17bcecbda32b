"""Scalar functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(s: Column) -> Column:
    """Split at single spaces: trailing empty words go, leading and inner ones stay; '' is one empty word, blanks are none."""
    return F.when((F.length(s) > 0) & (F.trim(s) == ""), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(s, " +$", ""), " "))


def similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
