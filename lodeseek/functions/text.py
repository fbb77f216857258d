"""The keyword tokenizer: ASCII lower case, runs of ASCII letters and digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Terms of a text in order. Not lower(): that would turn some non-ASCII letters into ASCII ones. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))
