"""Text functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# The capitalised-word class of skeletons and the sentence boundary.
CAPITALISED = r"(?<![\p{L}\p{N}_])[A-ZÆØÅ][a-zæøå]+(?![\p{L}\p{N}_])"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def digest(c: Column) -> Column:
    return F.md5(c)


def skeleton(c: Column) -> Column:
    """Digits as #, capitalised words as N, white space squeezed: equal for texts that differ in their values."""
    x = F.regexp_replace(c, "[0-9]", "#")
    return squeeze(F.regexp_replace(x, CAPITALISED, "N"))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def chunks(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def grams(tokens_: Column, n: int) -> Column:
    """All n-token sequences, in order; none for fewer tokens."""
    last = F.size(tokens_) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens_, i, n), " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct values; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, SENTENCE_END), lambda x: x != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def count_occurrences(text: Column, span: Column) -> Column:
    """Number of places of a span, overlapping ones too; 0 for an empty span. Linear in the text."""
    return F.when(F.length(span) > 0, F.regexp_count(text, F.concat(F.lit("(?=\\Q"), span, F.lit("\\E)")))).otherwise(0)


def occurrences(text: Column, span: Column) -> Column:
    """Starts (from 0) of all occurrences, overlapping ones too; none of an empty or null span or text."""
    return _starts(text, span)


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(texts, spans):
        at = []
        k = t.find(s) if t and s else -1
        while k >= 0:
            at.append(k)
            k = t.find(s, k + 1)
        out.append(at)
    return pd.Series(out)


def swap_first(c: Column) -> Column:
    """The same text with its first letter in the other case."""
    head, tail = F.substring(c, 1, 1), F.substring(c, 2, 2**31 - 1)
    return F.concat(F.when(head == F.upper(head), F.lower(head)).otherwise(F.upper(head)), tail)
