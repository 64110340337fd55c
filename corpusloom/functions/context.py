"""Text before a span, and the label nearest to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTER = "[0-9A-Za-zÆØÅæøå]"
_GLUED = "[^0-9A-Za-zÆØÅæøå]"
#: One character of a word, and patterns that need a word's end on either side; Java and RE2 read both alike.
W = r"[\p{L}\p{N}_]"


def whole(pattern: str) -> str:
    """``pattern`` as whole words of a lower-case text."""
    return rf"(?:\A|[^\p{{L}}\p{{N}}_])(?:{pattern})(?:[^\p{{L}}\p{{N}}_]|\z)"


def full(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def before(text: Column, span: Column, width: int) -> Column:
    """The ``width`` characters before the span's first place that is not glued to a letter or digit, else before its first place; empty
    if the text lacks it."""
    alone = F.concat(F.lit("(?<!" + _LETTER + ")\\Q"), span, F.lit("\\E(?!" + _LETTER + ")"))
    first = F.position(span, text)
    alone_at = F.when(first > 0, F.regexp_instr(text, alone))
    at = F.when(alone_at > 0, alone_at).otherwise(first)
    start = F.greatest(F.lit(1), at - width)
    return F.when(first > 0, F.substring(text, start, at - start)).otherwise("")


def before_sql(text: str, span: str, width: int) -> str:
    """The same for DuckDB."""
    alone = rf"'(?s)\A((?:.*?{_GLUED})??)\Q' || {span} || '\E(?:\z|{_GLUED})'"
    return f"CASE WHEN NOT contains({text}, {span}) THEN '' WHEN regexp_matches({text}, {alone}) THEN right(regexp_extract({text}, {alone}, 1), {width}) ELSE right(left({text}, strpos({text}, {span}) - 1), {width}) END"


def last_end(head: Column, pattern: str) -> Column:
    """Where the last match of a pattern ends; 0 if there is none."""
    return F.length(F.regexp_extract(head, rf"(?s)\A(.*(?:{pattern}))", 1))


def last_end_sql(head: str, pattern: str) -> str:
    return rf"length(regexp_extract({head}, '(?s)\A(.*(?:{pattern}))', 1))"


def nearest(head: Column, labels: list[tuple[str, str]]) -> Column:
    """The label whose pattern's match ends last in the text before a span, the first of equals; null if none matches."""
    ends = F.array(*[F.struct(last_end(head, p).alias("end"), F.lit(-k).alias("k"), F.lit(label).alias("label")) for k, (p, label) in enumerate(labels)])
    return F.array_max(F.filter(ends, lambda x: x.end > 0)).label
