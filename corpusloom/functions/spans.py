"""Spans in texts: markers, extensions, cues before a span, audit quotes, token tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# The form of a marked span, and the clock time that completes a date.
MARKER = r"⟦([A-Z_]+): ([^⟦⟧]*)⟧"
CLOCK = r"(?: klokken| klokka| kl\.?) [0-9]{1,2}(?:[.:][0-9]{2})?"


def strip_markers(text: Column) -> Column:
    """The text without span markers, the marked spans with their types, and whether the markers balance."""
    kinds, spans = (F.regexp_extract_all(text, F.lit(MARKER), F.lit(k)) for k in (1, 2))
    bare = F.regexp_replace(text, MARKER, "$2")
    return F.struct(bare.alias("text"), F.arrays_zip(kinds.alias("etype"), spans.alias("span")).alias("spans"), (~F.contains(bare, F.lit("⟦")) & ~F.contains(bare, F.lit("⟧"))).alias("balanced"))


def extended(text: Column, span: Column, completion: str = CLOCK) -> Column:
    """The span with its completion if every place of it in the text has the same one; else the span as it is."""
    pattern = F.concat(F.lit("\\Q"), span, F.lit(f"\\E({completion})?"))
    found = F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))
    return F.when((F.size(found) == 1) & (F.length(span) > 0), F.concat(span, F.element_at(found, 1))).otherwise(span)


def nearest_cue(before: Column, cues: list[str]) -> Column:
    """The cue that ends last in the text before a span; of two that end together the longer; null without any."""
    low = F.lower(before)
    ends = [F.when(F.contains(low, F.lit(c)), F.struct((F.length(low) - F.length(F.substring_index(low, c, -1))).alias("end"), F.lit(len(c)).alias("n"), F.lit(c).alias("cue"))) for c in cues]
    return F.array_max(F.filter(F.array(*ends), lambda x: x.isNotNull())).cue


def without_sentences(text: Column, pattern: str, protected: Column) -> Column:
    """The text without sentences that the pattern hits, but for those that hold a protected string; the others are joined by a space."""
    kept = F.filter(T.sentences(text), lambda s: ~s.rlike(pattern) | F.exists(protected, lambda p: (p != "") & F.contains(s, p)))
    return F.array_join(kept, " ")


def parse_audit(reply: Column) -> Column:
    """(kind, quote) of each line FUNN|KIND|quote of a reply; others are skipped."""
    lines = F.filter(T.lines(reply), lambda s: s.rlike(r"^\s*FUNN\|[^|]+\|.+$"))
    return F.transform(lines, lambda s: F.struct(T.strip(F.get(F.split(s, r"\|", 3), F.lit(1))).alias("kind"), T.strip(F.get(F.split(s, r"\|", 3), F.lit(2))).alias("quote")))


def trimmed_to_text(text: Column, quote: Column, most_end: int = 4, most_start: int = 3) -> Column:
    """The quote, or the longest part of it left by dropping up to three words at its end and two at its start, that stands in the text."""
    w = F.split(quote, " ")
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most_end - 1)), lambda e: F.transform(F.sequence(F.lit(0), F.lit(most_start - 1)), lambda s: F.array_join(F.slice(w, s + 1, F.greatest(F.lit(0), F.size(w) - s - e)), " "))))
    found = F.filter(cuts, lambda c: (c != "") & F.contains(text, c))
    return F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(0))


def bio_tags(text: Column, spans: Column) -> Column:
    """(start, token, tag) of each word: B- at a span's first word, I- inside it, O elsewhere; ``spans`` is an array of (etype, start, end).

    The first span of the array that covers a word gives its tag, but no I- replaces another span's B-.
    """
    parts = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,token:string>>").alias("out")),
        lambda acc, p: F.struct((acc.at + F.length(p)).alias("at"), F.when(p.rlike(r"^[\p{L}\p{N}_]"), F.array_append(acc.out, F.struct(acc.at.alias("start"), p.alias("token")))).otherwise(acc.out).alias("out")),
        lambda acc: acc.out,
    )

    def tag(t):
        first = F.get(F.filter(spans, lambda s: s.start == t.start), F.lit(0))
        inside = F.get(F.filter(spans, lambda s: (s.start < t.start) & (t.start < s.end)), F.lit(0))
        return F.struct(t.start.alias("start"), t.token.alias("token"), F.when(first.isNotNull(), F.concat(F.lit("B-"), first.etype)).when(inside.isNotNull(), F.concat(F.lit("I-"), inside.etype)).otherwise("O").alias("tag"))

    return F.transform(placed, tag)
