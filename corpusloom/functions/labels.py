"""Label maps (type -> spans) and their long form (id, etype, span, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def long_form(df: DataFrame, id_col: str, map_col: str, *keep: str) -> DataFrame:
    """One row for each span with its type and its place in the list from 1; null maps and lists have none, null spans are rows."""
    e = df.select(id_col, *keep, F.explode(map_col).alias("etype", "spans"))
    return e.select(id_col, *keep, "etype", F.posexplode("spans").alias("pos", "span")).withColumn("ord", F.col("pos") + 1).drop("pos")


def canonical(map_col: Column) -> Column:
    """A string that is equal for maps of the same types and the same sets of spans; types without spans don't count."""
    entries = F.transform(F.map_entries(map_col), lambda e: F.struct(e.key.alias("k"), F.array_sort(F.array_distinct(F.filter(e.value, lambda s: s.isNotNull()))).alias("v")))
    return F.coalesce(F.to_json(F.array_sort(F.filter(entries, lambda e: F.size(e.v) > 0))), F.lit("[]"))


def in_scope(map_col: Column, types: Column) -> Column:
    """Only the types of the scope; a null scope keeps all."""
    return F.when(types.isNull(), map_col).otherwise(F.map_filter(map_col, lambda k, _: F.array_contains(types, k)))


def drop_empty(map_col: Column) -> Column:
    return F.map_filter(map_col, lambda _, v: v.isNotNull() & (F.size(v) > 0))


def locate(text: Column, span: Column) -> Column:
    """How a span stands in the text: ok, padded_span, case_mismatch, whitespace_mismatch or not_a_substring."""
    bare = T.strip(span)
    flat_text, flat_span = T.squeeze(F.lower(text)), T.squeeze(F.lower(span))
    return (
        F.when(F.contains(text, span), "ok")
        .when(F.contains(text, bare), "padded_span")
        .when(F.contains(F.lower(text), F.lower(bare)), "case_mismatch")
        .when(F.contains(flat_text, flat_span), "whitespace_mismatch")
        .otherwise("not_a_substring")
    )


def repair(text: Column, span: Column) -> Column:
    """The text's own form of the span up to case and white space; null if it has none."""
    bare = T.strip(span)
    words = F.split(bare, r"\s+")
    pattern = F.concat(F.lit("(?iu)"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "(?U:\\s+)"))
    found = F.regexp_substr(text, pattern)
    return F.when(F.contains(text, span), span).when(F.length(bare) > 0, found)


def collapse(spans: Column) -> Column:
    """Distinct spans without those that are inside another."""
    s = F.array_distinct(spans)
    return F.filter(s, lambda x: ~F.exists(s, lambda y: (y != x) & F.contains(y, x)))
