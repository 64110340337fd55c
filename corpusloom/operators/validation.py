"""Validation and repair of labelled records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import intervals_of
from corpusloom.functions import labels as L


def violations(df: DataFrame, id_col: str, text_col: str, map_col: str, known: list[str]) -> DataFrame:
    """(id, etype, span, code): unknown_type once a type, bad_shape for a null list, empty_span, duplicate_span, the location if it is not
    ok, and redundant_nested for a span all of whose places lie in those of one longer span of its type. A record's labels stay in its row: no shuffle."""
    x = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.explode(map_col).alias("etype", "_spans"))
    row = lambda span, code: F.struct(span.cast("string").alias("span"), (F.lit(code) if isinstance(code, str) else code).alias("code"))
    text, spans = F.col("_text"), F.col("_spans")
    blank = lambda s: F.coalesce(F.trim(s), F.lit("")) == ""

    def code(s: Column, i: Column) -> Column:
        again = F.exists(F.slice(spans, F.lit(1), i), lambda y: y.eqNullSafe(s))
        return row(s, F.when(blank(s), "empty_span").when(again, "duplicate_span").otherwise(L.locate(text, s)))

    x = x.withColumn("_judged", F.transform("_spans", code))
    ok = F.transform(F.filter("_judged", lambda v: v.code == "ok"), lambda v: v.span)
    x = x.withColumn("_ok", ok)
    inside = lambda s: F.exists("_ok", lambda y: F.contains(y, s) & (y != s) & intervals_of.all_inside(text, s, y))
    nested = F.transform(F.filter("_ok", inside), lambda s: row(s, "redundant_nested"))
    every = F.concat(F.filter("_judged", lambda v: v.code != "ok"), nested)
    none = F.lit(None)
    found = F.when(~F.col("etype").isin(known), F.array(row(none, "unknown_type"))).when(spans.isNull(), F.array(row(none, "bad_shape"))).otherwise(every)
    return x.select(id_col, "etype", F.explode(found).alias("_v")).select(id_col, "etype", "_v.span", "_v.code")


def fixed(df: DataFrame, id_col: str, text_col: str, map_col: str, known: list[str]) -> DataFrame:
    """(id, etype, spans): known types with their spans repaired to the text's own form, without empty and unrepairable ones, each once; types left
    without spans are dropped."""
    kept = F.map_filter(map_col, lambda k, v: k.isin(known) & v.isNotNull())
    x = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.explode(kept).alias("etype", "raw"))
    spans = F.array_distinct(F.filter(F.transform("raw", lambda s: L.repair(F.col("text"), s)), lambda s: s.isNotNull() & (F.trim(s) != "")))
    return x.select(id_col, "etype", spans.alias("spans")).where(F.size("spans") > 0)


def is_valid_exit(codes: Column) -> Column:
    """Whether a set of codes lets the dataset pass: nothing that repair can't mend and no duplicates."""
    return ~F.exists(codes, lambda c: c.isin("not_a_substring", "duplicate_span", "bad_shape"))
