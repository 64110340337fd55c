"""Intervals, runs and windows inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merged intervals of each group; intervals that only touch stay apart. Rows with a null bound have no part in it."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_top", F.max(end).over(before))
    x = x.withColumn("_new", F.when(F.col("_top").isNull() | (F.col(start) >= F.col("_top")), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def runs(df: DataFrame, keys: list[str], order: list[str], tag: str) -> DataFrame:
    """Runs of equal tags in order: keys, tag, run from 1, first and last of the first order column, length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_new", F.when(F.lag(tag).over(w).eqNullSafe(F.col(tag)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    x = x.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "run", tag).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def bio_spans(df: DataFrame, keys: list[str], pos: str, tag: str) -> DataFrame:
    """Spans of B-/I- tags: a B, or an I after O, the beginning or another type, opens; an I of the same type extends."""
    w = Window.partitionBy(*keys).orderBy(pos)
    kind = F.when(F.col(tag) != "O", F.substring(tag, 3, 1000))
    x = df.withColumn("etype", kind).withColumn("_last", F.lag("etype").over(w))
    x = x.withColumn("_open", F.when(F.col("etype").isNotNull() & (F.col(tag).startswith("B-") | ~F.col("_last").eqNullSafe(F.col("etype"))), 1).otherwise(0))
    x = x.withColumn("_span", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("etype is not null")
    return x.groupBy(*keys, "_span", "etype").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("_span")


def windows(n: Column, size: int, stride: int) -> Column:
    """Starts of overlapping windows over n tokens: each but the first begins ``stride`` tokens before the end of the one before; the last
    ends at n. One window for n up to ``size``, none for n = 0."""
    step = size - stride
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def covered(inner: Column, outer: Column) -> Column:
    """Every interval (start, end) of ``inner`` lies in one of ``outer``."""
    return F.forall(inner, lambda a: F.exists(outer, lambda b: (b.start <= a.start) & (a.end <= b.end)))


def drop_contained(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals without those inside an earlier or longer one of the group."""
    before = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_top", F.max(end).over(before)).where(F.col("_top").isNull() | (F.col("_top") < F.col(end))).drop("_top")
