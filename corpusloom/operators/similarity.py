"""Pairs of similar texts by their word sequences, and greedy keeping of the first of similar ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.session import staged, unstage


def sequence_sets(df: DataFrame, id_col: str, text_col: str, n: int, least: int) -> DataFrame:
    """(id, set): hashes of the distinct n-word sequences of each text of ``least`` words or more."""
    w = df.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("w")).where(F.size("w") >= F.lit(max(n, least)))
    return w.select("id", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.slice("w", i + 1, n)))).alias("set"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, n: int = 5, least: int = 0) -> DataFrame:
    """Pairs (a, b, likeness), a < b, of rows whose sets of n-word sequences have a Jaccard likeness of ``threshold`` or more.

    Equal sets are one set: pairs are sought between distinct sets and given between their smallest ids, the copies with
    their representative. Distinct sets meet on their rarest sequences, of which two similar ones share at least one; every
    meeting is verified on the whole sets, so no pair is lost or wrong. Null and short texts have no set. Ids are to be unique.
    """
    rows = staged(sequence_sets(df, id_col, text_col, n, least).withColumn("key", F.xxhash64(F.array_sort("set"))), "sequence_sets")
    rep = rows.groupBy("key").agg(F.min("id").alias("rep"))
    sets = rows.join(rep, "key").where("id = rep").select("id", "set", F.size("set").alias("n"))
    one = sets.select("id", "n", F.explode("set").alias("s"))
    often = one.groupBy("s").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "s"))  # a text's own sequences
    first = one.join(often.where("often > 1"), "s")  # sequences of one text meet none; they come first in the order
    alone = first.groupBy("id").agg(F.count("*").alias("shared")).join(sets.select("id", "n"), "id").select("id", (F.col("n") - F.col("shared")).alias("alone"))
    first = first.withColumn("place", place).join(alone, "id").where(F.col("place") + F.col("alone") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    left = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "s")
    right = first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s")
    met = left.join(right, "s").where((F.col("a") < F.col("b")) & (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(threshold) * F.col("na") - 1e-9)).select("a", "b").distinct()
    both = met.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    near = both.select("a", "b", T.jaccard(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold)
    copies = rows.join(rep, "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("likeness"))
    return near.unionByName(copies)


def keep_first(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(id, kept): going through the rows by id, one is kept if it is similar to none kept before it.

    The same in rounds over all rows at once: a row whose earlier similar rows are all dropped is kept, its later similar
    rows are dropped. Rows without a set are kept, copies of a kept or dropped row are dropped.
    """
    links = staged(similar_pairs(df, id_col, text_col, threshold, n), "similar")
    edges, kept, lost = links.select("a", "b"), None, links.select("b").limit(0)
    round_ = staged(edges, "open")
    while round_.take(1):
        sure = round_.select("a").distinct().join(round_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")  # nothing open before them
        gone = round_.join(sure, "a").select("b").distinct()
        lost = staged(lost.union(gone).distinct(), "lost")
        rest = round_.join(gone.select(F.col("b").alias("a")), "a", "left_anti").join(gone, "b", "left_anti").join(sure, "a", "left_anti").select("a", "b")
        rest = staged(rest, "open")
        unstage(round_)
        round_ = rest
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(lost.select(F.col("b").alias("id"), F.lit(True).alias("lost")), "id", "left").select("id", F.coalesce(~F.col("lost"), F.lit(True)).alias("kept"))
