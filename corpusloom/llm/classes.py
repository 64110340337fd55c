"""Classes of texts with the same word sequence, and pairs of classes expanded to pairs of records."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pair of classes with more record pairs than this is expanded as two stars instead of all pairs; queries of classes have it exactly.
EXPAND_LIMIT = 1_000_000


def class_of(words: list[str]) -> int:
    """64-bit id of a word sequence, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(" ".join(words))).astype(np.int64))


def with_sizes(members: DataFrame) -> DataFrame:
    """``members`` (cls, rec_id) with the size of its class and its representative, the smallest rec_id."""
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("rec_id").alias("rep"))
    return members.join(sizes, "cls")


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame, limit: int = EXPAND_LIMIT) -> DataFrame:
    """Record pairs (``l``, ``r``) of class pairs (``a``, ``b``), with the other columns of ``pairs``.

    ``left`` and ``right`` are (cls, rec_id). A class pair of up to ``limit`` record pairs gives all of them. A
    larger one gives each record of either class with the representative of the other, so that every record is
    linked and the rows stay linear in the records.
    """
    ls = left.groupBy("cls").agg(F.count("*").alias("ln"), F.min("rec_id").alias("lrep")).withColumnRenamed("cls", "a")
    rs = right.groupBy("cls").agg(F.count("*").alias("rn"), F.min("rec_id").alias("rrep")).withColumnRenamed("cls", "b")
    p = pairs.join(ls, "a").join(rs, "b")
    extra = [c for c in pairs.columns if c not in ("a", "b")]
    lm = left.select(F.col("cls").alias("a"), F.col("rec_id").alias("l"))
    rm = right.select(F.col("cls").alias("b"), F.col("rec_id").alias("r"))
    small = p.where(F.col("ln") * F.col("rn") <= limit).join(lm, "a").join(rm, "b").select("l", "r", *extra)
    big = p.where(F.col("ln") * F.col("rn") > limit)
    one = big.join(lm, "a").select("l", F.col("rrep").alias("r"), *extra)
    two = big.join(rm, "b").where("r <> rrep").select(F.col("lrep").alias("l"), "r", *extra)
    return small.unionByName(one).unionByName(two)


def inside(members: DataFrame, limit: int = EXPAND_LIMIT) -> DataFrame:
    """Pairs (``l``, ``r``), smaller first, of records of one class; a class of more than ``limit`` squared pairs as a star."""
    m = with_sizes(members).where("size > 1")
    small = m.where(F.col("size") * F.col("size") <= limit)
    pairs = small.select("cls", F.col("rec_id").alias("l")).join(small.select("cls", F.col("rec_id").alias("r")), "cls").where("l < r").select("l", "r")
    star = m.where(F.col("size") * F.col("size") > limit).where("rec_id <> rep").select(F.col("rep").alias("l"), F.col("rec_id").alias("r"))
    return pairs.union(star)
