"""Exact duplicates, their labels and conflicts, splits, holdouts and samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as T


def first_seen(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row (smallest id) of each text with the number of its copies; null texts are left out."""
    firsts = df.where(F.col(text_col).isNotNull()).groupBy(T.digest(F.col(text_col)).alias("digest")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))
    return firsts.select("digest", id_col, "copies")


def united_labels(df: DataFrame, id_col: str, text_col: str, map_col: str) -> DataFrame:
    """(digest, etype, span): the spans of all copies of a text united by type, without those inside another of the type."""
    x = df.where(F.col(text_col).isNotNull()).select(id_col, T.digest(F.col(text_col)).alias("digest"), map_col)
    long = L.long_form(x, id_col, map_col, "digest").where("span is not null and span <> ''")
    sets = long.groupBy("digest", "etype").agg(F.collect_set("span").alias("spans"))
    return sets.select("digest", "etype", F.explode(L.collapse(F.col("spans"))).alias("span"))


def conflicts(df: DataFrame, text_col: str, map_col: str) -> DataFrame:
    """Texts with copies: number of copies, of different label sets, and whether they conflict."""
    x = df.where(F.col(text_col).isNotNull()).select(T.digest(F.col(text_col)).alias("digest"), L.canonical(F.col(map_col)).alias("canon"))
    g = x.groupBy("digest").agg(F.count("*").alias("copies"), F.countDistinct("canon").alias("variants"))
    return g.where("copies > 1").withColumn("conflict", F.col("variants") > 1)


def hash_rank(salt: str, *cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), *cols), 256)


def holdout(df: DataFrame, stratum: str, key: str, salt: str, ratio: float) -> DataFrame:
    """``side`` benchmark for the first of each stratum by hash rank, train for the rest.

    A stratum of n has min(n - 1, max(1, round-half-even(ratio * n))) on the benchmark side, one of a single key none. The rank
    is taken inside the stratum; strata are as many as the values of ``stratum``.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.col(key).cast("string").alias("item")).distinct()
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(hash_rank(salt, F.col("stratum"), F.col("item")))))
    n = keys.groupBy("stratum").agg(F.count("*").alias("n"))
    target = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio)).cast("long")))
    return ranked.join(n, "stratum").select("stratum", "item", F.when(F.col("rank") <= target, "benchmark").otherwise("train").alias("side"))


def split_by_hash(df: DataFrame, text_col: str, salt: str, test: int, val: int, buckets: int = 100) -> DataFrame:
    """Adds ``part``: test, val or train by the hash of the text, so copies never part; no shuffle."""
    b = F.conv(F.substring(hash_rank(salt, F.md5(text_col)), 1, 8), 16, 10).cast("long") % buckets
    return df.withColumn("part", F.when(F.col(text_col).isNull(), None).when(b < test, "test").when(b < test + val, "val").otherwise("train"))


def hash_shard(df: DataFrame, text_col: str, shards: int) -> DataFrame:
    """Adds ``shard``: the md5 of the text as a number, modulo ``shards``."""
    h = F.md5(text_col)
    folded = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")), F.lit(0), lambda acc, x: (acc * 16 + x) % shards)
    return df.withColumn("shard", F.when(F.col(text_col).isNotNull(), folded))


def quotas(shares: DataFrame, name: str, share: str, total: int) -> DataFrame:
    """Largest remainders: whole numbers that add up to ``total`` in proportion to the shares; ties by name."""
    exact = F.col(share) * total
    x = shares.select(F.col(name).alias("name"), F.floor(exact).alias("base"), F.round(exact - F.floor(exact), 9).alias("rest"))
    left = x.agg((F.lit(total) - F.sum("base")).alias("left"))
    r = x.withColumn("rank", F.row_number().over(Window.orderBy(F.col("rest").desc(), "name")))  # a small table
    return r.crossJoin(left).select("name", (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def upsample(df: DataFrame, factor: Column) -> DataFrame:
    """Each row ``factor`` times, numbered from 1."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), factor.cast("int"))))


def capped_reuse(df: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """At most the first ``cap`` rows of each group: reusing an item is allowed so often."""
    return df.withColumn("use_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("use_no") <= cap)


def resume(todo: DataFrame, done: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text's digest is not among the done texts'."""
    d = done.where(F.col(text_col).isNotNull()).select(T.digest(F.col(text_col)).alias("digest")).distinct()
    return todo.withColumn("digest", T.digest(F.col(text_col))).join(d, "digest", "left_anti")


def stratified_sample(df: DataFrame, stratum: str, key: str, salt: str, size: int) -> DataFrame:
    """The first ``size`` keys of each stratum by hash rank."""
    w = Window.partitionBy(stratum).orderBy(hash_rank(salt, F.col(key).cast("string")), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the last in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
