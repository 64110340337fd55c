"""Problem 6: near-duplicate records with small edits.

Method: meet-in-the-middle ball hashing. A text's fingerprints are ``tables`` sets of ``symbols`` (position, minimum
hash) elements over its five-word sequences. In the symmetric-difference metric two fingerprints within radius
2 (one symbol replaced) have a common point within half the radius, 1, of each: the set with one element removed.
So every fingerprint emits its ``symbols`` variants with one element removed, variants are shuffled, deduplicated,
and the colliding classes are verified on their whole sets of sequences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.wordkit import WordHashes, distinct_in_text, flat_words, mix, sequences, sliced, words
from corpusloom.llm.classes import EXPAND_LIMIT, class_of, expand, inside
from corpusloom.operators.components import connected_components
from corpusloom.session import spread, staged

MIN_WORDS = 40
SEQUENCE = 5
TABLES = 10
SYMBOLS = 5
#: Rows of one variant that are paired in one piece, and pairs of a frame.
BLOCK = 2_000
PAIRS = 500_000


def _keys(seq: np.ndarray, n: np.ndarray, tables: int, symbols: int) -> np.ndarray:
    """Variant keys, one row for each text: minimum hashes, then each fingerprint without one of its symbols."""
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    mins = np.empty((len(n), tables * symbols), np.uint64)
    for k in range(tables * symbols):
        x = seq * np.uint64((0xD1342543DE82EF95 + 2 * k * 0x2545F4914F6CDD1D) % 2**64 | 1)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        mins[:, k] = np.minimum.reduceat(x, starts)
    mins = mix(mins) + mix(np.arange(tables * symbols, dtype=np.uint64))  # each symbol with its position
    mins = mix(mins).reshape(len(n), tables, symbols)
    total = mins.sum(axis=2, dtype=np.uint64)
    return mix(total[:, :, None] - mins).reshape(len(n), tables * symbols)


def _sets(batches):
    cache, seen = WordHashes(), set()
    for pdf in sliced(batches):
        ids, first, texts, cls = [], [], [], []
        for i, t in zip(pdf["rec_id"], pdf["text"]):
            if not t:
                continue
            w = words(t)
            if len(w) < MIN_WORDS:
                continue
            c = class_of(w)
            new = c not in seen
            if new:
                seen.add(c)
                texts.append(t)
            ids.append(i)
            cls.append(c)
            first.append(new)
        if not ids:
            continue
        sets = [None] * len(ids)
        if texts:
            h, lens = flat_words(texts, cache)
            seq, doc = sequences(h, lens, SEQUENCE)
            seq, doc, n = distinct_in_text(seq, doc, len(texts))
            ends = np.cumsum(n)
            short = (seq >> np.uint64(32)).astype(np.uint32)  # ascending in each text, as seq is
            k = 0
            for j, new in enumerate(first):
                if new:
                    sets[j] = short[ends[k] - n[k] : ends[k]].tobytes()
                    k += 1
        yield pd.DataFrame({"rec_id": ids, "cls": cls, "sh": sets})


def _variants(tables: int, symbols: int):
    """Rows (cls, key): every variant of every fingerprint of a class's set."""

    def run(batches):
        for pdf in sliced(batches):
            if len(pdf):
                n = pdf["sh"].map(len).to_numpy() // 4
                keys = _keys(mix(np.frombuffer(b"".join(pdf["sh"]), np.uint32).astype(np.uint64)), n, tables, symbols)
                yield pd.DataFrame({"cls": np.repeat(pdf["cls"].to_numpy(np.int64), keys.shape[1]), "key": keys.view(np.int64).ravel()})

    return run


def _bucket_pairs(key: np.ndarray, cls: np.ndarray):
    """Frames of the pairs of classes with a common variant, from rows in order of variant and class."""
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[keep], cls[keep]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    for m in np.unique(size[size > 1]):
        starts = edge[:-1][size == m]
        first, second = np.triu_indices(int(m), 1)
        step = max(1, PAIRS // len(first))
        for k in range(0, len(starts), step):
            rows = cls[starts[k : k + step, None] + np.arange(m)]
            yield pd.DataFrame({"a": rows[:, first].ravel(), "b": rows[:, second].ravel(), "key": pd.NA, "block": pd.NA}).astype({"key": "Int64", "block": "Int64"})


def _collide(block: int):
    """Pairs (a, b) of classes with a common variant, from rows in order of variant and class, read batch by batch.

    A variant of more than ``block`` rows gives its rows instead (a: class, key, block number), which are paired block
    by block in tasks of their own.
    """

    def run(batches):
        key, cls, hot, number, held = np.empty(0, np.int64), np.empty(0, np.int64), None, 0, []

        def blocks(rows: np.ndarray, k: int, at: int) -> pd.DataFrame:
            n = at + np.arange(len(rows))
            return pd.DataFrame({"a": rows, "b": pd.NA, "key": k, "block": n // block}).astype({"b": "Int64", "key": "Int64", "block": "Int64"})

        for pdf in batches:
            if not len(pdf):
                continue
            key, cls = np.concatenate((key, pdf["key"].to_numpy(np.int64))), np.concatenate((cls, pdf["cls"].to_numpy(np.int64)))
            if hot is not None:  # the open variant goes on
                end = int(np.searchsorted(key != hot, True)) if (key != hot).any() else len(key)
                if end:
                    yield blocks(cls[:end], hot, number)
                    number += end
                key, cls = key[end:], cls[end:]
                if not len(key):
                    continue
                hot = None
            last = int(np.flatnonzero(key == key[-1])[0])  # where the open variant begins
            yield from _split(key[:last], cls[:last], block, blocks)
            key, cls = key[last:], cls[last:]
            if len(key) > block:
                hot, number = int(key[0]), len(key)
                yield blocks(cls, hot, 0)
                key, cls = key[:0], cls[:0]
        yield from _split(key, cls, block, blocks)

    return run


def _split(key: np.ndarray, cls: np.ndarray, block: int, blocks):
    """Pairs of whole variants, and the rows of those that are too large."""
    if not len(key):
        return
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    for k in np.flatnonzero(size > block):
        yield blocks(cls[edge[k] : edge[k + 1]], int(key[edge[k]]), 0)
    small = np.repeat(size <= block, size)
    yield from _bucket_pairs(key[small], cls[small])


def _block_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs between two blocks of one variant, or inside one."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    x = np.unique(pdf["a"][pdf["block"] == i].to_numpy(np.int64))
    if i == j:
        first, second = np.triu_indices(len(x), 1)
        return pd.DataFrame({"a": x[first], "b": x[second]})
    y = np.unique(pdf["a"][pdf["block"] == j].to_numpy(np.int64))
    a, b = np.repeat(x, len(y)), np.tile(y, len(x))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b]


def collisions(variants: DataFrame, parts: int, block: int) -> DataFrame:
    """Distinct pairs (a, b), smaller first, of the classes of ``variants`` (cls, key) that have a variant in common."""
    rows = variants.repartition(parts, "key").sortWithinPartitions("key", "cls").mapInPandas(_collide(block), "a long, b long, key long, block long")
    rows = staged(rows.distinct(), "collisions")
    hot = rows.where("key is not null").select("a", "key", "block")
    top = hot.groupBy("key").agg(F.max("block").alias("top"))
    both = top.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("i"), "top").select("key", "i", F.explode(F.sequence("i", "top")).alias("j"))
    sent = both.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(hot, ["key", "block"])
    far = sent.groupBy("key", "i", "j").applyInPandas(_block_pairs, "a long, b long")
    return rows.where("key is null").select("a", "b").union(far).distinct()


def _verify(threshold: float):
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b)):
            x, y = np.unique(np.frombuffer(x, np.uint32)), np.unique(np.frombuffer(y, np.uint32))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both / (len(x) + len(y) - both)
        return pd.Series(out)

    return F.pandas_udf(likeness, "double")


def alike_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, tables: int = TABLES, symbols: int = SYMBOLS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequence and the pairs of classes whose likeness is ``threshold`` or more.

    Returns (members: rec_id, cls) and (pairs: a, b, likeness). Null, empty and blank texts and texts of fewer than 40
    words are in neither. Each collision is verified on the two whole sets, so no pair is wrong; a pair of likeness s
    is missed with probability (1 - s^5 - 5 s^4 (1 - s))^tables: 6e-4 at 0.7, 4e-5 at 0.75, 2e-6 at 0.8.
    """
    texts = spread(df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text")))
    base = staged(texts.mapInPandas(_sets, "rec_id long, cls long, sh binary"), "sets-of-all")
    variants = base.where("sh is not null").select("cls", "sh").mapInPandas(_variants(tables, symbols), "cls long, key long")
    n = max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = staged(collisions(variants, n, block), "pairs")
    need = found.select(F.col("a").alias("cls")).union(found.select(F.col("b").alias("cls"))).distinct()
    sets = base.where("sh is not null").select("cls", "sh").join(need, "cls", "left_semi").dropDuplicates(["cls"])
    sets = staged(sets, "sets")
    both = found.join(sets.select(F.col("cls").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("sh").alias("y")), "b")
    pairs = both.select("a", "b", _verify(threshold)("x", "y").alias("likeness")).where(F.col("likeness") >= threshold)
    return base.select("rec_id", "cls"), staged(pairs, "alike")


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, limit: int = EXPAND_LIMIT) -> DataFrame:
    """Pairs (id_a, id_b), smaller first, of likeness ``threshold`` or more; equal texts included.

    Pairs between or inside classes of copies of more than ``limit`` record pairs come as stars around the class's
    representative, so every record keeps its links and the rows stay linear in the records; ``alike_classes`` has
    them exactly, as pairs of classes and membership.
    """
    members, pairs = alike_classes(df, id_col, text_col, threshold)
    near = expand(pairs.select("a", "b"), members, members, limit)
    every = near.unionByName(inside(members, limit))
    return every.select(F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """One row for each record: rec_id, cls (null for short and missing texts), group_id (smallest rec_id of its
    group), n_links (similar classes) and copies (records of its class)."""
    members, pairs = alike_classes(df, id_col, text_col, threshold)
    groups = connected_components(pairs, "a", "b").withColumnRenamed("node", "cls")
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    links = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("rec_id").alias("rep"))
    info = sizes.join(groups, "cls", "left").join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = info.groupBy("component").agg(F.min("rep").alias("group_id"))
    info = info.join(first, "component").select("cls", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    ids = df.select(F.col(id_col).alias("rec_id"))
    return (
        ids.join(members.join(info, "cls"), "rec_id", "left")
        .select("rec_id", "cls", F.coalesce("group_id", "rec_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    )
