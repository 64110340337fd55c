"""Stratified samples and splits assigned by source."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def three_pass(df: DataFrame, id_col: str, labels_col: str, hard_col: str, template_col: str, types: list[str], size: int, per_type: int, hard_share: float, seed: str) -> DataFrame:
    """(id, reason, template, hard) of ``size`` rows: first rare types up to ``per_type`` rows each, then hard rows up to their share, then
    the template that lacks most of its own share.

    Rows are taken in the order of a seeded hash. Only the first ``size`` rows of each type, of the hard ones and of each template
    can be taken, so no more come to the driver, however many rows there are. Ids are to be unique, null templates
    are none; rows of equal text are to be merged before.
    """
    entries = F.filter(F.map_entries(labels_col), lambda e: e.value.isNotNull() & (F.size(e.value) > 0))
    t = df.select(F.col(id_col).alias("id"), F.coalesce(F.transform(entries, lambda e: e.key), F.array().cast("array<string>")).alias("types"), F.coalesce(F.col(hard_col), F.lit(False)).alias("hard"), F.col(template_col).alias("template"))
    t = t.withColumn("place", F.sha2(F.concat(F.lit(seed + "|"), F.col("id").cast("string")), 256))
    groups = F.array_union(F.transform(F.filter("types", lambda x: x.isin(types)), lambda x: F.concat(F.lit("type:"), x)), F.array_compact(F.array(F.when(F.col("hard"), "hard"), F.concat(F.lit("template:"), F.col("template")))))
    g = t.withColumn("group", F.explode(groups))
    counts = {r["group"]: r["n"] for r in g.groupBy("group").agg(F.count("*").alias("n")).collect()}  # a row for each type and template
    total = df.count()
    # rows of a group below the hash that leaves twice as many as can be taken, so that no group is sorted whole
    bound = {k: (2.0 * size + 100) / n for k, n in counts.items()}
    low = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2.0**32
    keep = F.lit(False)
    for k, b in bound.items():
        keep = keep | ((F.col("group") == k) & (low < b))
    order = Window.partitionBy("group").orderBy("place")
    first = g.where(keep).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    pool = {r["id"]: r for r in first.select("id", "types", "hard", "template", "place").distinct().collect()}  # at most size rows a group
    rows = sorted(pool.values(), key=lambda r: r["place"])
    chosen, have = {}, Counter()

    def take(r, reason: str) -> None:
        if r["id"] not in chosen:
            chosen[r["id"]] = (r["id"], reason, r["template"], r["hard"])
            have.update(x for x in r["types"] if x in types)

    for kind in sorted(types, key=lambda x: (counts.get(f"type:{x}", 0), x)):
        for r in rows:
            if have[kind] >= per_type or len(chosen) >= size:
                break
            if kind in r["types"]:
                take(r, f"coverage:{kind}")
    for r in rows:
        if len(chosen) >= size or sum(c[3] for c in chosen.values()) >= int(size * hard_share):
            break
        if r["hard"]:
            take(r, "hard")
    left = {k.removeprefix("template:"): [r for r in rows if f"template:{r['template']}" == k] for k in sorted(counts) if k.startswith("template:")}
    while len(chosen) < size and any(left.values()):
        picked = Counter(c[2] for c in chosen.values())
        lack = {k: counts[f"template:{k}"] / total - picked[k] / max(1, len(chosen)) for k, v in left.items() if v}
        name = max(sorted(lack), key=lack.get)
        take(left[name].pop(0), f"fill:{name}")
    return df.sparkSession.createDataFrame(list(chosen.values()), f"id {dict(df.dtypes)[id_col]}, reason string, template string, hard boolean")


def split_by_source(df: DataFrame, text_col: str, gold: Column, val_percent: int, seed: str) -> DataFrame:
    """``df`` with ``part``: rows of the condition ``gold`` are test and nothing else is; of the others those whose text's hash
    falls into the lowest ``val_percent`` hundredths are val, the rest train. Copies of a text stay together; a text of gold rows
    is test in all its rows."""
    digest = F.md5(F.coalesce(text_col, F.lit("")))
    t = df.withColumn("_digest", digest)
    held = t.where(gold).select("_digest").distinct().withColumn("_gold", F.lit(True))
    low = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), F.col("_digest")), 256), 1, 8), 16, 10).cast("long") % 100 < val_percent
    return t.join(held, "_digest", "left").withColumn("part", F.when(F.col("_gold"), "test").when(low, "val").otherwise("train")).drop("_digest", "_gold")


def assert_no_leak(df: DataFrame, text_col: str, part_col: str = "part") -> DataFrame:
    """``df`` itself; raises if a text stands in more than one part."""
    leaks = df.where(F.col(text_col).isNotNull()).groupBy(F.md5(text_col).alias("digest")).agg(F.countDistinct(part_col).alias("n")).where("n > 1")
    if some := leaks.limit(3).collect():
        raise ValueError(f"texts stand in several parts: {[r['digest'] for r in some]}")
    return df
