"""Problem 8: mixing sources to target weights.

Method: min-cost flow for overlapping sources. Texts are aggregated by membership pattern (the set of sources that have
the text); token capacity is routed from patterns to source quotas, each further repetition of a pattern's texts
costing more than the one before; then documents are selected in a seeded order to fill the routed amounts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokenizing import TOKENIZERS, token_counts
from corpusloom.session import staged

SEED = 13
#: Buckets of the seeded order; running totals are taken over buckets first and then inside them.
BUCKET_BITS = 12
SHARE_DIGITS = 9


class Flow:
    """Minimum-cost flow by successive shortest paths; the graph has a node for each pattern and source."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            far, by = [math.inf] * len(self.out), [-1] * len(self.out)
            far[s], queue = 0, [s]
            while queue:
                later = []
                for u in queue:
                    for e in self.out[u]:
                        if self.cap[e] > 0 and far[u] + self.cost[e] < far[self.to[e]]:
                            far[self.to[e]], by[self.to[e]] = far[u] + self.cost[e], e
                            later.append(self.to[e])
                queue = list(dict.fromkeys(later))
            if by[t] < 0:
                return total
            path, v = [], t
            while v != s:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens routed in all, and from each pattern to each source. A text occurs at most as often as every one of its sources allows."""
    names, sources = sorted(patterns), sorted(quotas)
    g = Flow(2 + len(names) + len(sources))
    at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    for s in sources:
        g.add(at[s], 1, quotas[s], 0)
    links = {}
    for i, p in enumerate(names):
        for level in range(max(0, min(repeats[s] for s in p))):
            g.add(0, 2 + i, patterns[p], level * level)
        for s in p:
            links[p, s] = g.add(2 + i, at[s], 1 << 60, 0)
    total = g.run(0, 1)
    return total, {k: g.cap[e ^ 1] for k, e in links.items() if g.cap[e ^ 1]}


def largest_total(patterns: dict, shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total of which every source can reach its share."""
    lo, hi = 0, sum(patterns.values()) * max([1, *repeats.values()])
    while hi - lo > max(1, hi // 10**6):
        mid = (lo + hi) // 2
        quotas = {s: int(mid * x) for s, x in shares.items()}
        lo, hi = (mid, hi) if route(patterns, quotas, repeats)[0] >= sum(quotas.values()) else (lo, mid)
    return lo


def mix(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, total_tokens: int | None = None, seed: int = SEED, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> tuple[DataFrame, DataFrame]:
    """The mixed documents (doc_id, source, n_tokens, copies) and the shares reached.

    ``targets`` has source, target_share and max_repeats; rows with a null in any of them, or no positive share, count
    as no target. Without ``total_tokens`` the mix is the largest of which each source that has texts can reach its share;
    shares of sources without texts go to the others in proportion. Documents of null or untargeted sources and
    null or empty texts (no tokens) never occur. Equal texts are one text of all their sources, given by the smallest
    doc_id. Each source is filled to within half of its last document.
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).collect()  # one row a target
    repeats = {r["source"]: int(r["max_repeats"]) for r in wanted}
    share = {r["source"]: float(r["target_share"]) for r in wanted}
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.md5(text_col).alias("digest"), F.col(text_col).alias("text")).where(F.col("source").isin(*share))
    counted = staged(token_counts(docs, ["doc_id", "source", "digest"], "text", vocabulary).where("n_tokens > 0"), "tokens")
    texts = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens"))
    texts = texts.withColumn("place", F.xxhash64(F.lit(seed), "digest"))
    texts = staged(texts.withColumn("bucket", F.shiftrightunsigned("place", 64 - BUCKET_BITS)), "texts")
    patterns = {tuple(r["pattern"]): int(r["t"]) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("t")).collect()}  # at most 2 ** targets, however many documents
    have = {s for p in patterns for s in p}
    whole = sum(share[s] for s in have)
    part = {s: share[s] / whole for s in have}
    total = largest_total(patterns, part, repeats) if total_tokens is None else total_tokens
    quotas = {s: int(total * part[s]) for s in have}
    _, flows = route(patterns, quotas, repeats)
    chosen = _select(texts, patterns, flows)
    return chosen, _shares(df.sparkSession, chosen, share, repeats, quotas)


def _select(texts: DataFrame, patterns: dict, flows: dict) -> DataFrame:
    """Occurrences in the order (level, seeded place) fill [0, flow of the pattern); each source has a part of that."""
    spark = texts.sparkSession
    segments = []
    for p in sorted(patterns):
        at = 0
        for s in p:
            if (p, s) in flows:
                segments.append((list(p), s, at, at + flows[p, s], patterns[p]))
                at += flows[p, s]
    plan = spark.createDataFrame(segments, "pattern array<string>, source string, low long, high long, tokens long")
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))  # at most 4096 rows a pattern
    before = sums.select("pattern", "bucket", (F.sum("t").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("t")).alias("base"))
    order = Window.partitionBy("pattern", "bucket").orderBy("place", "digest")
    placed = texts.withColumn("inner", F.sum("n_tokens").over(order) - F.col("n_tokens")).join(before, ["pattern", "bucket"])
    placed = placed.withColumn("at", F.col("base") + F.col("inner"))
    # occurrence k of a text begins at k * tokens + at
    hit = placed.join(F.broadcast(plan), "pattern")  # a row for each pattern and source: at most targets * 2 ** targets
    mid = F.col("at") + F.col("n_tokens") / 2  # an occurrence belongs to the part that holds its middle: quotas are met to the nearer side
    first = F.greatest(F.lit(0), F.ceil((F.col("low") - mid) / F.col("tokens")))
    copies = F.greatest(F.lit(0), F.ceil((F.col("high") - mid) / F.col("tokens"))) - first
    return hit.select("doc_id", "source", "n_tokens", copies.cast("long").alias("copies")).where("copies > 0")


def _shares(spark, chosen: DataFrame, share: dict, repeats: dict, quotas: dict) -> DataFrame:
    rows = [(s, share[s], repeats[s], quotas.get(s, 0)) for s in sorted(share)]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, quota_tokens long")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum("copies").alias("occurrences"))
    total = got.agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = plan.join(got, "source", "left").crossJoin(total)  # one row
    return joined.select("source", "target_share", "max_repeats", "quota_tokens", zero("tokens"), zero("documents"), zero("occurrences"), zero("most_copies"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), SHARE_DIGITS).alias("share"))
