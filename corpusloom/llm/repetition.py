"""Problem 5: repetition inside a single document.

Method: robust multivariate outliers. Each text gives a vector of empirical logarithms of its repeated shares of four-
and two-word sequences and of runs of repeated four-word sequences that are eight words long; for each language and
source the minimum covariance determinant is estimated by concentration steps, each one grouped aggregation over the
distinct texts, so that all scales come from the data; vectors beyond a Mahalanobis distance towards more repetition
are selected, and eight-word sequences are counted in the selected texts only. Every repeated eight-word sequence is
such a run, so a share of runs is never less than the share sought, and the distance of a group, the largest at which no
text of more than the share ``LEAST`` of runs lies inside, loses no text. A group whose kept half repeats itself so much
that this is no outlying distance takes the scatter of the other groups, or one of texts without repetition where there
is none.
"""

from __future__ import annotations

import re
from math import gamma

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.wordkit import WordHashes, distinct_in_text, flat_words, sequences, sliced
from corpusloom.session import spread, staged

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
STATS = ("x_run", "x_short", "x_pair")
LONG = 8
SIZES = {"short": 4, "pair": 2}
#: Share of distinct texts that the concentration steps keep.
KEEP = 0.5
#: Chi-squared quantile (3 degrees, 0.975): a smaller distance is no outlying one.
CUTOFF = 9.348
#: Share of repeated long sequences above which a text is repetitive: no group's scatter may hide one of so many runs.
LEAST = 0.06
#: Variance added to each statistic's, and of the statistics in the scatter of texts without repetition.
RIDGE = 1e-4
PLAIN = (0.09, 4.0, 4.0)
#: Texts of fewer long sequences don't count in the estimate, nor do groups of fewer texts.
MIN_SEQUENCES = 30
STEPS = 6
MIN_GROUP = 50

_NN = re.compile(r"\b(?:ikkje|eg|frå|vart|hjå|kva|korleis|berre|ein|noko|dei|sjølv|vere|fekk)\b")
_NB = re.compile(r"\b(?:ikke|jeg|fra|ble|hos|hva|hvordan|bare|en|noe|de|selv|være|fikk)\b")


def _again(seq: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each sequence stands earlier in its text."""
    order = np.lexsort((seq, doc))
    s, d = seq[order], doc[order]
    out = np.zeros(len(seq), bool)
    out[order[1:]] = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    return out


def _runs(again: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Number of places of each text where all short sequences of the next ``LONG`` words stand earlier: at least its repeated long ones."""
    more = LONG - SIZES["short"]
    m = max(0, len(again) - more)
    run = doc[:m] == doc[more:]
    for k in range(more + 1):
        run &= again[k : k + m]
    return np.bincount(doc[:m][run], minlength=n_docs)


def _long(h: np.ndarray, lens: np.ndarray) -> dict:
    """All and distinct long sequences of each text."""
    seq, doc = sequences(h, lens, LONG)
    return {"all_long": np.bincount(doc, minlength=len(lens)), "distinct_long": distinct_in_text(seq, doc, len(lens))[2]}


def _measured(texts: list[str], h: np.ndarray, lens: np.ndarray) -> dict:
    n = len(texts)
    out = {"n_words": lens, "all_long": np.maximum(lens - LONG + 1, 0)}
    for name, size in SIZES.items():
        seq, doc = sequences(h, lens, size)
        again = _again(seq, doc)
        out[f"all_{name}"], out[f"repeated_{name}"] = np.bincount(doc, minlength=n), np.bincount(doc[again], minlength=n)
        if name == "short":
            out["repeated_run"] = _runs(again, doc, n)
    lang, source = [], []
    for t in texts:
        low = t.lower()
        nn, nb = len(_NN.findall(low)), len(_NB.findall(low))
        lang.append("nn" if nn > nb else "nb" if nb else "other")
        source.append("interview" if "\n-- " in t else "dossier")
    digest = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), np.uint64, n).astype(np.int64)
    return out | {"lang": lang, "source": source, "digest": digest}


def _statistics(batches):
    """Statistics of every text; the text too if it has runs, as no other can be selected."""
    cache = WordHashes()
    for pdf in sliced(batches):
        texts = [t or "" for t in pdf["text"]]
        out = {"id": pdf["id"]} | _measured(texts, *flat_words(texts, cache))
        yield pd.DataFrame(out | {"text": [t if r else None for t, r in zip(texts, out["repeated_run"])]})


def _statistics_shares(batches):
    """Statistics of every text with its shares of long sequences and sentences."""
    cache = WordHashes()
    for pdf in sliced(batches):
        texts = [t or "" for t in pdf["text"]]
        h, lens = flat_words(texts, cache)
        share = np.zeros(len(texts))
        for i, t in enumerate(texts):
            parts = [p for p in SENTENCE.split(t) if len(p) > 20]
            total = sum(map(len, parts))
            if total and len(set(parts)) < len(parts):
                share[i] = 1 - sum(map(len, set(parts))) / total
        yield pd.DataFrame({"id": pdf["id"]} | _measured(texts, h, lens) | _long(h, lens) | {"sentence_share": share})


def _shares(batches):
    cache = WordHashes()
    for pdf in sliced(batches):
        yield pd.DataFrame({"id": pdf["id"]} | _long(*flat_words(pdf["text"], cache)))


def _with_share(s: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("all_long") - F.col("distinct_long"), F.col("all_long"))
    return s.withColumn("share", F.coalesce(share, F.lit(0.0))).drop("distinct_long")


def statistics(df: DataFrame, id_col: str, text_col: str, shares: bool = True) -> DataFrame:
    """Repetition statistics of every text.

    ``share`` is (all - distinct) / all over eight-word sequences, 0 where there are none. The language is nb, nn or
    other by common words and the source interview or dossier by its form: both only choose the group. Without
    ``shares`` no eight-word sequence is counted, and ``text`` is there where runs of repeated sequences are.
    """
    t = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    counts = "all_long long, repeated_run long, " + ", ".join(f"all_{k} long, repeated_{k} long" for k in SIZES)
    schema = f"id long, n_words long, {counts}, lang string, source string, digest long"
    if shares:
        s = _with_share(t.mapInPandas(_statistics_shares, f"{schema}, distinct_long long, sentence_share double"))
        s = s.withColumn("share_short", F.coalesce(F.try_divide("repeated_short", "all_short"), F.lit(0.0)))
    else:
        s = t.mapInPandas(_statistics, f"{schema}, text string")
    every = {"run": "all_long"} | {k: f"all_{k}" for k in SIZES}
    s = s.withColumns({f"x_{k}": F.log((F.col(f"repeated_{k}") + 0.5) / (F.col(n) + 1)) for k, n in every.items()})
    return s.drop("all_short", "repeated_short", "all_pair", "repeated_pair")


def _distance(groups: dict[tuple[str, str], tuple], other: tuple | None = None):
    """The squared Mahalanobis distance as a column; groups are (mean, inverse covariance, ...), ``other`` is for the rest."""

    def of(m, inv):
        z = [F.col(c) - F.lit(float(v)) for c, v in zip(STATS, m)]
        return sum((z[i] * z[j] * F.lit(float(inv[i, j])) for i in range(len(STATS)) for j in range(len(STATS))), F.lit(0.0))

    out = of(*other[:2]) if other else F.lit(None).cast("double")
    for (lang, source), (m, inv, *_) in groups.items():
        d = of(m, inv)
        out = F.when((F.col("lang") == lang) & (F.col("source") == source), d).otherwise(out)
    return out


def _moments(df: DataFrame) -> dict:
    sums = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(STATS)]
    sums += [F.avg(F.col(a) * F.col(b)).alias(f"s{i}{j}") for i, a in enumerate(STATS) for j, b in enumerate(STATS) if j >= i]
    out = {}
    for r in df.groupBy("lang", "source").agg(*sums).collect():  # at most six groups
        m = np.array([r[f"m{i}"] for i in range(len(STATS))])
        s = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(len(STATS))] for i in range(len(STATS))])
        out[r["lang"], r["source"]] = (r["n"], m, s - np.outer(m, m))
    return out


def _chi2_cdf(x: float, p: int) -> float:
    """P(chi-squared with p degrees <= x), by summing its density."""
    t = np.linspace(0, x, 20_001)[1:]
    return float(np.sum(t ** (p / 2 - 1) * np.exp(-t / 2)) * (x / 20_000) / (2 ** (p / 2) * gamma(p / 2)))


def _consistency(keep: float) -> float:
    """Factor that makes the covariance of the central share ``keep`` of a normal distribution whole again."""
    p, lo, hi = len(STATS), 0.0, 100.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, p) < keep else (lo, mid)
    return keep / _chi2_cdf(lo, p + 2)


def _edge(m: np.ndarray, c: np.ndarray) -> float:
    """The largest squared distance at which every vector inside has a share of runs of at most ``LEAST``; 0 if the centre has more."""
    far = np.log(LEAST) - m[0]
    return float(far**2 / c[0, 0]) if far > 0 else 0.0


def _shape(moments: dict, factor: float, cutoff: float, plain: float) -> dict:
    """(mean, inverse covariance, squared distance) of each group.

    Small groups, and those whose kept texts repeat themselves so much that they hide others, take the weighted mean of
    the groups that don't, or the scatter of texts without repetition if there is none.
    """
    own = {k: (size, m, c * factor + np.eye(len(STATS)) * RIDGE) for k, (size, m, c) in moments.items()}
    clean = [x for x in own.values() if x[0] >= MIN_GROUP and _edge(x[1], x[2]) >= cutoff]
    n = sum(x[0] for x in clean)
    other = (np.full(len(STATS), plain), np.diag(PLAIN))
    if n:
        pooled = (sum(x[0] * x[1] for x in clean) / n, sum(x[0] * x[2] for x in clean) / n)
        other = pooled if _edge(*pooled) >= cutoff else other
    out = {}
    for k, (size, m, c) in own.items():
        m, c = (m, c) if size >= MIN_GROUP and _edge(m, c) >= cutoff else other
        out[k] = (m, np.linalg.inv(c), _edge(m, c))
    return out


def _judged(s: DataFrame, keep: float, cutoff: float, steps: int) -> DataFrame:
    """``s``, staged statistics, with ``distance`` and ``outlier``.

    A row is an outlier if it has a run of repeated sequences, more than its group's centre does, and its squared robust
    distance exceeds its group's; ``distance`` is their ratio. Copies of a text count once in the estimate, so that one
    text can't become the norm; every row with a share over ``LEAST`` is an outlier, however many of its group are.
    """
    texts = s.where(F.col("all_long") >= MIN_SEQUENCES).select("digest", "lang", "source", "all_long", *STATS).dropDuplicates(["digest", "lang", "source"])
    texts = staged(texts, "repetition_texts")
    # start: the centre between the quartiles, the spreads of the lower half, which repeats less
    quarters = texts.groupBy("lang", "source").agg(F.avg(F.log(F.lit(0.5) / (F.col("all_long") + 1))).alias("plain"), F.count("*").alias("n"), *[F.percentile_approx(c, [0.1, 0.4], 1000).alias(c) for c in STATS]).collect()
    n = sum(r["n"] for r in quarters)
    plain = sum(r["plain"] * r["n"] for r in quarters) / n if n else float(np.log(0.5 / (MIN_SEQUENCES + 1)))
    at = {(r["lang"], r["source"]): (np.array([r[c][1] for c in STATS]), np.diag([1 / ((r[c][1] - r[c][0]) ** 2 + 100 * RIDGE) for c in STATS]), 0.0) for r in quarters}
    for _ in range(steps):
        d = texts.withColumn("d", _distance(at))
        edge = {(r[0], r[1]): r[2] for r in d.groupBy("lang", "source").agg(F.percentile_approx("d", keep, 1000)).collect()}
        inner = F.lit(False)
        for (lang, source), q in edge.items():
            inner = inner | ((F.col("lang") == lang) & (F.col("source") == source) & (F.col("d") <= F.lit(float(q))))
        at = _shape(_moments(d.where(inner)), _consistency(keep), cutoff, plain)
    other = (np.full(len(STATS), plain), np.linalg.inv(np.diag(PLAIN)), _edge(np.full(len(STATS), plain), np.diag(PLAIN)))
    centre, limit = F.lit(float(other[0][0])), F.lit(other[2])
    for (lang, source), (m, _, far) in at.items():
        own = (F.col("lang") == lang) & (F.col("source") == source)
        centre, limit = F.when(own, F.lit(float(m[0]))).otherwise(centre), F.when(own, F.lit(far)).otherwise(limit)
    d = s.withColumn("distance", _distance(at, other) / limit)
    return d.withColumn("outlier", (F.col("distance") > 1 - 1e-9) & (F.col("repeated_run") > 0) & (F.col(STATS[0]) > centre))


def outliers(df: DataFrame, id_col: str, text_col: str, keep: float = KEEP, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """(id, share, share_short, sentence_share, lang, source, distance, outlier) of every row, its share counted whether selected or not.

    Null, empty and short texts have share 0 and are no outliers; rows with equal ids are each judged.
    """
    s = staged(statistics(df, id_col, text_col), "repetition")
    return _judged(s, keep, cutoff, steps).select("id", "share", "share_short", "sentence_share", "lang", "source", "distance", "outlier")


def selected(df: DataFrame, id_col: str, text_col: str, keep: float = KEEP, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """(id, text) of the rows that the distance selects: all whose share may exceed ``LEAST``."""
    s = staged(statistics(df, id_col, text_col, shares=False), "repetition")
    return _judged(s, keep, cutoff, steps).where("outlier").select("id", "text")


def repetitive(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, share) of every row whose share exceeds ``LEAST``, counted in the selected texts only."""
    s = _with_share(selected(df, id_col, text_col).mapInPandas(_shares, "id long, all_long long, distinct_long long"))
    return s.where(F.col("share") > LEAST).select("id", "share")
