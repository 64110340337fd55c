"""Problem 4: template residue and error-page text.

Method: a regularised linear classifier on hashed n-grams, length and title features of a text's segments (sentences
and lines). Weak labels come from response statuses and phrases in a bounded sample; hosts named in the sample are
split, and the model is validated on hosts it has not seen. The classifier then judges every segment of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.wordkit import sliced
from corpusloom.session import spread

BITS = 18
#: Texts of the training sample by hash.
SAMPLE = 2_500
#: A segment of more tokens is judged in parts.
PART = 24
EPOCHS = 10
L2 = 2e-6
SEED = 11

# Weak labels.
WEAK = {
    "slot": r"__[A-ZÆØÅ][A-ZÆØÅa-zæøå ]{1,24}__|@@[A-ZÆØÅ_]{3,24}@@|##[A-ZÆØÅ_]{3,24}##|<%[^%\n]{0,60}%>|\[\[[^\[\]\n]{2,40}\]\]|\{\{[^{}\n]{0,60}\}\}|\{%[^%\n]{0,60}%\}|[$#]\{[^{}\n]{1,40}\}|\{[A-Za-zÆØÅæøå_. ]{2,30}\}|%[A-ZÆØÅ_]{3,24}%|&lt;[A-Za-zæøå_ ]{2,24}&gt;|<[A-Za-zæøå_]{2,24}>|\[(?:TODO|[Ss]ett inn|[Ff]yll inn|[Ii]nsert)[^\]\n]{0,40}\]|\[[A-ZÆØÅa-zæøå ]{2,30} her\]|\[[A-ZÆØÅ_]{3,24}\](?!\()|\((?:fyll|sett) inn [^)\n]{1,30}\)|«[A-ZÆØÅ][a-zæøå]+»(?=,| og følges| til oss|$|\n)|\bX{4,}\b|\.{6,}|_{5,}|(?<![\w.])N\.N\.|\bnull null\b|\bundefined\b",
    "filler": r"(?i)\blorem ipsum\b|\basdf\b|\bqwerty\b|\bdummytekst|\btekst tekst\b|kommer brødteksten|eksempeltekst|\bplaceholder text\b",
    "status": r"(?i)\b(?:[45]\d\d) (?:service unavailable|bad gateway|not found|internal server error|forbidden|gateway time-?out|siden finnes ikke)|\"status\": ?[45]\d\d|bad gateway|service unavailable|too many requests|did not answer in time|økt(?:en|a) din er (?:utløpt|gått ut)|session (?:has )?expired|siden finnes ikke|noe gikk galt|feilkode \d|tilgang (?:er )?nektet|access denied|\b(?:Key|Value|Type|Index|Attribute)Error\b|nede for planlagt vedlikehold|vi fant ikke siden du|bekreft at du er et menneske|verify (?:that )?you are (?:a )?human",
    "script": r"(?i)(?:slå på|skru på|aktiver|enable|turn on) (?:java)?s[ck]ript|needs? scripts?\b|støtter ikke (?:java)?s[ck]ript|requires? javascript|last siden .{0,60}på nytt",
}
_WEAK = {k: re.compile(p, re.M) for k, p in WEAK.items()}
#: Signs of residue by which the sample is made richer in it; they decide nothing else.
MARKS = ("{", "[TODO", "[S", "(fyll inn", "(sett inn", "orem ipsum", "HTTP ", "undefined", "null null", "XXXX", "......", "N.N.", "&lt;", "«", "%", " her]", "JavaScript", "kript", "script", "status", "Gateway", "utløpt", "finnes ikke", "eilkode", "nektet", "Error", "vedlikehold", "asdf", "__", "@@", "##", "[[", "ipsum", "dolor", "quo", "ekst tekst", "brødtekst", "menneske", "requests", "gikk galt", "lette etter")
#: So many times ``limit`` texts are looked at for marks.
RICHER = 12

SEGMENT = re.compile(r"(?<=[.!?])\s+|\s*[\r\n]+\s*")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_+")
_HOST = re.compile(r"\b[\w\-]+(?:\.[\w\-]+)*\.(?:example|test|invalid|no|com|org|net)\b")


_RUN = re.compile(r"(?:\b[^\W\d_]{2,}[ ,.]+){12,}")


def _filler(segment: str, known) -> bool:
    """Whether a run of twelve or more different words, mostly in lower case, is made of words that hardly any text has."""
    for m in _RUN.finditer(segment):
        w = re.findall(r"[^\W\d_]+", m.group())
        if sum(x.islower() for x in w) > 0.8 * len(w) and len(set(w)) > 0.8 * len(w) and sum(x.lower() in known for x in w) < 0.4 * len(w):
            return True
    return False


def weak_kind(segment: str, known=None) -> str | None:
    """Kind of residue that a phrase or form tells of; ``known`` are the words that several texts have."""
    return next((k for k, p in _WEAK.items() if p.search(segment)), None) or ("filler" if known is not None and _filler(segment, known) else None)


def _shape(token: str) -> str:
    if token[0].isdigit():
        return "0" * min(len(token), 4)
    if not token[0].isalpha():
        return token[:3]
    return ("X" if len(token) == 1 else "XX") if token.isupper() else "Xx" if token[0].isupper() else "x"


class Tokens(dict):
    """token -> number; the hashes of its lower-case form, its shape, its beginning and its end stand in lists."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit, self.low, self.shape, self.head, self.tail = limit, [], [], [], []
        for special in ("\x02first", "\x02", "\x03"):
            self[special]  # noqa: B018

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.low)
        s = _shape(token)
        self.low.append(xxhash.xxh64_intdigest(s if token[0].isdigit() else token.lower()))
        self.shape.append(xxhash.xxh64_intdigest("shape" + s))
        w = token.lower() if token[0].isalpha() and len(token) > 3 else ""
        self.head.append(xxhash.xxh64_intdigest("head" + w[:3]) if w else 0)
        self.tail.append(xxhash.xxh64_intdigest("tail" + w[-3:]) if w else 0)
        return n


def segments(text: str) -> list[list[str]]:
    """Token lists of the text's segments, long ones in parts; each with marks at its ends, the first with the mark of a title."""
    out = []
    for s in SEGMENT.split(text):
        t = TOKEN.findall(s)
        for k in range(0, len(t), PART):
            out.append(["\x02first" if not out else "\x02", *t[k : k + PART], "\x03"])
    return out


def features(segs: list[list[str]], cache: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all segments and the edges of each segment's part."""
    lens = np.fromiter(map(len, segs), np.int64, len(segs))
    at = np.fromiter(map(cache.__getitem__, chain.from_iterable(segs)), np.int64, int(lens.sum()))
    low, shape = np.array(cache.low, np.uint64)[at], np.array(cache.shape, np.uint64)[at]
    n = len(at)
    last = np.zeros(n, bool)
    last[np.cumsum(lens) - 1] = True
    nxt, nxt2 = np.roll(low, -1), np.roll(shape, -1)
    nxt3 = np.roll(shape, -2)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pair = np.where(last, np.uint64(0), low * a + nxt * b + np.uint64(1))
    form = np.where(last, np.uint64(0), shape * a + nxt2 * b)
    triple = np.where(last | np.roll(last, -1), np.uint64(0), shape * a + nxt2 * b + nxt3 * c)
    mixed = np.where(last, np.uint64(0), low * c + nxt2 * a + np.uint64(2))
    size = np.uint64(7) + np.minimum(np.repeat(lens, lens), 30).astype(np.uint64) // np.uint64(4)
    head, tail = np.array(cache.head, np.uint64)[at], np.array(cache.tail, np.uint64)[at]
    f = np.stack([low, pair, form, triple, mixed, np.where(last, size * a, np.uint64(0)), head, tail], axis=1)
    f ^= f >> np.uint64(31)
    f *= np.uint64(0x7FB5D329728EA185)
    return (f >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(([0], np.cumsum(lens)))


ZERO = int((np.uint64(0) * np.uint64(1)) >> np.uint64(64 - BITS))


def scores(f: np.ndarray, edges: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    if not len(f):
        return np.zeros(0)
    return np.add.reduceat(w[f].sum(axis=1), edges[:-1]) + bias


def fit(segs: list[list[str]], y: np.ndarray, epochs: int = EPOCHS, l2: float = L2, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Logistic regression with squared regularisation by adaptive gradient steps on batches; positives weigh as all negatives up to tenfold."""
    w, g2, bias = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-4, np.float32), -2.0
    if not len(segs) or not y.any():
        return w, bias
    f, edges = features(segs, Tokens())
    weight = np.where(y > 0, min(10.0, max(1.0, (y == 0).sum() / max(1, y.sum()))), 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(segs))
        for k in range(0, len(order), 2048):
            rows = np.sort(order[k : k + 2048])
            n = edges[rows + 1] - edges[rows]
            flat = np.repeat(edges[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            x = f[flat]
            z = np.add.reduceat(w[x].sum(axis=1), np.concatenate(([0], np.cumsum(n)[:-1]))) + bias
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            grad = np.bincount(x.ravel(), np.repeat(np.repeat(e, n), x.shape[1]), minlength=1 << BITS).astype(np.float32) + l2 * w
            grad[ZERO] = 0
            g2 += grad * grad
            w -= 0.15 * grad / np.sqrt(g2)
            bias -= 0.05 * float(e.sum())
    return w, bias


def sample(df: DataFrame, id_col: str, text_col: str, limit: int = SAMPLE) -> list[str]:
    """About ``limit`` texts by the hash of their ids, and of RICHER times as many others those that hold a mark."""
    t = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    n = max(1, df.count())
    at = (F.xxhash64(F.lit(17), "id") / F.lit(2.0**64)) + 0.5  # uniform in [0, 1)
    mark = F.lit(False)
    for x in MARKS:
        mark = mark | F.contains("text", F.lit(x))
    low = (at < limit / n) | ((at < RICHER * limit / n) & mark)  # few texts come to the search for marks
    rows = t.where(low & F.length("text").between(20, 20_000)).orderBy("id").collect()  # about limit * (1 + RICHER) at most
    return [r["text"] for r in rows]


def labelled(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Distinct segments, their weak labels, and whether their text names a host that is held out (a fifth of the hosts)."""
    seen, segs, y, held = set(), [], [], []
    of: dict[str, int] = {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            of[w] = of.get(w, 0) + 1
    known = frozenset(w for w, n in of.items() if n > 2)
    for t in texts:
        host = _HOST.search(t)
        out = host is not None and xxhash.xxh32_intdigest(host.group().lower()) % 5 == 0
        first = True
        for s in SEGMENT.split(t):
            tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(s)]
            for k in range(0, len(tokens), PART):
                part = tokens[k : k + PART]
                key = ("\x02first" if first else "\x02", *[x[0] for x in part], "\x03")
                first = False
                if key not in seen:
                    seen.add(key)
                    segs.append(list(key))
                    y.append(weak_kind(s[part[0][1] : part[-1][2]], known) is not None)
                    held.append(out)
    return segs, np.array(y, np.float64), np.array(held, bool)


def validation(df: DataFrame, id_col: str, text_col: str, limit: int = SAMPLE) -> DataFrame:
    """Segments, weak positives, precision and recall against weak labels, on seen and on unseen hosts."""
    segs, y, held = labelled(sample(df, id_col, text_col, limit))
    w, bias = fit([s for s, h in zip(segs, held) if not h], y[~held]) if len(segs) else (np.zeros(1 << BITS, np.float32), -2.0)
    f, edges = features(segs, Tokens())
    said = scores(f, edges, w, bias) > 0 if len(segs) else np.zeros(0, bool)
    rows = []
    for name, part in (("seen", ~held), ("unseen", held)):
        hit = float((said & (y > 0) & part).sum())
        rows.append((name, int(part.sum()), int(y[part].sum()), hit / max(1.0, float((said & part).sum())), hit / max(1.0, float(y[part].sum()))))
    return df.sparkSession.createDataFrame(rows, "hosts string, segments long, positives long, precision double, recall double")


def judging(w: np.ndarray, bias: float):
    """The classifier as a function of a text column: (score, residue, worst)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = Tokens()
        for whole in batches:
            out = []
            for at in range(0, len(whole), 1_000):
                if len(cache) > cache.limit:
                    cache = Tokens()
                texts = whole.iloc[at : at + 1_000]
                every, owner = [], []
                for k, t in enumerate(texts):
                    s = segments(t) if t else []
                    every += s
                    owner += [k] * len(s)
                best = np.full(len(texts), np.nan)
                worst = np.full(len(texts), None, object)
                if every:
                    f, edges = features(every, cache)
                    z = scores(f, edges, w, bias)
                    own = np.array(owner)
                    order = np.lexsort((-np.arange(len(z)), z, own))
                    top = order[np.concatenate((own[order][1:] != own[order][:-1], [True]))]
                    best[own[top]] = z[top]
                    for k in top[z[top] > 0]:
                        worst[own[k]] = " ".join(every[k][1:-1])
                out.append(pd.DataFrame({"score": best, "residue": np.nan_to_num(best, nan=-1) > 0, "worst": worst}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"score": np.empty(0), "residue": np.empty(0, bool), "worst": np.empty(0, object)})

    return F.pandas_udf(run, "score double, residue boolean, worst string")


def _judged(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``df`` with a column ``_judged``; each text is judged where it is scanned."""
    segs, y, _ = labelled(sample(df, id_col, text_col, limit))
    return spread(df).withColumn("_judged", judging(*fit(segs, y))(F.col(text_col)))


def judge(df: DataFrame, id_col: str, text_col: str, limit: int = SAMPLE) -> DataFrame:
    """(id_col, score, residue, worst) of every row: the highest segment score, whether it is positive, and that segment.

    Null, empty and blank texts have score null and residue false. Whole texts are judged.
    """
    out = _judged(df.select(id_col, text_col), id_col, text_col, limit)
    return out.select(id_col, F.when(~F.isnan("_judged.score"), F.col("_judged.score")).alias("score"), "_judged.residue", "_judged.worst")


def without_residue(df: DataFrame, id_col: str, text_col: str, limit: int = SAMPLE) -> DataFrame:
    """The rows of ``df`` whose text holds no residue, rows without text included, with all columns; one pass, no shuffle."""
    return _judged(df, id_col, text_col, limit).where("not _judged.residue").drop("_judged")
