"""Problem 9: missing or wrong document language labels.

Method: Bayesian evidence fusion. Sentence likelihoods come from word and character-sequence counts of a bounded sample
of labelled documents; they are combined with the declared language of the document, the address suffixes in its
text and host priors (here the document's source and genre) that are smoothed from the general to the particular by
grouped aggregation over all documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.wordkit import WORD, sliced
from corpusloom.session import spread, staged

LANGS = ("nb", "nn", "en", "sv", "da", "de", "pl")
#: Labelled documents from which the likelihoods are counted, chosen by hash.
SAMPLE_DOCS = 4_000
MIN_WORDS = 5
#: A piece without a mark at its end counts as a full sentence from so many words on, else as a heading.
UNMARKED_WORDS = 12
#: A passage without marks is judged in windows of so many words.
WINDOW_WORDS = 25
#: Weight of a word's log-likelihood: words of a sentence are not independent.
TEMPER = 0.6
#: Weight of the declared language, and of an address suffix of the language's country, in log-odds.
DECLARED = 2.0
SUFFIX = 0.5
#: Pseudo-counts by which a host's counts are drawn to the more general ones.
SMOOTH = 50.0
#: Least confidence with which a sentence counts as written in another language.
SURE = 0.95

# Country suffixes of addresses and their languages.
SUFFIXES = {"no": ("nb", "nn"), "se": ("sv",), "dk": ("da",), "de": ("de",), "at": ("de",), "pl": ("pl",), "uk": ("en",), "ie": ("en",)}

_END = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+(?=[^\W\d_]*[^\W_a-zæøåäöüß]|[^a-zæøåäöüß])|[\r\n]+")
_ADDRESS = re.compile(r"(?:@|https?://|www\.)[\w.\-]*\.(no|se|dk|de|at|pl|uk|ie)\b", re.I)
_INITIAL = re.compile(r"(?:^|\s)(?:[^\W\d_]|\d{1,2}|nr|tlf|ca|bl\.a|kl|St|Dr|dr)\.$")


def label(col):
    """Two-letter code of a declared language; null for null, empty and und."""
    code = F.substring(F.regexp_extract(F.lower(F.trim(col)), "^([a-z]{2,3})(?:[-_]|$)", 1), 1, 2)
    return F.when(F.lower(F.trim(col)).isin("", "und") | (code == ""), None).otherwise(code)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; an initial or ordinal ends none, and an unmarked passage is cut into windows of words."""
    out, start = [], 0
    for m in _END.finditer(text):
        if "\n" not in m.group() and "\r" not in m.group() and _INITIAL.search(text, max(start, m.start() - 8), m.start()):
            continue
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(text)))
    cut = []
    for a, b in out:
        if b - a > 12 * WINDOW_WORDS and len(ends := [m.end() for m in WORD.finditer(text, a, b)]) > 2 * WINDOW_WORDS:
            for k in range(WINDOW_WORDS, len(ends) - WINDOW_WORDS, WINDOW_WORDS):
                cut.append((a, ends[k - 1]))
                a = ends[k - 1]
        cut.append((a, b))
    return [(a, b) for a, b in cut if b > a]


def tidy(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


class Model:
    """Log-likelihood ratios of words against the mean language; the unseen ones by their character sequences."""

    def __init__(self, word_counts: np.ndarray, words: list[str], gram_counts: np.ndarray, grams_: list[str]):
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: i for i, g in enumerate(grams_)}
        self.by_word, self.by_gram = self._ratio(word_counts, 0.3), self._ratio(gram_counts, 0.5)
        self.seen = word_counts.sum(axis=1)

    @staticmethod
    def _ratio(counts: np.ndarray, alpha: float) -> np.ndarray:
        p = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * len(counts)))
        return p - p.mean(axis=1, keepdims=True)

    def score(self, word: str) -> np.ndarray:
        if word.isdigit():
            return np.zeros(len(LANGS))
        g = [self.by_gram[i] for i in map(self.grams.get, grams(word)) if i is not None]
        shape = np.mean(g, axis=0) if g else np.zeros(len(LANGS))
        i = self.words.get(word)
        if i is None:
            return shape
        trust = self.seen[i] / (self.seen[i] + 3)
        return trust * self.by_word[i] + (1 - trust) * shape


class Scores(dict):
    def __init__(self, model: Model, limit: int = 200_000):
        super().__init__()
        self.model, self.limit, self.rows = model, limit, []

    def __missing__(self, word: str) -> int:
        if len(self.rows) % 8192 == 0:
            self.table = None
        self.rows.append(self.model.score(word))
        i = self[word] = len(self.rows) - 1
        return i


def _count(docs: list[list[list[str]]], tags: list[list[int]]) -> Model:
    w, g = {}, {}
    for sents, tag in zip(docs, tags):
        for s, t in zip(sents, tag):
            if t >= 0:
                for x in s:
                    if not x.isdigit():
                        w.setdefault(x, np.zeros(len(LANGS)))[t] += 1
    for x, c in w.items():
        c = np.sqrt(c)  # a name that occurs a thousand times says no more of spelling than a few words
        for y in grams(x):
            g.setdefault(y, np.zeros(len(LANGS)))
            g[y] += c
    if not w:
        return Model(np.ones((1, len(LANGS))), ["-"], np.ones((1, len(LANGS))), ["<-"])
    return Model(np.array(list(w.values())), list(w), np.array(list(g.values())), list(g))


def train(rows: list[tuple[str, str]], rounds: int = 3) -> Model:
    """Likelihoods from (text, label) rows whose labels are partly wrong: after the first round a sentence counts for the
    language that the counts so far give it, if they are sure."""
    docs = [[WORD.findall(t[a:b].lower()) for a, b in sentences(t)] for t in (tidy(x) for x, _ in rows)]
    tags = [[LANGS.index(y)] * len(d) for d, (_, y) in zip(docs, rows)]
    model = _count(docs, tags)
    for _ in range(rounds):
        cache: dict[str, np.ndarray] = {}
        for d, tag in zip(docs, tags):
            for k, s in enumerate(d):
                z = sum((cache[x] if x in cache else cache.setdefault(x, model.score(x)) for x in s), np.zeros(len(LANGS)))
                best = np.sort(z)
                tag[k] = int(np.argmax(z)) if len(s) >= MIN_WORDS and best[-1] - best[-2] > 3 else -1
        model = _count(docs, tags)
    return model


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, limit: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """About ``limit`` labelled texts at most by the hash of their id, each language up to its equal part."""
    t = df.select(F.col(text_col).alias("text"), label(F.col(lang_col)).alias("code"), F.xxhash64(F.lit(17), id_col).alias("h"))
    each = limit // len(LANGS)
    n = {r[0]: r[1] for r in t.where(F.col("code").isin(*LANGS)).groupBy("code").count().collect()}  # a row a language
    low = F.lit(False)
    for code, c in n.items():
        low = low | ((F.col("code") == code) & (F.col("h") < F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * each / c))).cast("long")))
    rows = t.where(low & F.length("text").between(100, 4_000)).orderBy("h", "text").collect()  # about ``limit`` at most
    return [(r["text"], r["code"]) for r in rows]


def host_priors(df: DataFrame, lang_col: str, host_cols: list[str]) -> DataFrame:
    """Log prior of each language for each host (values of ``host_cols``), smoothed from the one-column host to the whole, by
    grouped aggregation over all documents."""
    code = label(F.col(lang_col))
    counts = [F.sum((code == x).cast("double")).alias(x) for x in LANGS]
    fine = df.groupBy(*host_cols).agg(*counts)
    coarse = fine.groupBy(host_cols[0]).agg(*[F.sum(x).alias(f"c_{x}") for x in LANGS])
    whole = fine.agg(*[F.sum(x).alias(f"w_{x}") for x in LANGS])
    n = lambda p: sum((F.coalesce(F.col(p + x), F.lit(0.0)) for x in LANGS), F.lit(0.0))
    j = fine.join(coarse.withColumnRenamed(host_cols[0], "_host"), F.col(host_cols[0]).eqNullSafe(F.col("_host"))).crossJoin(whole)  # one row
    prior = []
    for x in LANGS:
        w = (F.coalesce(F.col("w_" + x), F.lit(0.0)) + 1) / (n("w_") + len(LANGS))
        c = (F.coalesce(F.col("c_" + x), F.lit(0.0)) + SMOOTH * w) / (n("c_") + SMOOTH)
        prior.append(F.log((F.coalesce(F.col(x), F.lit(0.0)) + SMOOTH * c) / (n("") + SMOOTH)))
    return j.select(*host_cols, F.array(*prior).alias("prior"))


def _judge(model: Model):
    """Sentences of each text with the posterior of each language."""
    index = {x: i for i, x in enumerate(LANGS)}

    def run(batches):
        cache = Scores(model)
        table = np.empty((0, len(LANGS)))
        for pdf in sliced(batches):
            if len(cache) > cache.limit:
                cache, table = Scores(model), np.empty((0, len(LANGS)))
            spans, words, counts, owner, ended = [], [], [], [], []
            base = np.zeros((len(pdf), len(LANGS)))
            for k, (t, code, prior) in enumerate(zip(pdf["text"], pdf["code"], pdf["prior"])):
                t = tidy(t)
                base[k] = prior
                if code in index:
                    base[k, index[code]] += DECLARED
                for m in set(x.lower() for x in _ADDRESS.findall(t)):
                    for x in SUFFIXES[m]:
                        base[k, index[x]] += SUFFIX
                for a, b in sentences(t):
                    w = WORD.findall(t[a:b].lower())
                    if w:
                        spans.append((k, a, b))
                        words.append(w)
                        counts.append(len(w))
                        owner.append(k)
                        ended.append(t[a:b].rstrip("\"'»”) \u00a0\t")[-1:] in ".!?…:;")
            if not spans:
                continue
            n = sum(counts)
            at = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.int64, n)
            if len(cache.rows) > len(table):
                table = np.array(cache.rows)
            edge = np.concatenate(([0], np.cumsum(counts)[:-1]))
            like = np.add.reduceat(table[at], edge, axis=0) * TEMPER
            owner, counts = np.array(owner), np.array(counts)
            z = like + base[owner]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            whole = np.zeros((len(pdf), len(LANGS)))
            np.add.at(whole, owner, like)
            whole = base + whole * 0.25
            whole -= whole.max(axis=1, keepdims=True)
            whole = np.exp(whole)
            whole /= whole.sum(axis=1, keepdims=True)
            plain = np.fromiter((sum(not x.isdigit() for x in w) for w in words), np.int64, len(words))
            full = (plain >= MIN_WORDS) & (np.array(ended) | (plain >= UNMARKED_WORDS))
            best = p.argmax(axis=1)
            yield pd.DataFrame({
                "id": pdf["id"].to_numpy()[owner], "start": [s[1] for s in spans], "end": [s[2] for s in spans], "n_words": counts,
                "lang": np.array(LANGS)[best], "confidence": p.max(axis=1), "margin": np.sort(like, axis=1)[:, -1] - np.sort(like, axis=1)[:, -2], "full": full,
                "doc_lang": np.array(LANGS)[whole.argmax(axis=1)][owner], "doc_confidence": whole.max(axis=1)[owner], "code": pdf["code"].to_numpy()[owner],
            })

    return run


_SENTENCES = "id long, start int, end int, n_words int, lang string, confidence double, margin double, full boolean, doc_lang string, doc_confidence double, code string"
_PASSAGES = "id long, passage int, lang string, confidence double, start int, end int, doc_lang string, doc_confidence double"


def judged(df: DataFrame, id_col: str, text_col: str, lang_col: str, host_cols: list[str], by_passage: bool = False) -> DataFrame:
    """Every sentence of every text with its language, confidence and whether it counts as a full sentence; or every passage.

    Null and blank texts have none.
    """
    model = train(sample(df, id_col, text_col, lang_col))
    hosts = [F.col(c).alias(f"_h{k}") for k, c in enumerate(host_cols)]
    priors = staged(host_priors(df, lang_col, host_cols).select(*hosts, "prior"), "priors")  # of known size: Spark broadcasts it if it is small
    t = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label(F.col(lang_col)).alias("code"), *[F.col(c).alias(f"_t{k}") for k, c in enumerate(host_cols)]).where("text is not null")
    t = spread(t)  # the scan, not the join
    on = [F.col(f"_t{k}").eqNullSafe(F.col(f"_h{k}")) for k in range(len(host_cols))]
    t = t.join(priors, on).select("id", "text", "code", "prior")
    judge = _judge(model)
    if by_passage:  # a frame holds whole documents
        return t.mapInPandas(lambda batches: map(_runs, judge(batches)), _PASSAGES)
    return t.mapInPandas(judge, _SENTENCES)


def unnamed_languages(df: DataFrame, id_col: str, text_col: str, lang_col: str, host_cols: list[str], sure: float = SURE) -> DataFrame:
    """(id, lang_found): languages in which a full sentence is written and which the label does not name, each once a document."""
    s = judged(df, id_col, text_col, lang_col, host_cols)
    return s.where(F.col("full") & (F.col("confidence") >= sure) & (F.col("code").isNull() | (F.col("code") != F.col("lang")))).select("id", F.col("lang").alias("lang_found")).distinct()


def passages(df: DataFrame, id_col: str, text_col: str, lang_col: str, host_cols: list[str]) -> DataFrame:
    """Runs of sentences of one language: (id, passage, lang, confidence, start, end, doc_lang, doc_confidence).

    Short pieces (headings, names) go with the passage before them, or at a text's beginning with the next. Texts without words have none.
    """
    return judged(df, id_col, text_col, lang_col, host_cols, by_passage=True)


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    keep = (pdf["full"] & (pdf["confidence"] >= 0.5)).to_numpy()
    lang = pdf["lang"].where(keep, None)
    g = pdf["id"].ne(pdf["id"].shift()) | pdf["start"].lt(pdf["start"].shift())
    doc = g.cumsum()
    lang = lang.groupby(doc).ffill().groupby(doc).bfill().fillna(pdf["doc_lang"])
    new = (lang != lang.shift()) | (doc != doc.shift())
    run = new.cumsum()
    x = pd.DataFrame({"id": pdf["id"], "doc": doc, "lang": lang, "confidence": pdf["confidence"].where(keep), "start": pdf["start"], "end": pdf["end"], "doc_lang": pdf["doc_lang"], "doc_confidence": pdf["doc_confidence"], "run": run})
    out = x.groupby("run").agg(id=("id", "first"), doc=("doc", "first"), lang=("lang", "first"), confidence=("confidence", "mean"), start=("start", "min"), end=("end", "max"), doc_lang=("doc_lang", "first"), doc_confidence=("doc_confidence", "first"))
    out["passage"] = out.groupby("doc").cumcount() + 1
    out["confidence"] = out["confidence"].fillna(out["doc_confidence"])
    return out[["id", "passage", "lang", "confidence", "start", "end", "doc_lang", "doc_confidence"]]
