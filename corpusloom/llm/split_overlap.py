"""Problem 2: the same or nearly the same records across splits.

Method: compressed full-text index of evaluation shards. The distinct evaluation texts are cut into shards of close
size; each shard is a word-level index (Burrows-Wheeler order of all suffixes, position lists for rank, the text of
each row). A training text is streamed only through the shards that can hold a partner: an exchange of windows by
their hash tells in how many evaluation texts each stands; a training text too few of whose windows stand in any has
no partner, and as texts of the threshold's likeness have one of their rarest windows in common, the others meet the
shards on those. Backward search gives the interval of each window; a text covered too little is out, of the others the rarest windows are
located and the partners counted from the intervals. For the pairs that remain backward search is carried on word by
word inside the partner to its maximal matches, which are merged to spans and counts.
"""

from __future__ import annotations

import io
import math
import secrets

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.wordkit import WordHashes, distinct_in_text, flat_words, sequences, sliced, words
from corpusloom.llm.classes import class_of, expand
from corpusloom.session import spread, staged

MIN_WORDS = 40
WINDOW = 5
#: Words of one evaluation shard; a shard in use takes about 40 bytes a word.
SHARD_WORDS = 300_000
#: Training words searched at once in a shard; a shard with more is read by several tasks.
HOLD_WORDS = 1_500_000
#: A text and a shard are to meet on one window and another for each so many of the text's.
MEETINGS = 20
#: Windows of one part of the exchange that tells how many evaluation texts have a window.
PART_WINDOWS = 1_000_000


# --- index ----------------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` by prefix doubling; after each round only the ties are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    slot = np.arange(n)
    new = np.ones(n, bool)
    s = text[order]
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
    k = 1
    while True:
        single = new & np.concatenate((new[1:], [True]))
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        at = order[tied]
        then = at + k
        key = rank[at] * np.int64(n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        new[tied] = first
        rank[order[tied]] = np.maximum.accumulate(np.where(first, tied, 0))
        k *= 2


def build_index(h: np.ndarray, lens: np.ndarray, cls: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Index of texts given as flat word hashes; each text has an end mark of its own, so that no match passes an end."""
    vocab, sym = np.unique(h, return_inverse=True)
    d = len(lens)
    at = np.arange(len(h)) + np.repeat(np.arange(d), lens)
    text = np.zeros(len(h) + d, np.int64)
    text[at] = sym + d
    text[np.cumsum(lens) + np.arange(d)] = np.arange(d)
    doc = np.repeat(np.arange(d, dtype=np.int32), lens + 1)
    order = suffix_order(text)
    before = np.maximum(text[order - 1] - d + 1, 0)  # the Burrows-Wheeler transform: 0 for any end mark
    lists = np.argsort(before, kind="stable")
    counts = np.bincount(before, minlength=len(vocab) + 1)
    return {"vocab": vocab, "lists": lists, "counts": counts, "doc": doc[order], "cls": cls.astype(np.int64), "sizes": sizes.astype(np.int64)}


def pack(index: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    x = dict(index)
    x["lists"] = np.diff(x["lists"], prepend=0).astype(np.int32)  # small steps inside a symbol's list
    x["counts"] = x["counts"].astype(np.uint32)
    np.savez(out, **x)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    x = dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))))
    lists = np.cumsum(x.pop("lists").astype(np.int64)).astype(np.uint64)
    symbol = np.repeat(np.arange(len(x["counts"]), dtype=np.uint64), x["counts"])
    x["rank"] = (symbol << np.uint64(32)) | lists  # searching (c, i) gives the rows before c's block + rank of c before i
    doc = x["doc"].astype(np.uint64)
    x["of"] = np.sort((doc << np.uint64(32)) | np.arange(len(doc), dtype=np.uint64))  # rows of each text
    return x


def symbols(x: dict, h: np.ndarray) -> np.ndarray:
    """Symbols of word hashes; 0 for words that the shard lacks."""
    at = np.searchsorted(x["vocab"], h)
    at[at == len(x["vocab"])] = 0
    return np.where(x["vocab"][at] == h, at + 1, 0).astype(np.uint64)


def before(x: dict, c: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One step of backward search: the row that ``row`` becomes when the symbol ``c`` is put before."""
    return np.searchsorted(x["rank"], (c << np.uint64(32)) | row.astype(np.uint64))


def holds(x: dict, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether the rows [lo, hi) have one of the text ``doc``."""
    d = doc.astype(np.uint64) << np.uint64(32)
    return np.searchsorted(x["of"], d | hi.astype(np.uint64)) > np.searchsorted(x["of"], d | lo.astype(np.uint64))


def backward(x: dict, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the windows that begin at ``start``; (0, 0) where the shard has none."""
    lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    alive = np.ones(len(start), bool)
    for k in range(WINDOW):
        alive &= sym[start + k] > 0
    live = np.flatnonzero(alive)
    a, b = np.zeros(len(live), np.int64), np.full(len(live), len(x["rank"]))
    for k in range(WINDOW - 1, -1, -1):
        c = sym[start[live] + k]
        order = np.argsort((c << np.uint64(32)) | a.astype(np.uint64))  # in order, neighbouring searches touch the same part of the index
        live, c, a, b = live[order], c[order], a[order], b[order]
        a, b = before(x, c, a), before(x, c, b)
        ok = a < b
        live, a, b = live[ok], a[ok], b[ok]
    lo[live], hi[live] = a, b
    return lo, hi


def maximal_matches(x: dict, sym: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, start, end) of left-maximal matches of WINDOW words or more between the words [first, last) and the text ``doc``.

    All pairs are extended side by side, word by word from their end; where a match can't be extended, the next begins
    so that it may hold the word in the way. Together they cover all that maximal matches cover.
    """
    end = last - 1
    pos, lo, hi = end.copy(), np.zeros(len(end), np.int64), np.full(len(end), len(x["rank"]))
    live = np.flatnonzero(end - first >= WINDOW - 1)
    out = []
    while len(live):
        p = pos[live]
        inside = p >= first[live]
        c = np.where(inside, sym[np.maximum(p, 0)], np.uint64(0))
        a, b = before(x, c, lo[live]), before(x, c, hi[live])
        ok = (c > 0) & (a < b)
        ok[ok] = holds(x, doc[live[ok]], a[ok], b[ok])
        go = live[ok]
        lo[go], hi[go] = a[ok], b[ok]
        pos[go] -= 1
        stop = live[~ok]
        long = stop[end[stop] - pos[stop] >= WINDOW]
        if len(long):
            out.append((long, pos[long] + 1, end[long] + 1))
        end[stop] = np.where(pos[stop] < first[stop], -1, np.minimum(end[stop] - 1, pos[stop] + WINDOW - 1))
        pos[stop], lo[stop], hi[stop] = end[stop], 0, len(x["rank"])
        live = live[end[live] - first[live] >= WINDOW - 1]
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*out))


def merged(n: int, pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` pairs: spans after overlapping matches are merged, and words in them."""
    order = np.lexsort((a, pair))
    pair, a, b = pair[order], a[order], b[order]
    far = np.maximum.accumulate(b + pair * np.int64(1 << 40)) - pair * np.int64(1 << 40)  # farthest end so far in the pair
    far = np.concatenate(([0], far[:-1]))
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (a[1:] > far[1:])
    fresh = np.maximum(0, b - np.maximum(a, np.where(new, a, far)))
    return np.bincount(pair[new], minlength=n), np.bincount(pair, fresh, minlength=n).astype(np.int64)


def stream(x: dict, h: np.ndarray, lens: np.ndarray, cls: np.ndarray, threshold: float) -> pd.DataFrame:
    """Partners (a, b, likeness, n_spans, n_words) of training texts, given as flat word hashes, in one shard."""
    kinds, word = np.unique(h, return_inverse=True)
    sym = symbols(x, kinds)[word]
    starts = np.cumsum(lens) - lens
    seq, doc = sequences(h, lens, WINDOW)
    at = np.arange(len(h)) - np.repeat(starts, lens)
    place = np.flatnonzero(at < np.repeat(lens - WINDOW + 1, lens))
    order = np.lexsort((seq, doc))  # stable: the first of equal windows comes first
    s, d = seq[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    place, d = place[order][keep], d[keep]
    n = np.bincount(d, minlength=len(lens))
    need = np.ceil(threshold * n - 1e-9).astype(np.int64)
    lo, hi = backward(x, sym, place)
    covered = np.bincount(d[hi > lo], minlength=len(lens))
    bound = np.concatenate(([0], np.cumsum(n)))
    ta, tb = [], []
    for t in np.flatnonzero((covered >= need) & (need > 0)):
        a, size = lo[bound[t] : bound[t + 1]], (hi - lo)[bound[t] : bound[t + 1]]
        rare = np.argsort(size, kind="stable")[: n[t] - need[t] + 1]  # any partner has at least one of these
        rare = rare[size[rare] > 0]
        if len(rare):
            hits = np.unique(x["doc"][np.repeat(a[rare] - np.concatenate(([0], np.cumsum(size[rare])[:-1])), size[rare]) + np.arange(int(size[rare].sum()))])
            hits = hits[(x["sizes"][hits] >= threshold * n[t] - 1e-9) & (x["sizes"][hits] * threshold <= n[t] + 1e-9)]
            ta.append(np.full(len(hits), t))
            tb.append(hits.astype(np.int64))
    names = ["a", "b", "likeness", "n_spans", "n_words"]
    if not ta:
        return pd.DataFrame({c: np.empty(0, np.float64 if c == "likeness" else np.int64) for c in names})
    ta, tb = np.concatenate(ta), np.concatenate(tb)
    both = np.zeros(len(ta), np.int64)
    for k in range(0, len(ta), 2_000):  # windows that the partner has, counted from their intervals
        t, e = ta[k : k + 2_000], tb[k : k + 2_000]
        w = np.repeat(bound[t] - np.cumsum(n[t]) + n[t], n[t]) + np.arange(int(n[t].sum()))
        of = np.repeat(np.arange(len(t)), n[t])
        ok = hi[w] > lo[w]
        w, of = w[ok], of[ok]
        both[k : k + 2_000] = np.bincount(of[holds(x, e[of], lo[w], hi[w])], minlength=len(t))
    like = both / (n[ta] + x["sizes"][tb] - both)
    good = like >= threshold - 1e-12
    ta, tb, like = ta[good], tb[good], like[good]
    spans, covers = merged(len(ta), *maximal_matches(x, sym, starts[ta], starts[ta] + lens[ta], tb))
    return pd.DataFrame(dict(zip(names, (cls[ta], x["cls"][tb], like, spans, covers))))


# --- texts, shards and their meeting --------------------------------------------------------------------------


def _members(batches):
    """Class of each text; the first row of a frame also has the frame's slice: the words of the texts that are new in the task."""
    cache, seen = WordHashes(), set()
    for pdf in sliced(batches):
        for ev in (True, False):
            ids, cls, texts, new = [], [], [], []
            part = pdf[pdf["ev"] == ev]
            for i, t in zip(part["rec_id"], part["text"]):
                w = words(t)
                if len(w) < MIN_WORDS:
                    continue
                c = class_of(w)
                ids.append(i)
                cls.append(c)
                if (c, ev) not in seen:
                    seen.add((c, ev))
                    new.append(c)
                    texts.append(w)
            if not ids:
                continue
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            h = (np.fromiter((cache[x] for w in texts for x in w), np.uint64, int(lens.sum())) >> np.uint64(32)).astype(np.uint32)
            rest = [None] * (len(ids) - 1)
            yield pd.DataFrame({
                "rec_id": ids, "cls": cls, "ev": ev, "size": [len(h), *[0] * len(rest)],
                "slice": [secrets.randbits(62), *rest] if texts else [None, *rest],
                "words": [h.tobytes() if texts else None, *rest], "lens": [lens.astype(np.int32).tobytes() if texts else None, *rest], "of": [np.array(new, np.int64).tobytes() if texts else None, *rest],
            }).astype({"slice": "Int64"})


def _slice(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their numbers, and the distinct windows of each text of a slice with their text's number; texts' numbers of windows."""
    h, lens = np.frombuffer(row["words"], np.uint32), np.frombuffer(row["lens"], np.int32).astype(np.int64)
    return h, lens, *distinct_in_text(*sequences(h.astype(np.uint64), lens, WINDOW), len(lens))


def _ask(bits: int):
    """Rows (part, slice, ev, w, c): the distinct windows of each slice by the first bits of their hash, 32 bits of each, and
    in how many of the slice's texts they stand."""

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                u, c = np.unique(_slice(row)[2], return_counts=True)
                part = (u >> np.uint64(64 - bits)).astype(np.int64)
                edge = np.searchsorted(part, np.arange((1 << bits) + 1))
                w, c = ((u >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(c, 255).astype(np.uint8)
                some = np.flatnonzero(np.diff(edge))
                yield pd.DataFrame({"part": some, "slice": row["slice"], "ev": row["ev"], "w": [w[edge[p] : edge[p + 1]].tobytes() for p in some], "c": [c[edge[p] : edge[p + 1]].tobytes() for p in some]})

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the windows of each row a byte: a level of their number of evaluation texts (0: none), and the top bit if training has them."""
    w = np.frombuffer(b"".join(pdf["w"]), np.uint32)
    c = np.frombuffer(b"".join(pdf["c"]), np.uint8)
    size = pdf["w"].map(len).to_numpy() // 4
    ev = np.repeat(pdf["ev"].to_numpy(bool), size)
    kinds, at = np.unique(w, return_inverse=True)
    n = np.bincount(at, np.where(ev, c, 0), minlength=len(kinds))
    trained = np.zeros(len(kinds), bool)
    trained[at[~ev]] = True
    level = np.where(n > 0, np.minimum(127, 1 + 4 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8) | (trained.astype(np.uint8) << np.uint8(7))
    said, edge = level[at].tobytes(), np.concatenate(([0], np.cumsum(size))).tolist()
    return pd.DataFrame({"slice": pdf["slice"], "part": pdf["part"], "said": [said[a:b] for a, b in zip(edge, edge[1:])]})


def _meet(threshold: float):
    """Texts (words not null) and the windows on which they can meet a partner (key not null).

    A training text of which too few windows stand in any evaluation text has no partner and is left out. Windows are
    ordered by their level, rare first. Of the first n - need + k windows of each of two texts of enough likeness k are
    the same; k grows with the text, so that a chance meeting is not enough.
    """

    def run(slices: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"key": pd.array([], "Int64"), "cls": np.empty(0, np.int64), "n": np.empty(0, np.int64), "ev": np.empty(0, bool), "words": []})]
        for row in slices.to_dict("records"):
            h, lens, seq, doc, n = _slice(row)
            cls, edge = np.frombuffer(row["of"], np.int64), np.concatenate(([0], np.cumsum(lens)))
            _, at = np.unique(seq, return_inverse=True)
            byte = np.frombuffer(b"".join(said.sort_values("part")["said"]), np.uint8)[at]
            level, both = byte & np.uint8(127), byte > 128
            need = np.ceil(threshold * n - 1e-9).astype(np.int64)
            first = n - need + 1 + n // MEETINGS
            mine = np.ones(len(n), bool) if row["ev"] else np.bincount(doc[level > 0], minlength=len(n)) >= need
            order = np.lexsort((seq, level, doc))
            place = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
            keep = order[(place < np.repeat(first, n)) & mine[doc] & both[order]]
            t = np.flatnonzero(mine)
            out.append(pd.DataFrame({"key": pd.array([None] * len(t), "Int64"), "cls": cls[t], "n": n[t], "ev": row["ev"], "words": [h[edge[k] : edge[k + 1]].tobytes() for k in t]}))
            out.append(pd.DataFrame({"key": pd.array(seq[keep].view(np.int64), "Int64"), "cls": cls[doc[keep]], "n": n[doc[keep]], "ev": row["ev"], "words": None}))
        return pd.concat(out, ignore_index=True)

    return run


def _flat(blobs) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    return np.frombuffer(b"".join(blobs), np.uint32).astype(np.uint64), lens


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("cls")
    h, lens = _flat(pdf["words"])
    return pd.DataFrame({"shard": pdf["shard"][:1], "index": [pack(build_index(h, lens, pdf["cls"].to_numpy(), pdf["n"].to_numpy()))]})


def _search_shard(threshold: float):
    def run(texts: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(index):
            return pd.DataFrame({c: np.empty(0, np.float64 if c == "likeness" else np.int64) for c in ("a", "b", "likeness", "n_spans", "n_words")})
        texts = texts.drop_duplicates("cls")
        return stream(unpack(index["index"].iloc[0]), *_flat(texts["words"]), texts["cls"].to_numpy(), threshold)

    return run


_FOUND = "a long, b long, likeness double, n_spans long, n_words long"


def overlapping_classes(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.7, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members: rec_id, cls, ev) and (pairs of classes: a of training, b of evaluation, likeness, n_spans, n_words).

    A class is a word sequence. No pair of classes of likeness ``threshold`` or more is lost; null, empty and short
    texts (under 40 words) and records of other or null splits are in neither. Training work is proportional to the
    training texts and to the meetings of their rarest windows with shards, not to the number of shards.
    """
    spark = df.sparkSession
    t = spread(df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text"), F.col(split_col).alias("split")))
    t = t.where(F.col("text").isNotNull() & F.col("split").isin(train, *evaluation)).select("rec_id", "text", (F.col("split") != train).alias("ev"))
    base = staged(t.mapInPandas(_members, "rec_id long, cls long, ev boolean, size long, slice long, words binary, lens binary, of binary"), "members")
    members = base.select("rec_id", "cls", "ev")
    total = base.agg(F.sum("size"), F.max("ev")).first()
    if not total[0] or not total[1]:
        return members, spark.createDataFrame([], _FOUND)
    bits = min(24, max(4, math.ceil(math.log2(total[0] / PART_WINDOWS))))
    slices = base.where("slice is not null").select("slice", "ev", "words", "lens", "of")
    said = slices.drop("of").mapInPandas(_ask(bits), "part long, slice long, ev boolean, w binary, c binary").groupBy("part").applyInPandas(_answer, "slice long, part long, said binary")
    met = slices.groupBy("slice").cogroup(said.groupBy("slice")).applyInPandas(_meet(threshold), "key long, cls long, n long, ev boolean, words binary")
    met = staged(met, "met")
    ev, tr = met.where("ev"), met.where("not ev")
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / threshold)).cast("int")  # partners lie in neighbouring bands
    sizes = ev.where("words is not null").groupBy(band.alias("band")).agg(F.sum(F.length("words") / 4).alias("w")).collect()  # a row for each doubling of the size, about
    parts = F.create_map(*[F.lit(int(v)) for r in sizes for v in (r["band"], max(1, math.ceil(r["w"] / shard_words)))])
    shard = (band.cast("long") * 1_000_000 + F.pmod(F.xxhash64("cls"), parts[band])).alias("shard")
    index = ev.where("words is not null").select(shard, "cls", "n", "words").groupBy("shard").applyInPandas(_index_shard, "shard long, index binary")
    of_shards = ev.where("key is not null").select("key", band.alias("b"), shard).distinct()
    meet = tr.where("key is not null").select("key", "cls", "n", band.alias("band")).join(of_shards, "key").where(F.abs(F.col("band") - F.col("b")) <= 1)
    met_often = meet.groupBy("cls", "shard").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(F.col("k") > F.floor(F.floor(F.col("n") * threshold) / MEETINGS))
    sent = staged(met_often.select("cls", "shard").join(tr.where("words is not null").select("cls", "words"), "cls"), "sent")
    load = sent.groupBy("shard").agg(F.ceil(F.sum(F.length("words") / 4) / HOLD_WORDS).alias("k"))
    sent = sent.join(load, "shard").select("shard", F.pmod(F.xxhash64("cls"), F.col("k")).alias("part"), "cls", "words")
    at = index.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"), "index")
    found = sent.groupBy("shard", "part").cogroup(at.groupBy("shard", "part")).applyInPandas(_search_shard(threshold), _FOUND)
    return members, staged(found.dropDuplicates(["a", "b"]), "overlaps")


def cross_split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), threshold: float = 0.7, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Pairs (train_id, eval_id, likeness, n_spans, n_words) of a training and an evaluation record of likeness ``threshold`` or more.

    ``n_spans`` and ``n_words`` count the merged matches of the training text in the evaluation text. Null, empty and short texts (under 40 words) and records of other or null splits have no
    partner. Copies are indexed and streamed once. Pairs of classes of more than EXPAND_LIMIT record pairs come as
    stars; ``overlapping_classes`` has them exactly.
    """
    members, found = overlapping_classes(df, id_col, text_col, split_col, train, evaluation, threshold, shard_words)
    pairs = expand(found, members.where("not ev").select("cls", "rec_id"), members.where("ev").select("cls", "rec_id"))
    return pairs.select(F.col("l").alias("train_id"), F.col("r").alias("eval_id"), "likeness", "n_spans", "n_words")


def overlap_counts(pairs: DataFrame, df: DataFrame, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """Pairs and records that overlap, for each evaluation split and source (null sources are a group of their own)."""
    ev = df.select(F.col(id_col).alias("eval_id"), F.col(split_col).alias("split"), F.col(source_col).alias("source"))
    return (
        pairs.join(ev, "eval_id")
        .groupBy("split", "source")
        .agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"), F.sum(F.when(F.col("likeness") == 1, 1).otherwise(0)).alias("equal_pairs"))
    )
