"""Problem 7: encoding the whole corpus with a public byte-level BPE tokenizer.

Method: corpus-level merge replay. Documents are written as numbers of their block's pre-tokens; the corpus's distinct
pre-tokens are spread by hash, and each share is laid out as one sequence of byte symbols with an inverted index from
symbol pair to positions; merges are applied in rank order, each to all its positions at once, touching only the
neighbours of a merged place. So every pre-token of the corpus is merged once. Its ids go back to the blocks that have
it, where a document's ids are gathered from its pre-tokens'. Nothing is broadcast but the path of the vocabulary file.
"""

from __future__ import annotations

import json
import re
import secrets
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.session import spread, staged

TOKENIZERS = "/opt/tokenizers"
#: Distinct pre-tokens that a task keeps; beyond that it starts anew.
KEEP_WORDS = 600_000
#: Characters of the documents of one block, which are gathered in one task.
BLOCK_CHARS = 24_000_000

# The tokenizer's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EXACT = regex.compile(PATTERN.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: The same for texts without the few characters that the two regex libraries class differently.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(1)
def _odd() -> frozenset[str]:
    """Numbers that are no decimal digits, and the control characters that only one library calls white space."""
    every = map(chr, range(sys.maxunicode + 1))
    return frozenset("\x1c\x1d\x1e\x1f") | {c for c in every if unicodedata.category(c) in ("Nl", "No") or (c.isnumeric() and unicodedata.category(c)[0] not in "NL")}


def pre_tokens(texts: list[str | None]) -> list[list[str]]:
    """Pre-tokens of each text; none for a null or empty one."""
    odd = _odd() & set().union(*map(set, filter(None, texts)))
    return [(_EXACT if odd and not odd.isdisjoint(t) else _FAST).findall(t) if t else [] for t in texts]


@lru_cache(4)
def load(path: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Ids of the 256 bytes, and (left id << 32 | right id) -> (rank, merged id)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare, names = iter(range(256, 512)), []
    for b in range(256):  # a printable byte is written as itself, any other as the next character from 256 on
        names.append(chr(b if b in plain else next(spare)))
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
    return [vocab[c] for c in names], merges


def replay(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each has."""
    byte_ids, merges = load(path)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    sym = [byte_ids[b] for b in chain.from_iterable(raw)]
    n = len(sym)
    ends = np.cumsum(sizes)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    for e in ends.tolist():
        if e:
            nxt[e - 1] = -1
            if e < n:
                prv[e] = -1
    index: dict[int, list[int]] = {}  # pair -> positions of its left symbol
    for p in range(n):
        q = nxt[p]
        if q >= 0:
            pair = sym[p] << 32 | sym[q]
            if pair in merges:
                index.setdefault(pair, []).append(p)
    heap = [(merges[pair][0], pair) for pair in index]
    heapify(heap)
    while heap:
        _, pair = heappop(heap)
        places = index.pop(pair, None)
        if places is None:
            continue
        a, b, new = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
        places.sort()
        for p in places:
            q = nxt[p]
            if sym[p] != a or q < 0 or sym[q] != b:  # a neighbour's merge has taken it
                continue
            sym[p], sym[q] = new, -1
            r, o = nxt[q], prv[p]
            nxt[p] = r
            if r >= 0:
                prv[r] = p
                near = new << 32 | sym[r]
                if near in merges:
                    if near not in index:
                        index[near] = []
                        heappush(heap, (merges[near][0], near))
                    index[near].append(p)
            if o >= 0:
                near = sym[o] << 32 | new
                if near in merges:
                    if near not in index:
                        index[near] = []
                        heappush(heap, (merges[near][0], near))
                    index[near].append(o)
    left = np.array(sym, np.int64)
    alive = left >= 0
    counts = np.add.reduceat(np.concatenate((alive, [False])).astype(np.int64), np.minimum(ends - sizes, n)) if len(sizes) else np.zeros(0, np.int64)
    counts[sizes == 0] = 0
    return left[alive].astype(np.int32), counts


class Encoder:
    """Ids of texts; distinct pre-tokens are merged once."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > KEEP_WORDS:
            self.clear()
        each = pre_tokens(texts)
        lens = np.fromiter(map(len, each), np.int64, len(each))
        number, known = self.number, len(self.number)
        for w in set(chain.from_iterable(each)):
            if w not in number:
                number[w] = len(number)
        new = list(number)[known:]
        if new:
            ids, counts = replay(new, self.path)
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(counts) - counts))
            self.ids, self.count = np.concatenate((self.ids, ids)), np.concatenate((self.count, counts))
        return np.fromiter(map(number.__getitem__, chain.from_iterable(each)), np.int64, int(lens.sum())), lens

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        at, lens = self._numbers(texts)
        total = np.concatenate(([0], np.cumsum(self.count[at])))
        edge = np.concatenate(([0], np.cumsum(lens)))
        return total[edge[1:]] - total[edge[:-1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of the texts."""
        at, lens = self._numbers(texts)
        n = self.count[at]
        total = np.cumsum(n)
        place = np.repeat(self.start[at] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
        edge = np.concatenate(([0], np.cumsum(lens)))
        return self.ids[place], np.concatenate(([0], total))[edge]


def _slices(batch: pa.RecordBatch, rows: int = 2_000):
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _numbered(kind: pa.DataType):
    """Rows (block, id, at): each document as numbers of its block's pre-tokens; and (block, n, word): those pre-tokens."""
    names = ["block", "_id", "at", "n", "word"]

    def rows(size: int, block: int, **given) -> pa.RecordBatch:
        types = dict(zip(names, (pa.int64(), kind, pa.binary(), pa.int32(), pa.string())))
        given["block"] = pa.array(np.full(size, block), pa.int64())
        return pa.RecordBatch.from_arrays([given[c].cast(types[c]) if c in given else pa.nulls(size, types[c]) for c in names], names)

    def run(batches):
        number, block, held = {}, secrets.randbits(62), 0
        for whole in batches:
            for b in _slices(whole):
                texts = b.column(1).to_pylist()
                each = pre_tokens(texts)
                for w in set(chain.from_iterable(each)):
                    if w not in number:
                        number[w] = len(number)
                at = [np.fromiter(map(number.__getitem__, t), np.int32, len(t)).tobytes() for t in each]
                yield rows(b.num_rows, block, _id=b.column(0), at=pa.array(at, pa.binary()))
                held += sum(map(len, filter(None, texts)))
                if held > BLOCK_CHARS:
                    yield rows(len(number), block, n=pa.array(np.arange(len(number)), pa.int32()), word=pa.array(list(number), pa.string()))
                    number, block, held = {}, secrets.randbits(62), 0
        if number:
            yield rows(len(number), block, n=pa.array(np.arange(len(number)), pa.int32()), word=pa.array(list(number), pa.string()))

    return run


def _merged(path: str):
    """Rows (word, ids) of distinct pre-tokens; a task's share is merged at once, in parts of ``KEEP_WORDS``."""

    def merge(words: list[str]) -> pa.RecordBatch:
        ids, counts = replay(words, path)
        edge = np.concatenate(([0], np.cumsum(counts))).tolist()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([ids[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary())], ["word", "ids"])

    def run(batches):
        words: list[str] = []
        for b in batches:
            words += b.column(0).to_pylist()
            if len(words) >= KEEP_WORDS:
                yield merge(words)
                words = []
        if words:
            yield merge(words)

    return run


def _gather():
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        flat = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.int32)
        size = lambda c: pc.binary_length(c).to_numpy().astype(np.int64) // 4
        words = words.sort_by("n")
        ids, count = flat(words["ids"]), size(words["ids"])
        start = np.cumsum(count) - count
        at = flat(docs["at"])
        n = count[at]
        total = np.cumsum(n)
        place = np.repeat(start[at] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
        edge = np.concatenate(([0], np.cumsum(size(docs["at"]))))
        offsets = np.concatenate(([0], total))[edge]
        return pa.table([docs["_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[place], pa.int32()))], names=["_id", "ids"])

    return run


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(id_col, ids) of every row, without special tokens; the strings of special tokens are ordinary text.

    A null or empty text has an empty list. Rows with equal ids are each encoded.
    """
    kind = df.schema[id_col].dataType
    t = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")))
    numbered = staged(t.mapInArrow(_numbered(to_arrow_type(kind)), f"block long, _id {kind.simpleString()}, at binary, n int, word string"), "numbered")
    own = numbered.where("word is not null").select("block", "n", "word")
    vocab = own.select("word").distinct().mapInArrow(_merged(vocabulary), "word string, ids binary")
    back = own.join(vocab, "word").select("block", "n", "ids")
    docs = numbered.where("at is not null").select(F.col("block").alias("of"), "_id", "at")
    found = docs.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(_gather(), f"_id {kind.simpleString()}, ids array<int>")
    return found.select(F.col("_id").alias(id_col), "ids")


def token_counts(df: DataFrame, keep: list[str], text_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """Columns ``keep`` of every row and n_tokens, the number of its text's ids; 0 for a null or empty text."""

    def run(batches):
        e = Encoder(vocabulary)
        for whole in batches:
            for b in _slices(whole):
                n = e.lengths(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, F.col(text_col).alias("text"))).mapInArrow(run, f"{shape}, n_tokens long")
