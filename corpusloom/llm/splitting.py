"""Problem 3: splitting oversized texts at natural boundaries.

Method: balanced targets. The least number of pieces is computed, equal-length targets are placed, each target is
snapped to the strongest boundary near it, and the number of pieces grows while any piece exceeds the limit.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 7_000
OVERLAP = 200

#: Boundaries from the strongest to the weakest; a cut is after the match.
KINDS = (("section", re.compile(r"\n(?=(?:--|#+) )")), ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")), ("line", re.compile(r"\n")), ("sentence", re.compile(r"[.!?…][\"'»”)\]]*\s+")), ("clause", re.compile(r"[,;:]\s+")), ("word", re.compile(r"\s+")))
#: The share of the piece length in which each kind is looked for: a strong boundary may be further from the target.
REACH = {"section": 0.15, "paragraph": 0.15, "line": 0.12, "sentence": 0.10, "clause": 0.06, "word": 0.06}


def boundaries(text: str) -> list[tuple[str, np.ndarray]]:
    return [(kind, np.fromiter((m.end() for m in p.finditer(text)), np.int64)) for kind, p in KINDS]


def _joined(text: str, at: int) -> bool:
    """Whether the character at ``at`` belongs to the one before: a combining mark, a part of an emoji, a line feed after a return."""
    c, b = text[at], text[at - 1]
    return bool(unicodedata.combining(c)) or c in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= c <= "\U0001f3ff" or b == "\u200d" or (b == "\r" and c == "\n")


def _between(text: str, at: int, step: int = -1) -> int:
    """``at``, or the nearest place in the direction of ``step`` that parts no joined characters; ``at`` if there is none near."""
    for k in range(32):
        x = at + step * k
        if not 0 < x < len(text) or not _joined(text, x):
            return x if 0 <= x <= len(text) else at
    return at


def _snap(text: str, found, target: float, length: float, low: int, high: int) -> tuple[int, str]:
    for kind, at in found:
        reach = REACH[kind] * length
        a, b = np.searchsorted(at, (max(low, target - reach), min(high, target + reach) + 1e-9), "left")
        if b > a:
            near = at[a:b]
            return int(near[np.argmin(np.abs(near - target))]), kind
    return _between(text, int(min(high, max(low, round(target))))), "none"


def _start(text: str, words: np.ndarray, cut: int, overlap: int, least: int) -> int:
    """Start of the next piece: ``overlap`` characters before the cut, or the first word after that."""
    s = max(least, cut - overlap)
    if s == 0 or s >= cut or text[s - 1].isspace():
        return s
    k = int(np.searchsorted(words, s))
    return int(words[k]) if k < len(words) and words[k] < cut else min(cut, _between(text, s, 1))


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of the boundary at the end) of ``text``, each of at most ``limit`` characters.

    Without the repeated beginnings the pieces join to ``text``. A text within the limit is one piece.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and under half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    found = boundaries(text)
    words = found[-1][1]
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        length = (n + (k - 1) * overlap) / k
        pieces, start, last = [], 0, 0
        for i in range(1, k):
            at, kind = _snap(text, found, i * length - (i - 1) * overlap, length, last + 1, min(n - 1, start + limit))
            if at <= last or at - start > limit:
                break
            pieces.append((start, at, kind))
            start, last = _start(text, words, at, overlap, start + 1), at
        else:
            if n - start <= limit:
                return [*pieces, (start, n, "end")]
        k += 1


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text: (id_col, piece from 1, n_pieces, start, end, boundary, text).

    Offsets are code points. A text within the limit is one piece and never leaves the JVM; a null text gives one
    piece with null text and offsets, an empty one an empty piece. Ties between boundaries go to the earlier one.
    """
    t = df.select(F.col(id_col), F.col(text_col).alias("text"))
    short = t.where(F.col("text").isNull() | (F.length("text") <= limit)).select(
        id_col, F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), F.when(F.col("text").isNotNull(), 0).cast("int").alias("start"), F.length("text").alias("end"), F.lit("end").alias("boundary"), "text"
    )
    return short.unionByName(_long_pieces(t, id_col, limit, overlap))


def _long_pieces(t: DataFrame, id_col: str, limit: int, overlap: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for i, x in zip(pdf[id_col], pdf["text"]):
                p = cut(x, limit, overlap)
                rows += [(i, k + 1, len(p), a, b, kind, x[a:b]) for k, (a, b, kind) in enumerate(p)]
            if rows:
                yield pd.DataFrame(rows, columns=[id_col, "piece", "n_pieces", "start", "end", "boundary", "text"])

    kind = t.schema[id_col].dataType.simpleString()
    return t.where(F.length("text") > limit).mapInPandas(run, f"`{id_col}` {kind}, piece int, n_pieces int, start int, end int, boundary string, text string")


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the texts that were cut, each once for each row of ``df``."""
    return split_oversized(df, id_col, text_col, limit, overlap).where("n_pieces > 1 and piece = 1").select(id_col)
