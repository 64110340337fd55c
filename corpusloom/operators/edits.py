"""Edits of label spans and small joins and windows over texts and their sections."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions import text as T

# Forms of postal codes and of addresses without a street; types that absorb an age; least characters of a section.
POSTAL = r"\A([0-9]{4})(?:\s+\S.*)?\z"
NO_STREET = r"\A[0-9]{4}\s+[^0-9,]+\z"
AGE_ABSORBERS = ("FAMILY_RELATION", "AGE_INFO", "ANIMAL_INFO")
SECTION_FLOOR = 150


def conform(etype: Column, span: Column, postal: str = "POSTAL_CODE", address: str = "ADDRESS") -> Column:
    """The span within its type's bounds: the four digits of a postal code, no address without a street; null if it is dropped."""
    code = F.regexp_extract(span, POSTAL, 1)
    return F.when(etype == postal, F.when(code != "", code)).when(etype == address, F.when(~span.rlike(NO_STREET), span)).otherwise(span)


def source_kind(source: Column) -> Column:
    """corpus, synthetic (its ids begin with SYN-) or annotated; null for a null source."""
    return F.when(source == "corpus", "corpus").when(source.startswith("SYN-"), "synthetic").when(source.isNotNull(), "annotated")


def _places(text: str, span: str) -> list[tuple[int, int]]:
    out, k = [], text.find(span) if span else -1
    while k >= 0:
        out.append((k, k + len(span)))
        k = text.find(span, k + 1)
    return out


@F.pandas_udf(ArrayType(StringType()))
def absorbed(texts: pd.Series, spans: pd.Series, covers: pd.Series) -> pd.Series:
    """The spans that stand in the text and every place of which lies inside a place of a longer cover; covers may overlap each other."""
    out = []
    for text, mine, wide in zip(texts, spans, covers):
        drop = []
        if text is not None and mine is not None and wide is not None:
            at = {w: _places(text, w) for w in set(wide) if w}
            for s in dict.fromkeys(x for x in mine if x):
                longer = [p for w, places in at.items() if w != s and s in w for p in places]
                spots = _places(text, s)
                if spots and longer and all(any(lo <= a and b <= hi for lo, hi in longer) for a, b in spots):
                    drop.append(s)
        out.append(drop)
    return pd.Series(out)


def _spans(map_col: str, *types: str) -> Column:
    lists = [F.coalesce(F.try_element_at(map_col, F.lit(t)), F.array().cast("array<string>")) for t in types]
    return F.filter(F.concat(*lists), lambda s: s.isNotNull())


def redundant_nested(df: DataFrame, id_col: str, text_col: str, map_col: str) -> DataFrame:
    """(id, etype, span): spans all of whose places lie in places of longer spans of their type, taken together."""
    x = df.select(id_col, F.col(text_col).alias("_t"), F.explode(map_col).alias("etype", "_s"))
    return x.select(id_col, "etype", F.explode(absorbed("_t", "_s", "_s")).alias("span"))


def absorbed_spans(df: DataFrame, id_col: str, text_col: str, map_col: str, organisations: list[str] = ()) -> DataFrame:
    """(id, etype, span): ages inside spans of family, age or animal facts, and places inside organisations' names."""
    ages = absorbed(text_col, _spans(map_col, "AGE"), _spans(map_col, *AGE_ABSORBERS))
    places = absorbed(text_col, _spans(map_col, "LOCATION"), F.concat(_spans(map_col, "ORGANIZATION"), F.array(*map(F.lit, organisations)).cast("array<string>")))
    x = df.select(id_col, F.array(F.struct(F.lit("AGE").alias("etype"), ages.alias("s")), F.struct(F.lit("LOCATION").alias("etype"), places.alias("s"))).alias("_a"))
    x = x.select(id_col, F.explode("_a").alias("_a"))
    return x.select(id_col, "_a.etype", F.explode("_a.s").alias("span"))


def first_of_overlapping(starts_ends: Column) -> Column:
    """Intervals (start, end), going from left to right, that do not overlap one kept before; of equal starts the longest counts."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    ordered = F.array_sort(starts_ends, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end).cast("int"))
    return F.aggregate(ordered, empty, lambda kept, x: F.when((F.size(kept) == 0) | (F.element_at(kept, -1).end <= x.start), F.concat(kept, F.array(F.struct(x.start.cast("bigint").alias("start"), x.end.cast("bigint").alias("end"))))).otherwise(kept))


def uncovered_characters(start: Column, end: Column, covers: Column) -> Column:
    """Places in [start, end) that no interval (start, end) of ``covers`` holds."""
    every = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda p: ~F.exists(covers, lambda c: (c.start <= p) & (p < c.end)))


def shares_run(df: DataFrame, a: str, b: str, n: int = 6) -> DataFrame:
    """``df`` with ``shared``: whether the texts ``a`` and ``b`` have a run of n words, in any case, in common; null texts have none.

    The words are columns of their own: inside the lambda of the runs they would be split anew for each run.
    """
    t = df.withColumns({"_a": T.chunks(F.lower(a)), "_b": T.chunks(F.lower(b))})
    runs = lambda c: T.grams(F.col(c), n)
    return t.withColumn("shared", F.coalesce(F.arrays_overlap(runs("_a"), runs("_b")), F.lit(False))).drop("_a", "_b")


def _folding() -> tuple[str, str]:
    """Letters with marks and their plain letters, from the character database."""
    pairs = []
    for k in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if plain != chr(k) and len(plain) == 1:
            pairs.append((chr(k), plain))
    pairs += [("ł", "l"), ("Ł", "L")]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold(c: Column) -> Column:
    """Without the marks of Latin letters; letters without a plain form stay."""
    return F.regexp_replace(F.translate(c, *_folding()), r"\p{M}", "")


def age_on(birth: Column, day: Column) -> Column:
    """Whole years from the birth to a day."""
    before = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    return F.year(day) - F.year(birth) - before.cast("int")


def shortest_first(df: DataFrame, id_col: str, length_col: str, batch: int) -> DataFrame:
    """(id, length, batch): rows numbered by length and id and cut into batches; the numbering is by length and inside each length."""
    t = df.select(id_col, F.col(length_col).cast("long").alias("length")).where("length is not null")
    sizes = t.groupBy("length").agg(F.count("*").alias("n"))
    before = sizes.select("length", (F.sum("n").over(Window.orderBy("length")) - F.col("n")).alias("before"))  # a row for each length
    k = F.row_number().over(Window.partitionBy("length").orderBy(id_col)) - 1
    return t.withColumn("k", k).join(before, "length").select(id_col, "length", F.floor((F.col("before") + F.col("k")) / batch).cast("long").alias("batch"))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, body): the parts of each text between blank lines, numbered from 0; blank parts are none."""
    parts = F.filter(F.split(text_col, "\n\n+"), lambda s: F.trim(s) != "")
    return df.select(id_col, F.posexplode(parts).alias("section", "body"))


def section_budgets(parts: DataFrame, id_col: str, budget: int) -> DataFrame:
    """(id, section, budget): the characters of a text's budget by the length of its sections, ``SECTION_FLOOR`` at least."""
    w = F.length("body")
    share = F.floor(F.lit(budget) * w / F.sum(w).over(Window.partitionBy(id_col)))
    return parts.select(id_col, "section", F.greatest(F.lit(SECTION_FLOOR), share).cast("long").alias("budget"))


def repeated_section(parts: DataFrame, id_col: str, n: int = 8) -> DataFrame:
    """(id, section, repeated): the section with most n-word sequences that the text has had before; the first of equals, none without any."""
    w = parts.select(id_col, "section", T.chunks(F.col("body")).alias("w"))
    g = w.select(id_col, "section", F.explode(T.grams(F.col("w"), n)).alias("gram")).select(id_col, "section", F.md5("gram").alias("gram"))
    first = g.groupBy(id_col, "gram").agg(F.min("section").alias("first"))
    again = g.join(first, [id_col, "gram"]).where(F.col("section") > F.col("first")).groupBy(id_col, "section").agg(F.count("*").alias("repeated"))
    best = again.groupBy(id_col).agg(F.max(F.struct("repeated", (-F.col("section")).alias("s"))).alias("m"))
    return best.select(id_col, (-F.col("m.s")).alias("section"), "m.repeated")


def prefix_join(df: DataFrame, text_col: str, pool: DataFrame, pool_col: str) -> DataFrame:
    """Rows of ``df`` with each string of the pool with which their text begins, as ``prefix``.

    The pool's different lengths, few, come to the driver; the join is on equal beginnings.
    """
    p = pool.where(F.length(pool_col) > 0).select(F.col(pool_col).alias("prefix")).distinct()
    sizes = sorted(r[0] for r in p.select(F.length("prefix")).distinct().limit(1_000).collect())
    if not sizes:
        return df.withColumn("prefix", F.lit(None).cast("string")).limit(0)
    heads = F.array_distinct(F.array(*[F.left(text_col, F.lit(n)) for n in sizes]))
    return df.withColumn("prefix", F.explode(heads)).join(p, "prefix")
