"""Text-quality gates and reports: table in, (id, figures, ok) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Patterns of placeholders and of structured personal data.
PLACEHOLDERS = {
    "square": r"\[[^\[\]\n]{2,60}\]\(?",
    "angle": r"<[^<>\n]{2,40}>",
    "word": r"[\p{L}\p{N}_]+",
    "initials": r"(?:\A|[^\p{L}\p{N}_])N\.N\.",
    "nn": r"(?:\A|[^\p{L}\p{N}_])NN(?:\z|[^\p{L}\p{N}_ \t]|[ \t][^0-9]|[ \t]\z)",
    "fill": r"\((?i:sett inn|fyll inn|set inn)[^)]*\)",
    "brace": r"\{[A-Za-z_]{3,}\}",
}
#: What a match must be to count: a footnote mark and a link are no placeholders, a word is one if it is of x only or digits before x.
COUNTS = {"square": r"\A\[(?:[^0-9].*|[0-9]{3,}.*|[0-9]{1,2}[^0-9\]].*)\]\z", "word": r"\A(?:[Xx]{3,}|.*[0-9]{4,}[Xx]{3,}.*)\z"}
NAME_RUN = r"(?:\A|[^\p{L}\p{N}_])([A-ZÆØÅ][a-zæøå'\-]+(?:[ \t]+[A-ZÆØÅ][a-zæøå'\-]+)+)"
PATTERNS = {
    "email": r"[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "date": r"[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}",
    "postal": "[0-9]{4} [A-ZÆØÅ][a-zæøå]+",
    "case_number": "20[0-9]{2}/[0-9]{6}",
    "account": r"[0-9]{4}\.[0-9]{2}\.[0-9]{5}",
}


def _placeholder_hits(text_col: str, kind: str) -> Column:
    hits = F.regexp_extract_all(text_col, F.lit(f"({PLACEHOLDERS[kind]})"), F.lit(1))
    return F.size(F.filter(hits, lambda x: x.rlike(COUNTS[kind])) if kind in COUNTS else hits).cast("long")


def placeholder_kinds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, n): unfilled placeholders of each text by form; forms without any are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), _placeholder_hits(text_col, k).alias("n")) for k in PLACEHOLDERS])
    x = df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(pairs).alias("_p"))
    return x.select(id_col, "_p.kind", "_p.n").where("n > 0")


def placeholders(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Number of forms of unfilled placeholders in each text; null texts are left out."""
    hits = sum(((_placeholder_hits(text_col, k) > 0).cast("long") for k in PLACEHOLDERS), F.lit(0).cast("long"))
    return df.where(F.col(text_col).isNotNull()).select(id_col, hits.alias("hits")).withColumn("ok", F.col("hits") == 0)


def verbatim(df: DataFrame, id_col: str, text_col: str, map_col: str) -> DataFrame:
    """(id, planned, missing, ok): the record's spans, as distinct values, that do not stand in its text; a null text has none."""
    spans = F.array_distinct(F.filter(F.flatten(F.transform(F.map_values(map_col), lambda v: F.coalesce(v, F.array().cast("array<string>")))), lambda s: s.isNotNull() & (s != "")))
    x = df.where(F.col(map_col).isNotNull()).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"), spans.alias("_s"))
    missing = F.size(F.filter("_s", lambda s: ~F.contains("_t", s))).cast("long")
    return x.select(id_col, F.size("_s").cast("long").alias("planned"), missing.alias("missing")).withColumn("ok", F.col("missing") == 0)


def name_collisions(df: DataFrame, id_col: str, text_col: str, names: DataFrame, name_col: str, longest: int = 5) -> DataFrame:
    """(id, name): names of two to ``longest`` words, as a run of capitalised words has them, that the list of names holds.

    Runs meet the list by a join, which Spark broadcasts only if it knows it to be small.
    """
    runs = F.regexp_extract_all(text_col, F.lit(NAME_RUN), F.lit(1))
    w = df.select(id_col, F.explode(runs).alias("r")).select(id_col, F.split("r", "[ \t]+").alias("w"))
    at = F.sequence(F.lit(0), F.size("w") - 2)
    parts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.size("w") - i)), lambda k: F.array_join(F.slice("w", i + 1, k), " "))))
    known = names.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("name")).distinct()
    return w.select(id_col, F.explode(parts).alias("name")).join(known, "name").select(id_col, "name").distinct()


def checksums(found: DataFrame, id_col: str, span_col: str, declared_col: str, actual: Column) -> DataFrame:
    """(id, span, declared, actual): identifiers whose declared validity is not that of their check digits."""
    x = found.select(id_col, F.col(span_col).alias("span"), F.col(declared_col).alias("declared"), actual.alias("actual")).distinct()
    return x.where(F.col("declared") != F.col("actual"))


def repetition(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.06, n: int = 8, short: bool = True) -> DataFrame:
    """(id, grams, kinds, share, ok): repeated share of n-chunk sequences; texts of fewer than 2n chunks have none and pass, or are left out
    without ``short`` (a later filter on ``grams`` would split a text anew for each of its sequences)."""
    x = df.where(F.col(text_col).isNotNull()).select(id_col, T.chunks(F.col(text_col)).alias("t"))
    x = x if short else x.where(F.size("t") >= 2 * n)
    g = F.when(F.size("t") >= 2 * n, F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.xxhash64(F.slice("t", i, n)))).otherwise(F.array().cast("array<bigint>"))
    x = x.select(id_col, g.alias("g")).select(id_col, F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("kinds"))
    share = F.coalesce(F.try_divide(F.col("grams") - F.col("kinds"), F.col("grams")), F.lit(0.0))
    return x.withColumn("share", F.round(share, 6)).withColumn("ok", share <= threshold)


def length(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    x = df.where(F.col(text_col).isNotNull()).select(id_col, F.length(text_col).cast("long").alias("n_chars"))
    return x.withColumn("ok", F.col("n_chars") <= limit)


def bucket(n: Column, edges: list[int]) -> Column:
    """Label of the range that holds n: 'lo-hi', or 'lo+' from the last edge on; what is under the first edge counts to the first range."""
    out = F.lit(f"{edges[-1]}+")
    for lo, hi in zip(reversed(edges[:-1]), reversed(edges[1:])):
        out = F.when(n < hi, f"{lo}-{hi - 1}").otherwise(out)
    return F.when(n.isNull(), None).otherwise(out)


def line_kinds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of each text that are not blank: fields ('name: value'), table rows, headings."""
    x = df.where(F.col(text_col).isNotNull()).select(id_col, F.filter(T.lines(F.col(text_col)), lambda s: F.trim(s) != "").alias("l"))
    count = lambda f: F.size(F.filter("l", f)).cast("long")
    return x.select(
        id_col,
        F.size("l").cast("long").alias("n_lines"),
        count(lambda s: s.rlike(r"^[^:\n]{2,40}: [^\n]{1,70}\z")).alias("field_lines"),
        count(lambda s: F.contains(s, F.lit("|"))).alias("table_lines"),
        count(lambda s: F.length(s).between(3, 60) & ~s.rlike(r"[.!?:;,]\z") & s.rlike("^[A-ZÆØÅ]")).alias("heading_lines"),
    )


def wrong_forms(df: DataFrame, id_col: str, text_col: str, lexicon: list[str], least: int = 3, short: int = 2, per_hundred: float = 1.0) -> DataFrame:
    """Words of the lexicon in each text and their rate; wrong from ``least`` on, or from ``short`` on at the given rate."""
    x = df.where(F.col(text_col).isNotNull()).select(id_col, T.tokens(F.col(text_col)).alias("t"))
    x = x.select(id_col, F.size("t").cast("long").alias("words"), F.size(F.filter("t", lambda w: w.isin(lexicon))).cast("long").alias("forms"))
    rate = F.coalesce(F.try_divide(F.lit(100.0) * F.col("forms"), F.col("words")), F.lit(0.0))
    return x.withColumn("rate", F.round(rate, 6)).withColumn("wrong", (F.col("forms") >= least) | ((F.col("forms") >= short) & (rate >= per_hundred)))


def sweep(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(id, pattern, match, n): every match of every pattern, counted for each text, in one pass over the table."""
    found = F.map_from_arrays(F.array(*map(F.lit, patterns or PATTERNS)), F.array(*[F.regexp_extract_all(text_col, F.lit(f"({p})"), F.lit(1)) for p in (patterns or PATTERNS).values()]))
    x = df.select(id_col, F.explode(found).alias("pattern", "m")).select(id_col, "pattern", F.explode("m").alias("match"))
    return x.groupBy(id_col, "pattern", "match").agg(F.count("*").alias("n"))


def top(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
