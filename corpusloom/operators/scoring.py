"""Greedy span matching, precision and recall, agreement and adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as T

# Tiers of types.
TIER_A = "BANK_ACCOUNT CASE_NUMBER CREDIT_CARD CRYPTO DATE_OF_BIRTH DEVICE_ID DRIVER_LICENSE EMAIL FAX_NUMBER FIREARMS_LICENSE IBAN IDENTITY_CARD INSURANCE_NUMBER IP_ADDRESS LICENSE_PLATE MEDICAL_LICENSE MILITARY_ID NATIONAL_ID ORG_NUMBER PASSPORT PASSWORD PHONE POSTAL_CODE SOCIAL_MEDIA STUDENT_ID TAX_ID URL USERNAME VESSEL_REGISTRATION VISA_NUMBER".split()
TIER_B = "ADDRESS AGE ANIMAL_INFO DATE_TIME GENDER LOCATION MARITAL_STATUS NATIONALITY ORGANIZATION PERSON ACADEMIC_RECORD EMPLOYMENT FAMILY_RELATION".split()
TIER_C = "AGE_INFO BEHAVIORAL_PATTERN BIOMETRIC_DATA CRIMINAL DISABILITY ECONOMIC_STATUS ETHNICITY FINANCIAL GENETIC_DATA HEALTH IMMIGRATION_STATUS MEDICATION POLITICAL RELIGIOUS_BELIEF SEXUAL_ORIENTATION TRADE_UNION".split()


def tier(etype: Column) -> Column:
    return F.when(etype.isin(TIER_A), "A").when(etype.isin(TIER_B), "B").when(etype.isin(TIER_C), "C").otherwise("?")


def greedy_hits(expected: Column, predicted: Column, fold_case: bool = True) -> Column:
    """Matches of expected spans, each in order with the first unused predicted span that contains it or is inside it.

    With ``fold_case`` lower-cased and stripped; an empty span matches anything.
    """
    tidy = (lambda c: F.transform(c, lambda s: T.strip(F.lower(s)))) if fold_case else (lambda c: c)
    start = F.struct(tidy(predicted).alias("rest"), F.lit(0).alias("hits"))

    def step(acc, e):
        at = F.array_position(F.transform(acc.rest, lambda p: F.contains(p, e) | F.contains(e, p)), True)
        # the used one gives way to null, which matches nothing
        rest = F.transform(acc.rest, lambda p, i: F.when(i + 1 == at, F.lit(None).cast("string")).otherwise(p))
        return F.struct(rest.alias("rest"), (acc.hits + F.when(at > 0, 1).otherwise(0)).alias("hits"))

    return F.aggregate(tidy(expected), start, step, lambda acc: acc.hits)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def match_counts(gold: DataFrame, predicted: DataFrame, key: str, map_col: str) -> DataFrame:
    """(key, etype, expected, found, exact, lenient) for each record and type of either side; a record without prediction has none found.

    Lists are made distinct first and null spans dropped. Both sides must have one row a key.
    """
    tidy = lambda c: F.array_distinct(F.filter(c, lambda s: s.isNotNull()))
    side = lambda df, name: df.select(key, F.explode(map_col).alias("etype", "_s")).select(key, "etype", tidy(F.coalesce("_s", F.array().cast("array<string>"))).alias(name))
    both = side(gold, "e").join(side(predicted, "p").join(gold.select(key), key, "left_semi"), [key, "etype"], "full")
    none = F.array().cast("array<string>")
    both = both.select(key, "etype", F.coalesce("e", none).alias("e"), F.coalesce("p", none).alias("p"))
    return both.select(key, "etype", F.size("e").cast("long").alias("expected"), F.size("p").cast("long").alias("found"), F.size(F.array_intersect("e", "p")).cast("long").alias("exact"), greedy_hits(F.col("e"), F.col("p")).cast("long").alias("lenient"))


def report(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1, exact and lenient, of each type, tier and of all, by grouping sets over summed counts."""
    t = counts.withColumn("tier", tier(F.col("etype")))
    sums = t.groupingSets([["etype", "tier"], ["tier"], []], "etype", "tier").agg(*[F.sum(c).alias(c) for c in ("expected", "found", "exact", "lenient")], F.grouping_id().alias("level"))
    out = [F.coalesce("etype", F.lit("ALL")).alias("etype"), F.coalesce("tier", F.lit("ALL")).alias("tier"), F.col("level").cast("int").alias("level"), "expected", "found", "exact", "lenient"]
    for k in ("exact", "lenient"):
        p, r = ratio(F.col(k), F.col("found")), ratio(F.col(k), F.col("expected"))
        out += [F.round(p, 6).alias(f"{k}_p"), F.round(r, 6).alias(f"{k}_r"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6).alias(f"{k}_f1")]
    return sums.select(*out)


def agreement(a: DataFrame, b: DataFrame, key: str, map_col: str) -> DataFrame:
    """For each type over the shared records: strict and relaxed agreement of two annotators.

    Equal spans count first; of the rest, sorted, each of a takes the first unused of b that contains it or is inside it.
    F1 = 2 hits / (a + b), 1 if both sides have none.
    """
    none = F.array().cast("array<string>")
    tidy = lambda c: F.array_distinct(F.filter(F.coalesce(c, none), lambda s: s.isNotNull()))
    side = lambda df, other, name: df.join(other.select(key), key, "left_semi").select(key, F.explode(map_col).alias("etype", "_s")).select(key, "etype", tidy(F.col("_s")).alias(name))
    x = side(a, b, "a").join(side(b, a, "b"), [key, "etype"], "full").select(key, "etype", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    only_a, only_b = F.array_sort(F.array_except("a", "b")), F.array_sort(F.array_except("b", "a"))
    x = x.select("etype", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("hits"), greedy_hits(only_a, only_b, fold_case=False).alias("near"))
    g = x.groupBy("etype").agg(*[F.sum(c).cast("long").alias(c) for c in ("na", "nb", "hits", "near")])
    f1 = lambda h: F.round(F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(2 * h / (F.col("na") + F.col("nb"))), 6)
    return g.select("etype", "na", "nb", "hits", "near", f1(F.col("hits")).alias("strict_f1"), f1(F.col("hits") + F.col("near")).alias("relaxed_f1"))


def adjudication(a: DataFrame, b: DataFrame, key: str, map_col: str) -> DataFrame:
    """(key, etype, span, verdict, partners): agreed spans, spans of a only with all overlapping spans of b, and spans of b only with none of a."""
    side = lambda df: L.long_form(df, key, map_col).where("span is not null and span <> ''").select(key, "etype", "span").distinct()
    x, y = side(a), side(b)
    on = [key, "etype", "span"]
    agreed = x.join(y, on).withColumns({"verdict": F.lit("agreed"), "partners": F.lit(0).cast("long")})
    only_a, only_b = x.join(y, on, "left_anti"), y.join(x, on, "left_anti")
    o = only_b.withColumnRenamed("span", "other")
    met = only_a.join(o, [key, "etype"], "left").withColumn("hit", F.coalesce(F.contains("span", "other") | F.contains("other", "span"), F.lit(False)))
    first = met.groupBy(*on).agg(F.sum(F.col("hit").cast("long")).alias("partners")).withColumn("verdict", F.lit("only_a"))
    used = met.where("hit").select(key, "etype", F.col("other").alias("span")).distinct()
    second = only_b.join(used, on, "left_anti").withColumns({"verdict": F.lit("only_b"), "partners": F.lit(0).cast("long")})
    return agreed.unionByName(first).unionByName(second)


def rate_ratio(gold: DataFrame, predicted: DataFrame, map_col: str, least: float = 0.05, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """(etype, gold_rate, predicted_rate, ratio, flagged): distinct spans a record on both sides; flagged where the larger rate exceeds ``least`` and
    the ratio is outside [low, high]. The ratio is null, and flagged, where gold has none."""
    n = lambda c: F.size(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: s.isNotNull())))

    def rates(df: DataFrame, name: str) -> DataFrame:
        x = df.select(F.explode(map_col).alias("etype", "_v")).groupBy("etype").agg(F.sum(n(F.col("_v"))).alias("_n"))
        return x.crossJoin(df.agg(F.count("*").alias("_docs"))).select("etype", (F.col("_n") / F.col("_docs")).alias(name))  # one row

    g, p = F.coalesce("g", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    x = rates(gold, "g").join(rates(predicted, "p"), "etype", "full").select("etype", g.alias("g"), p.alias("p"))
    ratio_ = F.try_divide(F.col("p"), F.col("g"))
    flagged = (F.greatest("g", "p") > least) & ((F.col("g") == 0) | ~F.coalesce(ratio_.between(low, high), F.lit(True)))
    return x.select("etype", F.round("g", 6).alias("gold_rate"), F.round("p", 6).alias("predicted_rate"), F.when(F.col("g") > 0, F.round(ratio_, 6)).alias("ratio"), flagged.alias("flagged"))
