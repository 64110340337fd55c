"""Queries of the taxonomy's conversion, their SQL written from the same word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions.context import before_sql, full, last_end_sql
from corpusloom.operators import taxonomy as X
from corpusloom.plans.registry import LONG, query
from corpusloom.session import spread, staged, table


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BARE = r"regexp_replace(span, '\A[\s\x{A0}]+|[\s\x{A0}]+\z', '', 'g')"
_has = lambda c, p: f"regexp_matches({c}, {_q(p)})"
_TOP = "greatest(" + ", ".join(f"e{k}" for k in range(len(X.GOV_LABELS))) + ")"
_LABEL = f"CASE WHEN {_TOP} = 0 THEN NULL " + " ".join(f"WHEN e{k} = {_TOP} THEN '{label}'" for k, (_, label) in enumerate(X.GOV_LABELS)) + " END"
_HEAD = lambda t, w: f"CASE WHEN etype = '{t}' THEN lower({before_sql('t', 'span', X.WIDTHS[w])}) ELSE '' END"
#: Long-form labels of combined_data with their new types.
MOVED = f"""{LONG}, a AS (SELECT rec_id, text_input, coalesce(text_input, '') AS t, etype, span, lower(span) AS low, {_BARE} AS bare, regexp_replace(span, '[^0-9]', '', 'g') AS dg FROM s WHERE span IS NOT NULL AND span <> ''),
h AS (SELECT *, {_HEAD("GOV_ID", "gov")} AS gov, {_HEAD("GOV_ID", "object")} AS obj, {_HEAD("FINANCIAL_INFO", "account")} AS acc, {_HEAD("DATE_TIME", "born")} AS born FROM a),
g AS (SELECT *, {", ".join(f"{last_end_sql('gov', p)} AS e{k}" for k, (p, _) in enumerate(X.GOV_LABELS))} FROM h),
n AS (SELECT *, {_LABEL} AS near FROM g),
m AS (SELECT rec_id, text_input, t, etype, span, CASE etype {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.RENAME.items())}
 WHEN 'GOV_ID' THEN CASE WHEN {_has("low", X.AUTHORITY)} THEN 'CASE_NUMBER' WHEN near = 'LICENSE_PLATE' AND {_has("obj", X.WEAPON)} THEN 'FIREARMS_LICENSE' WHEN near = 'LICENSE_PLATE' AND {_has("obj", X.VESSEL)} THEN 'VESSEL_REGISTRATION'
  WHEN near IS NOT NULL THEN near WHEN length(dg) = 11 AND length(replace(replace(span, ' ', ''), '-', '')) <= 12 THEN 'NATIONAL_ID' WHEN length(dg) = 9 AND {_has("span", full(r"[0-9\s\x{A0}]{9,11}"))} THEN 'ORG_NUMBER'
  WHEN {_has("low", X.CASE_SHAPE)} THEN 'CASE_NUMBER' ELSE 'UNRESOLVED' END
 WHEN 'FINANCIAL_INFO' THEN CASE WHEN {_has("bare", X.IBAN)} THEN 'IBAN' WHEN {_has("bare", X.CARD)} THEN 'CREDIT_CARD' WHEN {_has("bare", X.ACCOUNT)} THEN 'BANK_ACCOUNT' WHEN {_has("bare", X.CRYPTO)} THEN 'CRYPTO'
  WHEN {_has("bare", X.NUMBER)} AND {_has("acc", X.ACCOUNT_CUE)} THEN 'BANK_ACCOUNT' ELSE 'FINANCIAL' END
 WHEN 'HEALTH_INFO' THEN CASE WHEN {_has("low", X.ANIMAL)} THEN 'HEALTH' WHEN {_has("low", X.DISABILITY)} THEN 'DISABILITY' WHEN {_has("low", X.MEDICATION)} AND NOT {_has("low", X.DIAGNOSIS)} THEN 'MEDICATION' ELSE 'HEALTH' END
 WHEN 'DATE_TIME' THEN CASE WHEN {_has("bare", X.AGE)} THEN 'AGE' WHEN {_has("born", X.BORN)} THEN 'DATE_OF_BIRTH' ELSE 'DATE_TIME' END
 WHEN 'EMPLOYMENT_INFO' THEN CASE WHEN {_has("low", X.ROLE)} THEN 'EMPLOYMENT' WHEN {_has("lower(bare)", X.ORGANISATION)} OR {_has("bare", X.CAPITAL)} THEN 'ORGANIZATION' ELSE 'EMPLOYMENT' END
 WHEN 'FAMILY_RELATION' THEN CASE WHEN {_has("low", X.STATUS)} AND NOT {_has("low", X.KIN)} THEN 'MARITAL_STATUS' ELSE 'FAMILY_RELATION' END
 ELSE 'UNRESOLVED' END AS new_type FROM n)"""


def _moved(spark, d, overrides=None):
    x = L.long_form(spread(table(spark, d, "combined_data").select("rec_id", "output", "text_input")), "rec_id", "output", "text_input")
    return X.migrate(x.select(F.col("rec_id").alias("id"), F.col("text_input").alias("text"), "etype", "span"), overrides)


@query(f"{MOVED} SELECT rec_id, etype, span, new_type FROM m")
def taxonomy_convert(spark, d):
    return _moved(spark, d).select(F.col("id").alias("rec_id"), "etype", "span", "new_type")


@query(f"{MOVED} SELECT rec_id, span, new_type, {before_sql('t', 'span', 45)} AS context FROM m WHERE etype = 'GOV_ID'")
def gov_id_context(spark, d):
    """Identifiers with the text before them and the type that it gives them."""
    x = _moved(spark, d).where("etype = 'GOV_ID'")
    return x.select(F.col("id").alias("rec_id"), "span", "new_type", X.before(F.coalesce("text", F.lit("")), F.col("span"), 45).alias("context"))


@query(f"{MOVED} SELECT new_type, count(*) AS spans, count(DISTINCT span) AS distinct_spans FROM m WHERE etype = 'FINANCIAL_INFO' GROUP BY 1")
def financial_split(spark, d):
    return _moved(spark, d).where("etype = 'FINANCIAL_INFO'").groupBy("new_type").agg(F.count("*").alias("spans"), F.countDistinct("span").alias("distinct_spans"))


@query(f"{MOVED} SELECT etype, new_type, count(*) AS spans FROM m GROUP BY 1, 2")
def relabel_counts(spark, d):
    return X.relabel_counts(_moved(spark, d))


@query(f"{MOVED} SELECT rec_id, etype, span, {before_sql('t', 'span', 50)} AS context FROM m WHERE new_type = 'UNRESOLVED'")
def unresolved_parked(spark, d):
    return X.parked(_moved(spark, d)).withColumnRenamed("id", "rec_id")


@query(f"{MOVED} SELECT DISTINCT rec_id, CASE WHEN new_type = 'UNRESOLVED' THEN 'PERSON' ELSE new_type END AS type, span FROM m LEFT JOIN (SELECT DISTINCT name FROM name_pool WHERE name IS NOT NULL) ON name = span WHERE new_type <> 'UNRESOLVED' OR name IS NOT NULL")
def migrate_with_overrides(spark, d):
    """The converted corpus, where overrides file the unplaced spans that are a pool name under PERSON."""
    x = _moved(spark, d)
    names = table(spark, d, "name_pool").where("name is not null").select(F.col("name").alias("span")).distinct()
    overrides = X.parked(x).join(names, "span").select("id", "etype", "span", F.lit("PERSON").alias("new_type"))
    return X.migrated(_moved(spark, d, overrides)).withColumnRenamed("id", "rec_id")


@query(
    rf"""{MOVED}, r AS (SELECT DISTINCT rec_id, new_type AS type, span, t, regexp_replace(span, '^(?:[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}])+|(?:[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}])+$', '', 'g') AS fresh FROM m WHERE new_type <> 'UNRESOLVED')
SELECT DISTINCT rec_id, type, CASE WHEN contains(t, span) THEN span ELSE fresh END AS span FROM r WHERE contains(t, span) OR (fresh <> '' AND contains(t, fresh))"""
)
def migrate_with_corrections(spark, d):
    """The converted corpus after corrections: padded spans lose their padding, spans that do not stand in their text go."""
    x = _moved(spark, d)
    labels = staged(X.migrated(x), "migrated")  # read by the checks and the result
    texts = table(spark, d, "combined_data").select(F.col("rec_id").alias("id"), F.coalesce("text_input", F.lit("")).alias("text"))
    bad = labels.join(texts, "id").where(~F.contains("text", "span"))
    bare = L.T.strip(F.col("span"))
    corrections = bad.select("id", "type", F.col("span").alias("old"), F.when((bare != "") & F.contains("text", bare), bare).alias("new"))
    corrections = staged(corrections, "corrections")
    return X.correct(labels, corrections, texts).withColumnRenamed("id", "rec_id")
