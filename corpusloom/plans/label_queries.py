"""Queries over labelled records: duplicates' labels, validation, repair, taxonomy, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as T
from corpusloom.operators import dedup, taxonomy, validation
from corpusloom.plans.registry import LONG, SQL, query
from corpusloom.session import spread, table

# The legacy types.
LEGACY = "PERSON DATE_TIME NO_PHONE_NUMBER NO_ADDRESS EMAIL_ADDRESS GOV_ID POSTAL_CODE EMPLOYMENT_INFO HEALTH_INFO CRIMINAL_RECORD FAMILY_RELATION ECONOMIC_STATUS BEHAVIORAL_PATTERN AGE_INFO CONTEXT_SENSITIVE FINANCIAL_INFO".split()
_TYPES = ", ".join(f"'{t}'" for t in LEGACY)
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"{LONG} SELECT etype, count(*) AS spans, count(DISTINCT rec_id) AS records, count(DISTINCT span) AS distinct_spans FROM s GROUP BY etype")
def label_counts(spark, d):
    x = L.long_form(table(spark, d, "combined_data"), "rec_id", "output")
    return x.groupBy("etype").agg(F.count("*").alias("spans"), F.countDistinct("rec_id").alias("records"), F.countDistinct("span").alias("distinct_spans"))


@query(f"{LONG}, c AS (SELECT rec_id, etype, count(*) AS n FROM s GROUP BY rec_id, etype) SELECT etype, n AS spans_per_record, count(*) AS records FROM c GROUP BY etype, n")
def spans_per_record(spark, d):
    x = L.long_form(table(spark, d, "combined_data"), "rec_id", "output").groupBy("rec_id", "etype").agg(F.count("*").alias("spans_per_record"))
    return x.groupBy("etype", "spans_per_record").agg(F.count("*").alias("records"))


@query(
    f"""{LONG}, u AS (SELECT md5(text_input) AS digest, etype, list(DISTINCT span) AS spans FROM s WHERE text_input IS NOT NULL AND span IS NOT NULL AND span <> '' GROUP BY ALL)
SELECT digest, etype, unnest(list_filter(spans, lambda x: len(list_filter(spans, lambda y: y <> x AND contains(y, x))) = 0)) AS span FROM u"""
)
def dedup_label_union(spark, d):
    return dedup.united_labels(table(spark, d, "combined_data"), "rec_id", "text_input", "output")


@query(
    """WITH c AS (SELECT md5(text_input) AS digest, list_sort(list_transform(list_filter(list_transform(coalesce(map_entries(output), []),
  lambda e: {'k': e.key, 'v': list_sort(list_distinct(list_filter(coalesce(e.value, []), lambda s: s IS NOT NULL)))}), lambda e: len(e.v) > 0), lambda e: to_json(e)::VARCHAR))::VARCHAR AS canon
 FROM combined_data WHERE text_input IS NOT NULL)
SELECT digest, count(*) AS copies, count(DISTINCT canon) AS variants, count(DISTINCT canon) > 1 AS conflict FROM c GROUP BY digest HAVING count(*) > 1"""
)
def duplicate_conflicts(spark, d):
    return dedup.conflicts(table(spark, d, "combined_data"), "text_input", "output")


@query(
    f"""{LONG}, t AS (SELECT rec_id, e.key AS etype, e.value AS v FROM e),
j AS (SELECT rec_id, coalesce(text_input, '') AS text, etype, span, row_number() OVER (PARTITION BY rec_id, etype, span ORDER BY ord) AS k FROM s WHERE etype IN ({_TYPES})),
c AS (SELECT *, regexp_replace(span, '^{WS}+|{WS}+$', '', 'g') AS bare, trim(regexp_replace(lower(text), '{WS}+', ' ', 'g')) AS flat FROM j),
l AS (SELECT rec_id, etype, text, span, CASE WHEN span IS NULL OR trim(span) = '' THEN 'empty_span' WHEN k > 1 THEN 'duplicate_span' WHEN contains(text, span) THEN 'ok' WHEN contains(text, bare) THEN 'padded_span'
 WHEN contains(lower(text), lower(bare)) THEN 'case_mismatch' WHEN contains(flat, trim(regexp_replace(lower(span), '{WS}+', ' ', 'g'))) THEN 'whitespace_mismatch' ELSE 'not_a_substring' END AS code FROM c),
n AS (SELECT DISTINCT a.rec_id, a.etype, a.span FROM l a JOIN l b ON a.rec_id = b.rec_id AND a.etype = b.etype AND a.code = 'ok' AND b.code = 'ok' AND a.span <> b.span AND contains(b.span, a.span)
 WHERE NOT contains(replace(a.text, b.span, chr(1)), a.span))
SELECT rec_id, etype, NULL::VARCHAR AS span, 'unknown_type' AS code FROM t WHERE etype NOT IN ({_TYPES})
UNION ALL SELECT rec_id, etype, NULL, 'bad_shape' FROM t WHERE etype IN ({_TYPES}) AND v IS NULL
UNION ALL SELECT rec_id, etype, span, code FROM l WHERE code <> 'ok'
UNION ALL SELECT rec_id, etype, span, 'redundant_nested' FROM n"""
)
def validate_report(spark, d):
    return validation.violations(spread(table(spark, d, "combined_data").select("rec_id", "text_input", "output")), "rec_id", "text_input", "output", LEGACY)


def validate_summary(spark, d):
    """Violations by code and type."""
    return validate_report(spark, d).groupBy("code", "etype").agg(F.count("*").alias("n"), F.countDistinct("rec_id").alias("records"))


query(f"SELECT code, etype, count(*) AS n, count(DISTINCT rec_id) AS records FROM ({SQL['validate_report']}) GROUP BY code, etype")(validate_summary)


@query(f"SELECT count_if(code IN ('not_a_substring', 'duplicate_span', 'bad_shape')) = 0 AND (SELECT count(*) FROM combined_data WHERE text_input IS NULL OR trim(text_input) = '' OR output IS NULL OR cardinality(output) = 0) = 0 AS ok, count(*) AS violations FROM ({SQL['validate_report']})")
def validate_exit(spark, d):
    """Whether the dataset passes: nothing beyond repair, no duplicates, no empty records; and the number of violations."""
    empty = table(spark, d, "combined_data").agg(F.count_if(F.col("text_input").isNull() | (F.trim("text_input") == "") | F.col("output").isNull() | (F.size("output") == 0)).alias("empty"))
    codes = validate_report(spark, d).agg(F.collect_set("code").alias("codes"), F.count("*").alias("violations"))
    return codes.crossJoin(empty).select((validation.is_valid_exit(F.col("codes")) & (F.col("empty") == 0)).alias("ok"), "violations")


@query()
def fix_labels(spark, d):
    """The labels that repair leaves, in long form."""
    x = validation.fixed(table(spark, d, "combined_data"), "rec_id", "text_input", "output", LEGACY)
    return x.select("rec_id", "etype", F.explode("spans").alias("span"))


@query(f"{LONG} SELECT etype, count(*) AS spans, count_if(contains(text_input, span)) AS verbatim, round(count_if(contains(text_input, span)) / count(*), 6) AS share FROM s WHERE span IS NOT NULL AND text_input IS NOT NULL GROUP BY etype")
def verbatim_rate(spark, d):
    x = L.long_form(table(spark, d, "combined_data"), "rec_id", "output", "text_input").where("span is not null and text_input is not null")
    hit = F.count_if(F.contains("text_input", "span"))
    return x.groupBy("etype").agg(F.count("*").alias("spans"), hit.alias("verbatim"), F.round(hit / F.count("*"), 6).alias("share"))


@query(
    """WITH e AS (SELECT id, unnest(map_entries(gemini)) AS e FROM slice_reference), b AS (SELECT DISTINCT id, e.key AS type, unnest(e.value) AS span FROM e),
b2 AS (SELECT * FROM b WHERE span IS NOT NULL), n AS (SELECT DISTINCT id, type, span FROM additions WHERE span IS NOT NULL AND trim(span) <> '' EXCEPT SELECT * FROM b2)
SELECT id, type, span, false AS added FROM b2 UNION ALL SELECT id, type, span, true FROM n"""
)
def additions_layer(spark, d):
    base = L.long_form(table(spark, d, "slice_reference"), "id", "gemini").where("span is not null").withColumnRenamed("etype", "type")
    new = table(spark, d, "additions").where("span is not null and trim(span) <> ''")
    return taxonomy.add_layer(base, new, ["id", "type", "span"])


@query(
    """WITH e AS (SELECT rec_id, types, unnest(map_entries(output)) AS e FROM processed)
SELECT rec_id, e.key AS etype, len(e.value)::BIGINT AS spans FROM e WHERE (types IS NULL OR list_contains(types, e.key)) AND len(e.value) > 0"""
)
def label_scope_filter(spark, d):
    t = table(spark, d, "processed")
    kept = L.drop_empty(L.in_scope(F.col("output"), F.col("types")))
    return t.select("rec_id", F.explode(kept).alias("etype", "v")).select("rec_id", "etype", F.size("v").cast("long").alias("spans"))


@query(
    f"""{LONG}, i AS (SELECT DISTINCT rec_id, text_input AS t, etype, span FROM s WHERE span IS NOT NULL AND length(span) > 0 AND text_input IS NOT NULL)
SELECT rec_id, etype, span, ((length(t) - length(replace(t, span, ''))) // length(span))::BIGINT AS places FROM i WHERE contains(t, span)"""
)
def span_occurrences(spark, d):
    y = L.long_form(table(spark, d, "combined_data"), "rec_id", "output", "text_input").where("span is not null and length(span) > 0 and contains(text_input, span)").dropDuplicates(["rec_id", "etype", "span"])
    return y.select("rec_id", "etype", "span", T.count_occurrences(F.col("text_input"), F.col("span")).cast("long").alias("places"))


@query(
    """WITH e AS (SELECT id, _gold.template AS template, unnest(map_entries(gemini)) AS e FROM slice_reference), t AS (SELECT template, count(*) AS docs FROM (SELECT _gold.template AS template FROM slice_reference) GROUP BY 1),
r AS (SELECT template, e.key AS etype, len(list_distinct(list_filter(e.value, lambda s: s IS NOT NULL))) AS n FROM e)
SELECT r.template, etype, round(sum(coalesce(n, 0)) / any_value(docs), 6) AS spans_per_doc, round(count_if(n > 0) / any_value(docs), 6) AS doc_share FROM r JOIN t ON r.template IS NOT DISTINCT FROM t.template GROUP BY r.template, etype"""
)
def label_rates(spark, d):
    """Distinct spans a document and share of documents by type, for each template."""
    t = table(spark, d, "slice_reference").select("id", F.col("_gold.template").alias("template"), "gemini")
    docs = t.groupBy("template").agg(F.count("*").alias("docs")).withColumnRenamed("template", "_t")
    x = t.select("template", F.explode("gemini").alias("etype", "v")).withColumn("n", F.size(F.array_distinct(F.filter(F.coalesce("v", F.array().cast("array<string>")), lambda s: s.isNotNull()))))
    g = x.groupBy("template", "etype").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("with_any"))
    j = g.join(docs, g["template"].eqNullSafe(docs["_t"]))
    return j.select("template", "etype", F.round(F.col("n") / F.col("docs"), 6).alias("spans_per_doc"), F.round(F.col("with_any") / F.col("docs"), 6).alias("doc_share"))


@query(
    """WITH p AS (SELECT rec_id, text_input, unnest(regexp_extract_all(text_input, '[A-Za-z0-9._+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)+')) AS hit FROM combined_data),
e AS (SELECT rec_id, unnest(map_entries(output)) AS e FROM combined_data), s AS (SELECT rec_id, unnest(e.value) AS span FROM e)
SELECT DISTINCT rec_id, hit FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.rec_id = p.rec_id AND span IS NOT NULL AND (contains(span, hit) OR (span <> '' AND contains(hit, span))))"""
)
def uncovered_emails(spark, d):
    """E-mail addresses that no span covers."""
    pattern = F.lit(r"([A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)")
    x = spread(table(spark, d, "combined_data").select("rec_id", "text_input", "output")).where(F.contains("text_input", F.lit("@"))).select("rec_id", F.explode(F.array_distinct(F.regexp_extract_all("text_input", pattern, F.lit(1)))).alias("hit"), F.coalesce(F.flatten(F.filter(F.map_values("output"), lambda v: v.isNotNull())), F.array().cast("array<string>")).alias("spans"))
    covered = F.exists(F.filter("spans", lambda s: s.isNotNull()), lambda s: F.contains(s, F.col("hit")) | ((s != "") & F.contains(F.col("hit"), s)))
    return x.where(~covered).select("rec_id", "hit").distinct()
