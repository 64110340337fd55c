"""Queries that score predictions, compare annotators and build chat records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import prompts
from corpusloom.operators import dedup, scoring
from corpusloom.plans.registry import query
from corpusloom.session import table

_ONE = """g AS (SELECT source AS id, output FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rec_id) AS k FROM processed WHERE split = 'test' AND source <> 'corpus') WHERE k = 1),
p AS (SELECT id, output FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY predicted_at DESC NULLS LAST, seconds DESC NULLS LAST) AS k FROM predictions) WHERE k = 1)"""


def _gold(spark, d):
    t = table(spark, d, "processed").where("split = 'test' and source <> 'corpus'")
    return dedup.latest(t, "source", [F.col("rec_id")]).select(F.col("source").alias("id"), "output")


def _predicted(spark, d):
    t = table(spark, d, "predictions")
    return dedup.latest(t, "id", [F.col("predicted_at").desc_nulls_last(), F.col("seconds").desc_nulls_last()]).select("id", "output")


@query(
    f"""WITH {_ONE}, ge AS (SELECT id, unnest(map_entries(output)) AS e FROM g), pe AS (SELECT p.id, unnest(map_entries(p.output)) AS e FROM p JOIN g USING (id)),
a AS (SELECT id, e.key AS etype, list_distinct(list_filter(coalesce(e.value, []), lambda s: s IS NOT NULL)) AS x FROM ge), b AS (SELECT id, e.key AS etype, list_distinct(list_filter(coalesce(e.value, []), lambda s: s IS NOT NULL)) AS x FROM pe)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.etype, b.etype) AS etype, len(coalesce(a.x, []))::BIGINT AS expected, len(coalesce(b.x, []))::BIGINT AS found, len(list_intersect(coalesce(a.x, []), coalesce(b.x, [])))::BIGINT AS exact
FROM a FULL JOIN b ON a.id = b.id AND a.etype = b.etype"""
)
def score_exact(spark, d):
    return scoring.match_counts(_gold(spark, d), _predicted(spark, d), "id", "output").drop("lenient")


@query()
def score_report(spark, d):
    """Exact and lenient scores by type, tier and over all; the greedy matching is tested against brute force."""
    return scoring.report(scoring.match_counts(_gold(spark, d), _predicted(spark, d), "id", "output"))


@query(
    f"""WITH {_ONE}, ge AS (SELECT id, unnest(map_entries(output)) AS e FROM g), pe AS (SELECT id, unnest(map_entries(output)) AS e FROM p),
a AS (SELECT DISTINCT id, e.key AS etype, unnest(e.value) AS span FROM ge WHERE id IN (SELECT id FROM p)), b AS (SELECT DISTINCT id, e.key AS etype, unnest(e.value) AS span FROM pe WHERE id IN (SELECT id FROM g)),
x AS (SELECT etype, count(*) AS na FROM a WHERE span IS NOT NULL GROUP BY 1), y AS (SELECT etype, count(*) AS nb FROM b WHERE span IS NOT NULL GROUP BY 1), h AS (SELECT etype, count(*) AS hits FROM a JOIN b USING (id, etype, span) GROUP BY 1),
t AS (SELECT DISTINCT e.key AS etype FROM ge WHERE id IN (SELECT id FROM p) UNION SELECT DISTINCT e.key FROM pe WHERE id IN (SELECT id FROM g)),
r AS (SELECT etype, coalesce(na, 0)::BIGINT AS na, coalesce(nb, 0)::BIGINT AS nb, coalesce(hits, 0)::BIGINT AS hits FROM t LEFT JOIN x USING (etype) LEFT JOIN y USING (etype) LEFT JOIN h USING (etype))
SELECT *, round(CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0 * hits / (na + nb) END, 6) AS strict_f1 FROM r"""
)
def agreement_strict(spark, d):
    return scoring.agreement(_gold(spark, d), _predicted(spark, d), "id", "output").select("etype", "na", "nb", "hits", "strict_f1")


@query()
def agreement_relaxed(spark, d):
    return scoring.agreement(_gold(spark, d), _predicted(spark, d), "id", "output")


@query(
    f"""WITH {_ONE}, ge AS (SELECT id, unnest(map_entries(output)) AS e FROM g), pe AS (SELECT id, unnest(map_entries(output)) AS e FROM p),
a AS (SELECT DISTINCT id, e.key AS etype, unnest(e.value) AS span FROM ge), b AS (SELECT DISTINCT id, e.key AS etype, unnest(e.value) AS span FROM pe),
a1 AS (SELECT * FROM a WHERE span <> ''), b1 AS (SELECT * FROM b WHERE span <> ''), oa AS (SELECT * FROM a1 EXCEPT SELECT * FROM b1), ob AS (SELECT * FROM b1 EXCEPT SELECT * FROM a1)
SELECT id, etype, span, 'agreed' AS verdict, 0::BIGINT AS partners FROM a1 JOIN b1 USING (id, etype, span)
UNION ALL SELECT oa.id, oa.etype, oa.span, 'only_a', count(ob.span) FROM oa LEFT JOIN ob ON oa.id = ob.id AND oa.etype = ob.etype AND (contains(oa.span, ob.span) OR contains(ob.span, oa.span)) GROUP BY ALL
UNION ALL SELECT id, etype, span, 'only_b', 0 FROM ob WHERE NOT EXISTS (SELECT 1 FROM oa WHERE oa.id = ob.id AND oa.etype = ob.etype AND (contains(oa.span, ob.span) OR contains(ob.span, oa.span)))"""
)
def adjudication_diff(spark, d):
    return scoring.adjudication(_gold(spark, d), _predicted(spark, d), "id", "output")


@query(
    """SELECT rec_id, 'Find: ' || CASE WHEN types IS NULL THEN 'all' ELSE array_to_string(list_sort(types), ', ') END AS system, text_input AS "user" FROM processed WHERE length(trim(text_input)) > 0"""
)
def chat_format(spark, d):
    t = prompts.chat(table(spark, d, "processed").where("length(trim(text_input)) > 0"), "text_input", "types", "output")
    return t.select("rec_id", F.col("messages")[0].content.alias("system"), F.col("messages")[1].content.alias("user"))


@query()
def parse_output_round_trip(spark, d):
    """The assistant's message parsed back equals the labels."""
    t = prompts.chat(table(spark, d, "processed").where("output is not null"), "text_input", "types", "output")
    back = prompts.parse_output(F.col("messages")[2].content)
    return t.select("rec_id", (F.to_json(back).eqNullSafe(F.to_json("output"))).alias("same"))


@query(
    """SELECT p.split, count(*) AS records, count(r.id) AS predicted, round(avg(r.seconds), 6) AS mean_seconds, round(quantile_cont(r.seconds, 0.9), 6) AS p90_seconds
FROM processed p LEFT JOIN (SELECT id, seconds FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY predicted_at DESC NULLS LAST, seconds DESC NULLS LAST) AS k FROM predictions) WHERE k = 1) r ON p.source = r.id GROUP BY p.split"""
)
def prediction_coverage(spark, d):
    r = dedup.latest(table(spark, d, "predictions"), "id", [F.col("predicted_at").desc_nulls_last(), F.col("seconds").desc_nulls_last()]).select("id", "seconds")
    t = table(spark, d, "processed").select("split", "source").join(r, F.col("source") == F.col("id"), "left")
    return t.groupBy("split").agg(F.count("*").alias("records"), F.count("id").alias("predicted"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.percentile("seconds", 0.9), 6).alias("p90_seconds"))


@query(
    f"""WITH {_ONE}, ge AS (SELECT id, unnest(map_entries(output)) AS e FROM g), pe AS (SELECT id, unnest(map_entries(output)) AS e FROM p),
a AS (SELECT e.key AS etype, sum(len(list_distinct(list_filter(coalesce(e.value, []), lambda s: s IS NOT NULL)))) / (SELECT count(*) FROM g) AS gold_rate FROM ge GROUP BY 1),
b AS (SELECT e.key AS etype, sum(len(list_distinct(list_filter(coalesce(e.value, []), lambda s: s IS NOT NULL)))) / (SELECT count(*) FROM p) AS predicted_rate FROM pe GROUP BY 1),
r AS (SELECT etype, coalesce(gold_rate, 0) AS gold_rate, coalesce(predicted_rate, 0) AS predicted_rate FROM a FULL JOIN b USING (etype))
SELECT etype, round(gold_rate, 6) AS gold_rate, round(predicted_rate, 6) AS predicted_rate, CASE WHEN gold_rate > 0 THEN round(predicted_rate / gold_rate, 6) END AS ratio,
 greatest(gold_rate, predicted_rate) > 0.05 AND (gold_rate = 0 OR predicted_rate / gold_rate NOT BETWEEN 0.6 AND 1.6) AS flagged FROM r"""
)
def label_rate_ratio(spark, d):
    """Distinct spans a record by type in predictions against gold, flagged where they differ much."""
    return scoring.rate_ratio(_gold(spark, d), _predicted(spark, d), "output")


@query(
    """WITH e AS (SELECT id, unnest(map_entries(gemini)) AS e FROM slice_reference), c AS (SELECT e.key AS etype, count(DISTINCT id) AS docs FROM e WHERE len(e.value) > 0 GROUP BY 1),
t AS (SELECT unnest(['PERSON', 'DATE_TIME', 'GOV_ID', 'HEALTH_INFO', 'RELIGION', 'POSTAL_CODE']) AS etype)
SELECT etype, coalesce(docs, 0)::BIGINT AS docs, 20 AS target, CASE WHEN coalesce(docs, 0) = 0 THEN 'absent' WHEN docs < 20 THEN 'below' ELSE 'met' END AS state FROM t LEFT JOIN c USING (etype)"""
)
def coverage_vs_target(spark, d):
    """Documents with each wanted type against a target of twenty."""
    x = table(spark, d, "slice_reference").select("id", F.explode("gemini").alias("etype", "v")).where(F.size("v") > 0)
    c = x.groupBy("etype").agg(F.countDistinct("id").alias("docs"))
    t = spark.createDataFrame([(k,) for k in ("PERSON", "DATE_TIME", "GOV_ID", "HEALTH_INFO", "RELIGION", "POSTAL_CODE")], "etype string").join(c, "etype", "left")
    docs = F.coalesce("docs", F.lit(0))
    return t.select("etype", docs.cast("long").alias("docs"), F.lit(20).alias("target"), F.when(docs == 0, "absent").when(docs < 20, "below").otherwise("met").alias("state"))
