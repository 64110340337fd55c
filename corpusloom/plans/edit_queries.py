"""Queries of span edits, sections, sources and small joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.operators import edits
from corpusloom.plans.registry import LONG, query
from corpusloom.session import spread, table


def _corpus(spark, d, *columns):
    return spread(table(spark, d, "combined_data").select("rec_id", *columns))


@query(
    rf"""{LONG} SELECT rec_id, etype, span, CASE etype WHEN 'POSTAL_CODE' THEN nullif(regexp_extract(span, '{edits.POSTAL}', 1), '') WHEN 'NO_ADDRESS' THEN CASE WHEN NOT regexp_matches(span, '{edits.NO_STREET}') THEN span END ELSE span END AS fixed FROM s WHERE span IS NOT NULL"""
)
def conform_labels(spark, d):
    """Spans within their types' bounds; null for those that are dropped."""
    x = L.long_form(_corpus(spark, d, "output"), "rec_id", "output").where("span is not null")
    return x.select("rec_id", "etype", "span", edits.conform(F.col("etype"), F.col("span"), address="NO_ADDRESS").alias("fixed"))


@query(
    """WITH u AS (SELECT 'corpus' AS source, text_input FROM combined_data UNION ALL SELECT source, text_input FROM processed)
SELECT CASE WHEN source = 'corpus' THEN 'corpus' WHEN starts_with(source, 'SYN-') THEN 'synthetic' WHEN source IS NOT NULL THEN 'annotated' END AS kind, count(*) AS records, sum(length(text_input))::BIGINT AS chars FROM u GROUP BY 1"""
)
def source_mix(spark, d):
    """Records and characters of all sources together, by kind of source."""
    u = table(spark, d, "combined_data").select("text_input", "batch", F.lit("corpus").alias("source")).unionByName(table(spark, d, "processed").select("text_input", "source"), allowMissingColumns=True)
    return u.groupBy(edits.source_kind(F.col("source")).alias("kind")).agg(F.count("*").alias("records"), F.sum(F.length("text_input")).alias("chars"))


@query(
    r"""WITH p AS (SELECT doc_id, lower(text) AS t, lower(lag(text) OVER (PARTITION BY case_no ORDER BY doc_id)) AS q FROM documents WHERE case_no IS NOT NULL),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(q, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS b FROM p),
g AS (SELECT doc_id, list_transform(range(1, len(a) - 4), lambda i: array_to_string(a[i:i+5], ' ')) AS a, list_transform(range(1, len(b) - 4), lambda i: array_to_string(b[i:i+5], ' ')) AS b FROM w)
SELECT doc_id, coalesce(list_has_any(a, b), false) AS shared FROM g"""
)
def shared_run_with_previous(spark, d):
    """Whether a document has a run of six words in common with the one before it in its case."""
    w = Window.partitionBy("case_no").orderBy("doc_id")
    t = table(spark, d, "documents").where("case_no is not null").select("doc_id", "text", F.lag("text").over(w).alias("before"))
    return edits.shares_run(t, "text", "before").select("doc_id", "shared")


@query("SELECT o_orderkey, date_part('year', age(CAST(o_orderdate AS DATE), DATE '1950-01-01' + CAST(o_custkey % 9000 AS INT)))::INT AS age FROM orders")
def age_on_day(spark, d):
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("o_custkey") % 9000).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", edits.age_on(birth, F.col("o_orderdate").cast("date")).alias("age"))


@query("SELECT DISTINCT name, strip_accents(replace(replace(name, 'ł', 'l'), 'Ł', 'L')) AS folded FROM name_pool WHERE name IS NOT NULL")
def folded_names(spark, d):
    return table(spark, d, "name_pool").where("name is not null").select("name", edits.fold(F.col("name")).alias("folded")).distinct()


@query("SELECT doc_id, n_chars AS length, ((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32)::BIGINT AS batch FROM documents WHERE n_chars IS NOT NULL")
def shortest_first_batches(spark, d):
    return edits.shortest_first(table(spark, d, "documents"), "doc_id", "n_chars", 32)


_SECTIONS = r"""p AS (SELECT rec_id, list_filter(string_split_regex(text_input, '\n\n+'), lambda s: trim(s, ' ') <> '') AS p FROM combined_data WHERE text_input IS NOT NULL),
s AS (SELECT rec_id, unnest(p) AS body, generate_subscripts(p, 1) - 1 AS section FROM p)"""


@query(f"WITH {_SECTIONS} SELECT rec_id, section::INT AS section, greatest(150, floor(3000 * length(body) / sum(length(body)) OVER (PARTITION BY rec_id)))::BIGINT AS budget FROM s")
def section_budgets(spark, d):
    return edits.section_budgets(edits.sections(_corpus(spark, d, "text_input"), "rec_id", "text_input"), "rec_id", 3000)


@query(
    rf"""WITH {_SECTIONS}, w AS (SELECT rec_id, section, list_filter(string_split_regex(body, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM s),
g AS (SELECT rec_id, section, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i+7], ' '))) AS g FROM w WHERE len(t) >= 8),
f AS (SELECT rec_id, g, min(section) AS first FROM g GROUP BY ALL), a AS (SELECT rec_id, section, count(*) AS n FROM g JOIN f USING (rec_id, g) WHERE section > first GROUP BY ALL)
SELECT rec_id, section::INT AS section, n AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY n DESC, section) AS k FROM a) WHERE k = 1"""
)
def repeated_section(spark, d):
    """The section of a text that repeats most of the sections before it."""
    return edits.repeated_section(edits.sections(_corpus(spark, d, "text_input"), "rec_id", "text_input"), "rec_id")


@query(
    """WITH e AS (SELECT unnest(map_entries(output)) AS e FROM processed), a AS (SELECT unnest(e.value) AS span FROM e WHERE e.key = 'ADDRESS'), p AS (SELECT DISTINCT trim(regexp_extract(span, '^[^0-9]+')) AS prefix FROM a WHERE span IS NOT NULL),
c AS (SELECT rec_id, unnest(map_entries(output)) AS e FROM combined_data), x AS (SELECT DISTINCT rec_id, span FROM (SELECT rec_id, unnest(e.value) AS span FROM c WHERE e.key = 'NO_ADDRESS') WHERE span IS NOT NULL)
SELECT rec_id, span, prefix FROM x JOIN p ON prefix <> '' AND starts_with(span, prefix)"""
)
def known_streets(spark, d):
    """Addresses of the corpus that begin with a street of the labelled training records."""
    span = lambda t, k: F.explode(F.try_element_at("output", F.lit(k))).alias(t)
    pool = table(spark, d, "processed").select(span("s", "ADDRESS")).select(F.trim(F.regexp_extract("s", "^[^0-9]+", 0)).alias("prefix"))
    x = _corpus(spark, d, "output").select("rec_id", span("span", "NO_ADDRESS")).where("span is not null").distinct()
    return edits.prefix_join(x, "span", pool, "prefix").select("rec_id", "span", "prefix")


@query()
def nested_of_union(spark, d):
    """Spans all of whose places lie in places of longer spans of their type taken together."""
    return edits.redundant_nested(_corpus(spark, d, "text_input", "output"), "rec_id", "text_input", "output")


@query()
def absorbed_labels(spark, d):
    """Ages and places that a larger span of another type takes in."""
    return edits.absorbed_spans(table(spark, d, "processed"), "rec_id", "text_input", "output")
