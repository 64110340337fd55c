"""Queries over texts: duplicates, skeletons, counts, gates and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import identifiers as I
from corpusloom.functions import spans
from corpusloom.functions import text as T
from corpusloom.operators import dedup, gates, intervals, sweeps
from corpusloom.plans.registry import query
from corpusloom.session import spread, table

SKELETON_SQL = r"""trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(regexp_replace(%s, '[0-9]', '#', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'),
    lambda w: CASE WHEN regexp_full_match(w, '[A-ZÆØÅ][a-zæøå]+') THEN 'N' ELSE w END), ''), '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x{0B}]+', ' ', 'g'))"""


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def exact_dedup(spark, d):
    return dedup.first_seen(table(spark, d, "documents"), "doc_id", "text").select("digest", "copies", F.col("doc_id").alias("first_id"))


@query("SELECT md5(text_input) AS digest, min(rec_id) AS rec_id, count(*) AS copies FROM combined_data WHERE text_input IS NOT NULL GROUP BY 1")
def dedup_first_seen(spark, d):
    return dedup.first_seen(table(spark, d, "combined_data"), "rec_id", "text_input")


@query(f"SELECT doc_id, md5({SKELETON_SQL % 'text'}) AS skeleton FROM documents WHERE text IS NOT NULL")
def skeleton_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.skeleton(F.col("text"))).alias("skeleton"))


@query(f"SELECT lang, count(*) AS docs, count(DISTINCT md5({SKELETON_SQL % 'text'})) AS skeletons FROM documents WHERE text IS NOT NULL GROUP BY lang")
def skeleton_diversity(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("lang").agg(F.count("*").alias("docs"), F.countDistinct(F.md5(T.skeleton(F.col("text")))).alias("skeletons"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::BIGINT AS n_types FROM documents WHERE text IS NOT NULL")
def token_stats(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


@query(r"""WITH t AS (SELECT rec_id, list_filter(string_split_regex(text_input, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM combined_data WHERE text_input IS NOT NULL),
g AS (SELECT rec_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i+7], ' '))) AS g FROM t WHERE len(t) >= 16)
SELECT rec_id, count(*) AS grams, count(DISTINCT g) AS kinds, round((count(*) - count(DISTINCT g)) / count(*), 6) AS share FROM g GROUP BY rec_id""")
def ngram_repetition(spark, d):
    """Repeated share of eight-chunk sequences of texts of at least sixteen chunks."""
    return gates.repetition(_texts(spark, d), "rec_id", "text_input", short=False).drop("ok")


@query(r"""WITH t AS (SELECT rec_id, list_filter(string_split_regex(text_input, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM combined_data WHERE text_input IS NOT NULL),
g AS (SELECT rec_id, CASE WHEN len(t) >= 16 THEN list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i+7], ' ')) ELSE [] END AS g FROM t)
SELECT rec_id, len(g)::BIGINT AS grams, len(list_distinct(g))::BIGINT AS kinds, coalesce(round((len(g) - len(list_distinct(g))) / nullif(len(g), 0), 6), 0.0) AS share, coalesce((len(g) - len(list_distinct(g))) / nullif(len(g), 0), 0.0) <= 0.06 AS ok FROM g""")
def repetition_gate(spark, d):
    return gates.repetition(_texts(spark, d), "rec_id", "text_input")


def _texts(spark, d):
    return spread(table(spark, d, "combined_data").select("rec_id", "text_input"))


_KINDS = ", ".join("len(" + (f"list_filter(regexp_extract_all(text_input, '{p}'), lambda x: regexp_matches(x, '{gates.COUNTS[k]}'))" if k in gates.COUNTS else f"regexp_extract_all(text_input, '{p}')") + f") AS {k}" for k, p in gates.PLACEHOLDERS.items())
_SOME = " + ".join(f"({k} > 0)::BIGINT" for k in gates.PLACEHOLDERS)


@query(f"WITH k AS (SELECT rec_id, {_KINDS} FROM combined_data WHERE text_input IS NOT NULL) SELECT rec_id, {_SOME} AS hits, {_SOME} = 0 AS ok FROM k")
def placeholder_gate(spark, d):
    return gates.placeholders(_texts(spark, d), "rec_id", "text_input")


@query(f"WITH k AS (SELECT rec_id, {_KINDS} FROM combined_data WHERE text_input IS NOT NULL), u AS (UNPIVOT k ON {', '.join(gates.PLACEHOLDERS)} INTO NAME kind VALUE n) SELECT rec_id, kind, n FROM u WHERE n > 0")
def placeholder_kinds(spark, d):
    return gates.placeholder_kinds(_texts(spark, d), "rec_id", "text_input")


@query(
    """WITH e AS (SELECT rec_id, coalesce(text_input, '') AS t, list_distinct(list_filter(flatten(list_transform(map_values(output), lambda v: coalesce(v, []))), lambda s: s IS NOT NULL AND s <> '')) AS s FROM combined_data WHERE output IS NOT NULL)
SELECT rec_id, len(s)::BIGINT AS planned, len(list_filter(s, lambda x: NOT contains(t, x)))::BIGINT AS missing, len(list_filter(s, lambda x: NOT contains(t, x))) = 0 AS ok FROM e"""
)
def verbatim_gate(spark, d):
    return gates.verbatim(spread(table(spark, d, "combined_data").select("rec_id", "text_input", "output")), "rec_id", "text_input", "output")


@query(
    rf"""WITH e AS (SELECT unnest(map_entries(output)) AS e FROM processed), n AS (SELECT DISTINCT name FROM (SELECT unnest(e.value) AS name FROM e WHERE e.key = 'PERSON') WHERE name IS NOT NULL),
r AS (SELECT rec_id, string_split_regex(unnest(regexp_extract_all(text_input, '{gates.NAME_RUN.replace("'", "''")}', 1)), '[ 	]+') AS w FROM combined_data),
i AS (SELECT rec_id, w, unnest(range(1, len(w))) AS i FROM r), c AS (SELECT rec_id, w, i, unnest(range(i + 1, least(i + 4, len(w)) + 1)) AS j FROM i)
SELECT DISTINCT rec_id, array_to_string(w[i:j], ' ') AS name FROM c WHERE array_to_string(w[i:j], ' ') IN (SELECT name FROM n)"""
)
def name_collision_gate(spark, d):
    """Names of the labelled training records that stand in the corpus's texts."""
    names = table(spark, d, "processed").select(F.explode(F.try_element_at("output", F.lit("PERSON"))).alias("name"))
    return gates.name_collisions(_texts(spark, d), "rec_id", "text_input", names, "name")


@query(
    """WITH e AS (SELECT rec_id, unnest(map_entries(output)) AS e FROM combined_data), s AS (SELECT DISTINCT rec_id, unnest(e.value) AS span FROM e WHERE e.key = 'GOV_ID'),
d AS (SELECT rec_id, span, list_transform(string_split(regexp_replace(span, '[^0-9]', '', 'g'), ''), lambda c: c::INT) AS x FROM s WHERE length(regexp_replace(span, '[^0-9]', '', 'g')) = 11)
SELECT rec_id, span, true AS declared, false AS actual FROM d
WHERE NOT ((3*x[1]+7*x[2]+6*x[3]+x[4]+8*x[5]+9*x[6]+4*x[7]+5*x[8]+2*x[9]+x[10]) % 11 = 0 AND (5*x[1]+4*x[2]+3*x[3]+2*x[4]+7*x[5]+6*x[6]+5*x[7]+4*x[8]+3*x[9]+2*x[10]+x[11]) % 11 = 0)"""
)
def checksum_gate(spark, d):
    """Eleven-digit spans labelled as identity numbers whose check digits say otherwise."""
    x = table(spark, d, "combined_data").select("rec_id", F.explode(F.try_element_at("output", F.lit("GOV_ID"))).alias("span"))
    x = x.where(F.length(I.digits(F.col("span"))) == 11).withColumn("declared", F.lit(True))
    return gates.checksums(x, "rec_id", "span", "declared", I.is_national_id(I.digits(F.col("span"))))


@query("SELECT rec_id, length(text_input)::BIGINT AS n_chars, length(text_input) <= 7000 AS ok FROM combined_data WHERE text_input IS NOT NULL")
def length_gate(spark, d):
    return gates.length(table(spark, d, "combined_data"), "rec_id", "text_input", 7000)


@query("""SELECT CASE WHEN n < 500 THEN '0-499' WHEN n < 1000 THEN '500-999' WHEN n < 2000 THEN '1000-1999' WHEN n < 7000 THEN '2000-6999' ELSE '7000+' END AS bucket, count(*) AS docs
FROM (SELECT length(text_input) AS n FROM combined_data WHERE text_input IS NOT NULL) GROUP BY 1""")
def length_histogram(spark, d):
    t = table(spark, d, "combined_data").where("text_input is not null")
    return t.groupBy(gates.bucket(F.length("text_input"), [0, 500, 1000, 2000, 7000]).alias("bucket")).agg(F.count("*").alias("docs"))


@query(r"""SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[^:\n]{2,40}: [^\n]{1,70}$')))::BIGINT AS field_lines, len(list_filter(l, lambda x: contains(x, '|')))::BIGINT AS table_lines,
len(list_filter(l, lambda x: length(x) BETWEEN 3 AND 60 AND NOT regexp_matches(x, '[.!?:;,]$') AND regexp_matches(x, '^[A-ZÆØÅ]')))::BIGINT AS heading_lines
FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL)""")
def line_kinds(spark, d):
    return gates.line_kinds(table(spark, d, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?][ \t\n\x0B\f\r]+'))::BIGINT AS inner_ends FROM documents WHERE text IS NOT NULL""")
def sentence_ends(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"([.!?][ \t\n\x0B\f\r]+)"), F.lit(1))).cast("long").alias("inner_ends"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(t)::BIGINT AS words, len(list_filter(t, lambda w: w IN ('jeg','ikke','hva','fra','noe','hvordan','være','mye','også','bare')))::BIGINT AS forms FROM t)
SELECT doc_id, words, forms, CASE WHEN words = 0 THEN 0.0 ELSE round(100.0 * forms / words, 6) END AS rate, (forms >= 3 OR (forms >= 2 AND words > 0 AND 100.0 * forms / words >= 1.0)) AS wrong FROM c""")
def wrong_language_rate(spark, d):
    """Bokmål forms where Nynorsk is expected: at least three, or two at one in a hundred words."""
    return gates.wrong_forms(table(spark, d, "documents"), "doc_id", "text", ["jeg", "ikke", "hva", "fra", "noe", "hvordan", "være", "mye", "også", "bare"])


@query(r"""SELECT doc_id, list_sort(list_filter(['the', 'and', 'however', 'please'], lambda p: list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), p))) AS tells FROM documents WHERE text IS NOT NULL""")
def english_tells(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.array_sort(F.array_intersect(F.array(*map(F.lit, ("the", "and", "however", "please"))), T.tokens(F.col("text")))).alias("tells"))


@query(r"""WITH r AS (SELECT rec_id, 'email' AS pattern, unnest(regexp_extract_all(text_input, '[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+')) AS m FROM combined_data
UNION ALL SELECT rec_id, 'date', unnest(regexp_extract_all(text_input, '[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}')) FROM combined_data
UNION ALL SELECT rec_id, 'postal', unnest(regexp_extract_all(text_input, '[0-9]{4} [A-ZÆØÅ][a-zæøå]+')) FROM combined_data
UNION ALL SELECT rec_id, 'case_number', unnest(regexp_extract_all(text_input, '20[0-9]{2}/[0-9]{6}')) FROM combined_data
UNION ALL SELECT rec_id, 'account', unnest(regexp_extract_all(text_input, '[0-9]{4}\.[0-9]{2}\.[0-9]{5}')) FROM combined_data)
SELECT rec_id, pattern, m AS match, count(*) AS n FROM r GROUP BY ALL""")
def pattern_sweep(spark, d):
    return gates.sweep(_texts(spark, d), "rec_id", "text_input")


@query()
def full_sweep(spark, d):
    """Beside pattern_sweep, whose five patterns SQL can express: all shapes, labelled values, dates and ages with their places, findings inside others left out."""
    return sweeps.findings(spread(table(spark, d, "combined_data").select("rec_id", "text_input")), "rec_id", "text_input")


@query(r"""WITH r AS (SELECT rec_id, unnest(list_filter(regexp_extract_all(regexp_replace(text_input, '([0-9])[ .\-]([0-9])', '\1\2', 'g'), '[0-9]+'), lambda x: length(x) = 11)) AS number FROM combined_data),
w AS (SELECT DISTINCT rec_id, number, list_transform(string_split(number, ''), lambda c: c::INT) AS x FROM r)
SELECT rec_id, number,
 (3*x[1]+7*x[2]+6*x[3]+x[4]+8*x[5]+9*x[6]+4*x[7]+5*x[8]+2*x[9]+x[10]) % 11 = 0 AND (5*x[1]+4*x[2]+3*x[3]+2*x[4]+7*x[5]+6*x[6]+5*x[7]+4*x[8]+3*x[9]+2*x[10]+x[11]) % 11 = 0 AS national,
 (11 - (5*x[1]+4*x[2]+3*x[3]+2*x[4]+7*x[5]+6*x[6]+5*x[7]+4*x[8]+3*x[9]+2*x[10]) % 11) % 11 = x[11] AS account FROM w""")
def eleven_digit_numbers(spark, d):
    """Runs of eleven digits, single separators between digits left out, with both check-digit tests."""
    joined = F.regexp_replace("text_input", r"([0-9])[ .\-]([0-9])", "$1$2")
    runs = F.filter(F.regexp_extract_all(joined, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.length(x) == 11)
    x = table(spark, d, "combined_data").select("rec_id", F.explode(F.array_distinct(runs)).alias("number"))
    return x.select("rec_id", "number", I.is_national_id(F.col("number")).alias("national"), I.is_account(F.col("number")).alias("account"))


@query(r"""WITH r AS (SELECT rec_id, unnest(list_filter(regexp_extract_all(replace(text_input, ' ', ''), '[0-9]+'), lambda x: length(x) = 9)) AS number FROM combined_data),
w AS (SELECT DISTINCT rec_id, number, list_transform(string_split(number, ''), lambda c: c::INT) AS x FROM r)
SELECT rec_id, number, (11 - (3*x[1]+2*x[2]+7*x[3]+6*x[4]+5*x[5]+4*x[6]+3*x[7]+2*x[8]) % 11) % 11 = x[9] AS organisation FROM w""")
def organisation_numbers(spark, d):
    runs = F.filter(F.regexp_extract_all(F.replace("text_input", F.lit(" "), F.lit("")), F.lit("([0-9]+)"), F.lit(1)), lambda x: F.length(x) == 9)
    x = table(spark, d, "combined_data").select("rec_id", F.explode(F.array_distinct(runs)).alias("number"))
    return x.select("rec_id", "number", I.is_organisation_number(F.col("number")).alias("organisation"))


@query(r"""WITH r AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 8 AND 19)) AS number FROM documents),
w AS (SELECT DISTINCT doc_id, number, list_reverse(list_transform(string_split(number, ''), lambda c: c::INT)) AS x FROM r)
SELECT doc_id, number, list_sum(list_transform(x, lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END)) % 10 = 0 AS luhn FROM w""")
def luhn_candidates(spark, d):
    runs = F.filter(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), lambda x: F.length(x).between(8, 19))
    x = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(runs)).alias("number"))
    return x.select("doc_id", "number", I.is_luhn(F.col("number")).alias("luhn"))


@query(r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n, unnest(CASE WHEN n = 0 THEN [] ELSE range(0, greatest(0, ceil((n - 128) / 96.0))::BIGINT + 1) END) AS k FROM t)
SELECT doc_id, (k * 96)::BIGINT AS start_token, least(n, k * 96 + 128)::BIGINT AS end_token FROM w""")
def token_windows(spark, d):
    """Windows of 128 tokens, each overlapping the one before by 32."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    w = x.select("doc_id", "n", F.explode(intervals.windows(F.col("n"), 128, 32)).alias("s"))
    return w.select("doc_id", F.col("s").cast("long").alias("start_token"), F.least("n", F.col("s") + 128).cast("long").alias("end_token"))


@query("""SELECT lang, source, grouping_id(lang, source)::INT AS level, count(*) AS docs, sum(n_chars)::BIGINT AS chars, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 6) AS mean
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def group_rollup(spark, d):
    t = table(spark, d, "documents")
    g = t.groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
    return g.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT genre, count(*) AS docs, count(n_chars) AS known, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY genre")
def length_quantiles(spark, d):
    q = [F.round(F.percentile("n_chars", p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)]
    return table(spark, d, "documents").groupBy("genre").agg(F.count("*").alias("docs"), F.count("n_chars").alias("known"), *q)


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents) WHERE k <= 8""")
def topk_examples(spark, d):
    return gates.top(table(spark, d, "documents"), "source", [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], 8).select("source", "doc_id", "n_chars")


@query("""SELECT count(*) AS docs, count_if(n_chars BETWEEN (SELECT min(length(text_input)) FROM processed WHERE length(trim(text_input)) > 0) AND (SELECT max(length(text_input)) FROM processed)) AS within FROM documents""")
def length_range_filter(spark, d):
    span = table(spark, d, "processed").agg(F.min(F.when(F.length(F.trim("text_input")) > 0, F.length("text_input"))).alias("lo"), F.max(F.length("text_input")).alias("hi"))
    t = table(spark, d, "documents").select("n_chars").crossJoin(F.broadcast(span))  # one row
    return t.agg(F.count("*").alias("docs"), F.count_if(F.col("n_chars").between(F.col("lo"), F.col("hi"))).alias("within"))


@query(r"""SELECT rec_id, CASE WHEN regexp_matches(text_input, '(^|\n)-- ') THEN 'interview' ELSE 'dossier' END AS template FROM combined_data WHERE text_input IS NOT NULL""")
def template_class(spark, d):
    t = table(spark, d, "combined_data").where("text_input is not null")
    return t.select("rec_id", F.when(F.col("text_input").rlike(r"(^|\n)-- "), "interview").otherwise("dossier").alias("template"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_valid(props) AS parsed FROM events""")
def parse_props(spark, d):
    t = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return t.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNotNull().alias("parsed"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(l)::BIGINT AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[^:\n]{2,40}: [^\n]{1,70}$') OR contains(x, '|')))::BIGINT AS table_rows FROM l)
SELECT doc_id, n_lines, table_rows, table_rows >= 5 AND table_rows > 0.4 * n_lines AS tabular FROM c""")
def tabular_gate(spark, d):
    """At least five field or table lines that are more than two fifths of the lines."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.filter(T.lines(F.col("text")), lambda s: F.trim(s) != "").alias("l"))
    row = F.filter("l", lambda s: s.rlike(r"^[^:\n]{2,40}: [^\n]{1,70}\z") | F.contains(s, F.lit("|")))
    x = x.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(row).cast("long").alias("table_rows"))
    return x.withColumn("tabular", (F.col("table_rows") >= 5) & (F.col("table_rows") > 0.4 * F.col("n_lines")))


@query(r"""WITH p AS (SELECT rec_id, generate_subscripts(string_split(text_input, chr(10) || chr(10)), 1) AS k, unnest(string_split(text_input, chr(10) || chr(10))) AS part FROM combined_data WHERE text_input IS NOT NULL),
o AS (SELECT rec_id, k, length(part) AS n, sum(length(part) + 2) OVER (PARTITION BY rec_id ORDER BY k) - length(part) - 2 AS a FROM p)
SELECT rec_id, k::INT AS part_no, a::BIGINT AS start_char, (a + n)::BIGINT AS end_char FROM o""")
def section_offsets(spark, d):
    """Paragraphs as half-open spans of code points."""
    parts = F.split("text_input", "\n\n", -1)
    x = table(spark, d, "combined_data").where("text_input is not null").select("rec_id", F.transform(parts, lambda p: F.length(p)).alias("n"))
    ends = F.aggregate("n", F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n + 2))
    x = x.select("rec_id", F.posexplode(F.transform("n", lambda n, i: F.struct(F.get(ends, i).alias("a"), n.alias("n")))).alias("pos", "s"))
    return x.select("rec_id", (F.col("pos") + 1).alias("part_no"), F.col("s.a").cast("long").alias("start_char"), (F.col("s.a") + F.col("s.n")).cast("long").alias("end_char"))


@query()
def number_cues(spark, d):
    """The nearest cue before each eleven-digit number: label and number decide its kind, not the shape alone."""
    return _number_cues(table(spark, d, "combined_data"))


def _number_cues(df):
    # the context is looked back for, not matched, so that it may hold the number before
    number = F.lit(r"(?s)(?<![0-9])(?=[0-9]{11}(?![0-9]))(?<=(\A.{0,44}|.{45}))([0-9]{11})")
    found = F.arrays_zip(*[F.regexp_extract_all("text_input", number, F.lit(k)).alias(c) for k, c in ((1, "before"), (2, "number"))])
    x = df.select("rec_id", F.explode(found).alias("m"))
    cue = spans.nearest_cue(F.col("m.before"), ["fødselsnummer", "personnr", "personnummer", "fnr", "født nr", "strekkode", "kontonummer"])
    return x.select("rec_id", F.col("m.number").alias("number"), cue.alias("cue"))
