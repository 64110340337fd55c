"""Queries for splits, samples, partitions and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import dedup, intervals, leakage, sampling, similarity
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import SKELETON_SQL
from corpusloom.session import spread, table


@query(
    """WITH k AS (SELECT DISTINCT coalesce(lang, '') AS stratum, md5(text) AS item FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('holdout|' || stratum || '|' || item)) AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM k)
SELECT stratum, item, CASE WHEN rank <= least(n - 1, greatest(1, round_even(0.25 * n, 0)::BIGINT)) THEN 'benchmark' ELSE 'train' END AS side FROM r"""
)
def holdout_partition(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("lang", F.md5("text").alias("item"))
    return dedup.holdout(t, "lang", "item", "holdout", 0.25)


@query(
    """WITH h AS (SELECT rec_id, text_input, ('0x' || substr(sha256('split|' || md5(text_input)), 1, 8))::BIGINT % 100 AS b FROM combined_data)
SELECT rec_id, CASE WHEN text_input IS NULL THEN NULL WHEN b < 10 THEN 'test' WHEN b < 20 THEN 'val' ELSE 'train' END AS part FROM h"""
)
def hash_split(spark, d):
    return dedup.split_by_hash(table(spark, d, "combined_data"), "text_input", "split", 10, 10).select("rec_id", "part")


@query(
    """SELECT rec_id, CASE WHEN text_input IS NOT NULL THEN list_reduce(list_prepend(0, list_transform(string_split(md5(text_input), ''), lambda c: ('0x' || c)::INT)), lambda a, x: (a * 16 + x) % 6) END AS shard FROM combined_data"""
)
def hash_shard(spark, d):
    return dedup.hash_shard(table(spark, d, "combined_data"), "text_input", 6).select("rec_id", "shard")


@query(
    """WITH x AS (SELECT source AS name, floor(target_share * 1003) AS base, round(target_share * 1003 - floor(target_share * 1003), 9) AS rest FROM mix_targets),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, name) AS k, 1003 - sum(base) OVER () AS left_over FROM x)
SELECT name, (base + CASE WHEN k <= left_over THEN 1 ELSE 0 END)::BIGINT AS quota FROM r"""
)
def largest_remainder_quota(spark, d):
    return dedup.quotas(table(spark, d, "mix_targets"), "source", "target_share", 1003)


@query("""SELECT rec_id, source, unnest(range(1, CASE WHEN source = 'corpus' THEN 1 ELSE 3 END + 1))::INT AS copy_no FROM processed""")
def upsample(spark, d):
    t = table(spark, d, "processed").select("rec_id", "source")
    return dedup.upsample(t, F.when(F.col("source") == "corpus", 1).otherwise(3))


@query("""SELECT case_no, doc_id, use_no FROM (SELECT case_no, doc_id, row_number() OVER (PARTITION BY case_no ORDER BY received_at NULLS FIRST, doc_id)::INT AS use_no FROM documents) WHERE use_no <= 2""")
def reuse_cap(spark, d):
    return dedup.capped_reuse(table(spark, d, "documents").select("case_no", "doc_id", "received_at"), "case_no", ["received_at", "doc_id"], 2).select("case_no", "doc_id", "use_no")


@query("""SELECT rec_id, md5(text_input) AS digest FROM combined_data c WHERE text_input IS NULL OR NOT EXISTS (SELECT 1 FROM processed p WHERE p.text_input = c.text_input)""")
def resume_antijoin(spark, d):
    return dedup.resume(table(spark, d, "combined_data"), table(spark, d, "processed"), "text_input").select("rec_id", "digest")


@query("""SELECT genre, doc_id, rank FROM (SELECT genre, doc_id, row_number() OVER (PARTITION BY genre ORDER BY sha256('sample|' || doc_id), doc_id)::INT AS rank FROM documents) WHERE rank <= 25""")
def stratified_sample(spark, d):
    return dedup.stratified_sample(table(spark, d, "documents").select("genre", "doc_id"), "genre", "doc_id", "sample", 25).select("genre", "doc_id", "rank")


@query("""SELECT id, seconds FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY predicted_at DESC NULLS LAST, seconds DESC NULLS LAST) AS k FROM predictions) WHERE k = 1""")
def last_prediction(spark, d):
    t = table(spark, d, "predictions")
    return dedup.latest(t, "id", [F.col("predicted_at").desc_nulls_last(), F.col("seconds").desc_nulls_last()]).select("id", "seconds")


@query(
    r"""WITH t AS (SELECT rec_id, split, text_input AS x FROM processed WHERE length(trim(text_input)) > 12), a AS (SELECT * FROM t WHERE split = 'train'), b AS (SELECT * FROM t WHERE split <> 'train')
SELECT 'shared_text' AS kind, count(*) AS n FROM b WHERE x IN (SELECT x FROM a)
UNION ALL SELECT 'shared_skeleton', count(*) FROM b WHERE md5(regexp_replace(x, '[0-9]', '#', 'g')) IN (SELECT md5(regexp_replace(x, '[0-9]', '#', 'g')) FROM a)"""
)
def leak_report(spark, d):
    return leakage.report(table(spark, d, "processed"), "split", "text_input")


@query(
    rf"""WITH t AS (SELECT split, text_input AS x, md5({SKELETON_SQL % 'text_input'}) AS s FROM processed WHERE length(trim(text_input)) > 12),
p AS (SELECT split, unnest(output['PERSON']) AS name FROM processed)
SELECT 'shared_text' AS kind, count(*) AS n FROM t WHERE split <> 'train' AND x IN (SELECT x FROM t WHERE split = 'train')
UNION ALL SELECT 'shared_skeleton', count(*) FROM t WHERE split <> 'train' AND s IN (SELECT s FROM t WHERE split = 'train')
UNION ALL SELECT 'shared_name', count(DISTINCT name) FROM p WHERE split <> 'train' AND name IN (SELECT name FROM p WHERE split = 'train' AND name IS NOT NULL)"""
)
def leak_checks(spark, d):
    """Beside leak_report, whose skeleton only evens out digits: the whole skeleton, and full names of both sides."""
    return leakage.checks(table(spark, d, "processed"), "split", "text_input", "output")


@query(
    r"""SELECT rec_id, split FROM processed p WHERE split = 'train' AND (text_input IS NULL OR NOT EXISTS (SELECT 1 FROM processed q WHERE q.split IN ('val', 'test') AND q.text_input = p.text_input))"""
)
def decontaminate(spark, d):
    t = table(spark, d, "processed")
    return leakage.decontaminated(t.where("split = 'train'"), t.where("split in ('val', 'test')"), "text_input").select("rec_id", "split")


@query(
    r"""WITH n AS (SELECT DISTINCT lower(name) AS name FROM name_pool WHERE side = 'benchmark' AND name IS NOT NULL),
w AS (SELECT DISTINCT rec_id, unnest(regexp_extract_all(lower(text_input), '[\p{L}\p{N}_]+')) AS name FROM processed WHERE split = 'train')
SELECT name, count(*) AS records FROM w JOIN n USING (name) GROUP BY name"""
)
def benchmark_names_in_train(spark, d):
    """Names of the benchmark side in training texts: the pool's names are single words, so words meet them by equality."""
    t = table(spark, d, "processed").where("split = 'train'")
    return leakage.words_in_texts(t, "rec_id", "text_input", table(spark, d, "name_pool").where("side = 'benchmark'"), "name")


@query(
    """WITH x AS (SELECT DISTINCT type, span FROM additions WHERE span IS NOT NULL AND trim(span) <> '')
SELECT a.type, a.span FROM x a WHERE EXISTS (SELECT 1 FROM x b WHERE a.type = b.type AND a.span <> b.span AND contains(b.span, a.span))"""
)
def contained_spans(spark, d):
    """Spans inside a longer span of their type, found by their words: a longer span has all words but perhaps the outer ones."""
    x = table(spark, d, "additions").where("span is not null and trim(span) <> ''").select("type", "span").distinct()
    return leakage.contained(x, "type", "span")


@query(
    """WITH o AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR a >= top THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS merged FROM g GROUP BY user_id, island"""
)
def interval_merge(spark, d):
    t = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("a"), (F.unix_timestamp("ts") + 3600).alias("b"))
    return intervals.merge_intervals(t, ["user_id"], "a", "b")


@query(
    """WITH o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS p, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(CASE WHEN k > 1 AND p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, run, event_type"""
)
def tag_runs(spark, d):
    return intervals.runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query(
    """WITH a AS (SELECT c_custkey, 20 + c_custkey % 70 AS subject_age, 1 + (c_custkey * 7) % 100 AS member_age, CASE c_custkey % 4 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'spouse' ELSE 'professional' END AS role FROM customer)
SELECT c_custkey, role, CASE WHEN member_age > 105 THEN 'too_old' WHEN role = 'parent' AND member_age > 100 THEN 'parent_too_old' WHEN role = 'parent' AND (member_age - subject_age < 16 OR member_age - subject_age > 55) THEN 'parent_gap'
 WHEN role = 'child' AND (subject_age - member_age < 16 OR subject_age - member_age > 55) THEN 'child_gap' WHEN role = 'spouse' AND member_age < 18 THEN 'spouse_too_young' WHEN role = 'spouse' AND abs(member_age - subject_age) > 15 THEN 'spouse_gap'
 WHEN role = 'professional' AND member_age NOT BETWEEN 25 AND 67 THEN 'professional_age' ELSE 'ok' END AS verdict FROM a"""
)
def coherence_rules(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(
        "c_custkey",
        (20 + k % 70).alias("subject_age"),
        (1 + (k * 7) % 100).alias("member_age"),
        F.when(k % 4 == 0, "parent").when(k % 4 == 1, "child").when(k % 4 == 2, "spouse").otherwise("professional").alias("role"),
    )
    return t.select("c_custkey", "role", leakage.coherence(F.col("role"), F.col("member_age"), F.col("subject_age")).alias("verdict"))


@query(
    """WITH a AS (SELECT c_custkey, 20 + c_custkey % 70 AS s, 1 + (c_custkey * 7) % 130 AS m, CASE c_custkey % 5 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' WHEN 2 THEN 'spouse' WHEN 3 THEN 'guardian' ELSE 'professional' END AS role FROM customer),
r AS (SELECT c_custkey, role, unnest([CASE WHEN m > 105 THEN 'too_old' END, CASE WHEN role IN ('parent', 'guardian') AND m > 100 THEN 'parent_too_old' END, CASE WHEN role IN ('parent', 'guardian') AND m - s NOT BETWEEN 16 AND 55 THEN 'parent_gap' END,
 CASE WHEN role = 'child' AND s - m NOT BETWEEN 16 AND 55 THEN 'child_gap' END, CASE WHEN role = 'spouse' AND m < 18 THEN 'spouse_too_young' END, CASE WHEN role = 'spouse' AND m > 100 THEN 'spouse_too_old' END,
 CASE WHEN role = 'spouse' AND abs(m - s) > 15 THEN 'spouse_gap' END, CASE WHEN role = 'professional' AND m NOT BETWEEN 25 AND 67 THEN 'professional_age' END]) AS rule FROM a)
SELECT c_custkey, role, rule FROM r WHERE rule IS NOT NULL"""
)
def cast_verdicts(spark, d):
    """Every rule of ages that a member of a cast breaks."""
    k = F.col("c_custkey")
    role = F.when(k % 5 == 0, "parent").when(k % 5 == 1, "child").when(k % 5 == 2, "spouse").when(k % 5 == 3, "guardian").otherwise("professional")
    t = table(spark, d, "customer").select("c_custkey", (20 + k % 70).alias("subject"), (1 + (k * 7) % 130).alias("age"), role.alias("role"))
    return t.select("c_custkey", "role", F.explode(leakage.incoherent(F.col("role"), F.col("age"), F.col("subject"))).alias("rule"))


@query(
    """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5),
r AS (SELECT s, min(id) AS rep FROM k GROUP BY s), u AS (SELECT rep AS id, unnest(s) AS g, len(s) AS n FROM r),
p AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS likeness FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, round(likeness, 6) AS likeness FROM p WHERE likeness >= 0.8 UNION ALL SELECT rep, id, 1.0 FROM k JOIN r USING (s) WHERE id <> rep"""
)
def similar_documents(spark, d):
    """Pairs of documents of likeness 0.8 or more over five-word sequences; copies with their representative."""
    x = similarity.similar_pairs(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 0.8)
    return x.withColumn("likeness", F.round("likeness", 6))


@query()
def keep_first_documents(spark, d):
    """Documents in order of their ids, each kept if it is like none kept before it."""
    return similarity.keep_first(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 0.8).withColumnRenamed("id", "doc_id")


@query(
    """WITH t AS (SELECT rec_id, source, md5(coalesce(text_input, '')) AS g FROM processed), h AS (SELECT DISTINCT g FROM t WHERE source <> 'corpus')
SELECT rec_id, CASE WHEN g IN (SELECT g FROM h) THEN 'test' WHEN ('0x' || substr(sha256('source|' || g), 1, 8))::BIGINT % 100 < 10 THEN 'val' ELSE 'train' END AS part FROM t"""
)
def source_split(spark, d):
    """Documents of a source are test, the corpus is split by the hash of its texts; a text in two parts would raise."""
    t = sampling.split_by_source(table(spark, d, "processed").select("rec_id", "source", "text_input"), "text_input", F.col("source") != "corpus", 10, "source")
    return sampling.assert_no_leak(t, "text_input").select("rec_id", "part")


@query()
def gold_sample(spark, d):
    """A sample of 200 texts: rare types first, then texts whose copies are labelled differently, then by template."""
    t = table(spark, d, "combined_data").where("text_input is not null").withColumn("digest", F.md5("text_input"))
    hard = dedup.conflicts(table(spark, d, "combined_data"), "text_input", "output").select("digest", F.col("conflict").alias("hard"))
    t = t.groupBy("digest").agg(F.min("rec_id").alias("rec_id"), F.min_by("output", "rec_id").alias("output"), F.min_by(F.contains("text_input", F.lit("\n-- ")), "rec_id").alias("talk"))
    t = t.join(hard, "digest", "left").withColumn("template", F.when(F.col("talk"), "interview").otherwise("dossier"))
    types = ["PERSON", "NO_ADDRESS", "NO_PHONE_NUMBER", "EMAIL_ADDRESS", "GOV_ID", "FINANCIAL_INFO", "HEALTH_INFO", "CRIMINAL_RECORD", "FAMILY_RELATION", "EMPLOYMENT_INFO"]
    return sampling.three_pass(t, "rec_id", "output", "hard", "template", types, 200, 15, 0.2, "gold").withColumnRenamed("id", "rec_id")


@query(
    """WITH b AS (SELECT DISTINCT name AS item, side FROM name_pool WHERE name IS NOT NULL AND length(trim(name)) >= 3), t AS (SELECT rec_id, CASE WHEN split = 'train' THEN 'train' ELSE 'benchmark' END AS s, text_input AS x FROM processed),
n AS (SELECT item, count(DISTINCT CASE WHEN s = 'train' THEN rec_id END) AS train, count(DISTINCT CASE WHEN s = 'benchmark' THEN rec_id END) AS benchmark FROM (SELECT DISTINCT item FROM b) b JOIN t ON contains(x, item) OR contains(x, CASE WHEN upper(item[1]) = item[1] THEN lower(item[1]) ELSE upper(item[1]) END || item[2:]) GROUP BY item),
l AS (SELECT b.item, b.side, EXISTS (SELECT 1 FROM b o WHERE o.item <> b.item AND contains(o.item, b.item)) AS any_, EXISTS (SELECT 1 FROM b o WHERE o.side = 'train' AND o.item <> b.item AND contains(o.item, b.item)) AS tr, EXISTS (SELECT 1 FROM b o WHERE o.side = 'benchmark' AND o.item <> b.item AND contains(o.item, b.item)) AS be FROM b)
SELECT 'shared_text' AS kind, item, (train + benchmark)::BIGINT AS documents FROM n JOIN l USING (item) WHERE train > 0 AND benchmark > 0 AND NOT any_
UNION ALL SELECT 'benchmark_in_train', item, train FROM n JOIN l USING (item) WHERE side = 'benchmark' AND train > 0 AND NOT tr UNION ALL SELECT 'train_in_benchmark', item, benchmark FROM n JOIN l USING (item) WHERE side = 'train' AND benchmark > 0 AND NOT be"""
)
def leak_crossing(spark, d):
    """Names of the pool that stand in documents of both sides or of the side that is not theirs."""
    pool = table(spark, d, "name_pool").where("name is not null").select("name", "side").distinct().collect()  # a small fixed table
    t = table(spark, d, "processed")
    return leakage.crossing(t, "rec_id", "text_input", F.coalesce(F.col("split") == "train", F.lit(False)), [(r["name"], r["side"]) for r in pool], 3)
