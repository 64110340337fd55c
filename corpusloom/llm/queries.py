"""Queries of the training-data problems: name -> (spark, sf_dir) -> DataFrame; and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import languages, mixing, near_duplicates, personal, repetition, residue, split_overlap, splitting, tokenizing
from corpusloom.session import table


def _overlaps(spark, d):
    return split_overlap.cross_split_overlaps(table(spark, d, "processed"), "rec_id", "text_input", "split")


def _personal(spark, d):
    return personal.find_personal(table(spark, d, "combined_data"), table(spark, d, "name_pool"), "rec_id", "text_input", "output")


def p1_found(spark, d):
    return _personal(spark, d).withColumnRenamed("id", "rec_id")


def p1_redacted(spark, d):
    out = personal.redact(table(spark, d, "combined_data"), table(spark, d, "name_pool"), "rec_id", "text_input", "output")
    return out.select(F.col("id").alias("rec_id"), F.col("text").alias("text_input"), F.to_json("output").alias("output"))


def p1_counts(spark, d):
    return _personal(spark, d).groupBy("field", "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("span").alias("distinct_values"))


def p2_found(spark, d):
    pairs = _overlaps(spark, d)
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p2_counts(spark, d):
    return split_overlap.overlap_counts(_overlaps(spark, d), table(spark, d, "processed"), "rec_id", "split", "source")


def p2_classes(spark, d):
    """Pairs of classes with their numbers of records: exact whatever the copies."""
    members, pairs = split_overlap.overlapping_classes(table(spark, d, "processed"), "rec_id", "text_input", "split")
    size = lambda ev, c: members.where(F.col("ev") == ev).groupBy(F.col("cls").alias(c)).agg(F.count("*").alias(f"n_{c}"), F.min("rec_id").alias(f"rec_{c}"))
    return pairs.join(size(False, "a"), "a").join(size(True, "b"), "b")


def p2_members(spark, d):
    """Class of every record of the splits that has enough words, and its number of partner classes."""
    members, pairs = split_overlap.overlapping_classes(table(spark, d, "processed"), "rec_id", "text_input", "split")
    links = pairs.select(F.col("a").alias("cls"), F.lit(False).alias("ev")).union(pairs.select("b", F.lit(True))).groupBy("cls", "ev").agg(F.count("*").alias("n_links"))
    return members.join(links, ["cls", "ev"], "left").select("rec_id", "cls", "ev", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p3_found(spark, d):
    return splitting.oversized(table(spark, d, "combined_data"), "rec_id", "text_input")


def p3_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "combined_data"), "rec_id", "text_input")


def p4_found(spark, d):
    return residue.judge(table(spark, d, "combined_data"), "rec_id", "text_input").where("residue").select("rec_id")


def p4_clean(spark, d):
    out = residue.without_residue(table(spark, d, "combined_data"), "rec_id", "text_input")
    return out.withColumn("output", F.to_json("output"))


def p4_validation(spark, d):
    return residue.validation(table(spark, d, "combined_data"), "rec_id", "text_input")


def p5_found(spark, d):
    """The robust distance selects texts, and the exact share is counted in these only."""
    found = repetition.repetitive(table(spark, d, "combined_data"), "rec_id", "text_input")
    return found.select(F.col("id").alias("rec_id"))


def p5_shares(spark, d):
    found = repetition.outliers(table(spark, d, "combined_data"), "rec_id", "text_input")
    return found.withColumnRenamed("id", "rec_id")


def p6_found(spark, d):
    return near_duplicates.near_duplicate_pairs(table(spark, d, "combined_data"), "rec_id", "text_input")


def p6_groups(spark, d):
    return near_duplicates.near_duplicate_groups(table(spark, d, "combined_data"), "rec_id", "text_input")


def p7_ids(spark, d):
    return tokenizing.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")[0]


def p8_shares(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")[1]


def p9_found(spark, d):
    found = languages.unnamed_languages(table(spark, d, "documents"), "doc_id", "text", "lang", ["source", "genre"])
    return found.withColumnRenamed("id", "doc_id")


def p9_passages(spark, d):
    found = languages.passages(table(spark, d, "documents"), "doc_id", "text", "lang", ["source", "genre"])
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_counts, p2_found, p2_counts, p2_classes, p2_members, p3_found, p3_pieces, p4_found, p4_clean, p4_validation, p5_found, p5_shares, p6_found, p6_groups, p7_ids, p8_mix, p8_shares, p9_found, p9_passages)}
SQL: dict[str, str] = {}
