"""Leaks between training and benchmark sides, containment, and coherence of a cast."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

MIN_TEXT_CHARS = 12
# Ages and gaps in years.
PROFESSIONAL_AGE = (25, 67)
MAX_LIVING_PARENT_AGE = 100
PARENT_GAP = (16, 55)
MAX_SPOUSE_GAP = 15
MIN_SPOUSE_AGE = 18
MAX_ANY_AGE = 105
#: Phrases of a bank that one automaton takes.
MAX_BANK = 200_000


def report(df: DataFrame, split: str, text: str) -> DataFrame:
    """(kind, n): evaluation records whose text, or text up to its digits, stands in training too; texts of up to twelve characters are left out."""
    t = df.where(F.length(F.trim(text)) > MIN_TEXT_CHARS).select(split, F.md5(text).alias("shared_text"), F.md5(F.regexp_replace(text, "[0-9]", "#")).alias("shared_skeleton"))
    out = None
    for kind in ("shared_text", "shared_skeleton"):
        train = t.where(F.col(split) == "train").select(kind).distinct()
        n = t.where(F.col(split) != "train").join(train, kind, "left_semi").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def checks(df: DataFrame, split: str, text: str, labels: str) -> DataFrame:
    """(kind, n): evaluation records whose text, or skeleton (digits, capitalised words and white space evened out), stands in training
    too, and distinct PERSON values of both sides; texts of up to twelve characters are left out of the first two."""
    t = df.where(F.length(F.trim(text)) > MIN_TEXT_CHARS).select(split, F.md5(text).alias("shared_text"), F.md5(T.skeleton(F.col(text))).alias("shared_skeleton"))
    names = df.select(split, F.explode(F.try_element_at(labels, F.lit("PERSON"))).alias("shared_name"))
    out = None
    for kind, x in (("shared_text", t), ("shared_skeleton", t), ("shared_name", names)):
        train = x.where(F.col(split) == "train").select(kind).distinct()
        held = x.where(F.col(split) != "train").select(kind)
        held = held.distinct() if kind == "shared_name" else held
        n = held.join(train, kind, "left_semi").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def decontaminated(train: DataFrame, benchmark: DataFrame, text: str) -> DataFrame:
    """Training rows whose text no benchmark row has."""
    b = benchmark.where(F.col(text).isNotNull()).select(F.md5(text).alias("_digest")).distinct()
    return train.withColumn("_digest", F.md5(text)).join(b, "_digest", "left_anti").drop("_digest")


def words_in_texts(df: DataFrame, id_col: str, text: str, items: DataFrame, item: str) -> DataFrame:
    """(item, records): single-word items found in texts as whole words, in any case."""
    want = items.where(F.col(item).isNotNull()).select(F.lower(item).alias(item)).distinct()
    words = df.select(id_col, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias(item))
    return words.join(want, item).groupBy(item).agg(F.count("*").alias("records"))


def contained(df: DataFrame, group: str, text: str) -> DataFrame:
    """Distinct texts that are inside another text of their group.

    A text's word of most letters that is neither its first nor its last stands whole in any text that holds it, so they meet by
    that word; texts of up to two words meet by their characters' triples.
    """
    x = df.select(group, text).distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, 3)))
    words = lambda c: F.split(c, " ")
    inner = F.slice(words(F.col(text)), 2, F.greatest(F.lit(1), F.size(words(F.col(text))) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w
    long = x.where(F.size(words(F.col(text))) > 2).select(group, text, longest.alias("_key"))
    every = x.select(group, F.col(text).alias("_other"), F.explode(F.array_distinct(words(F.col(text)))).alias("_key"))
    one = long.join(every, [group, "_key"])
    short = x.where((F.size(words(F.col(text))) <= 2) & (F.length(text) > 2)).select(group, text, F.element_at(grams(F.col(text)), 1).alias("_key"))
    triples = x.select(group, F.col(text).alias("_other"), F.explode(grams(F.col(text))).alias("_key"))
    two = short.join(triples, [group, "_key"])
    tiny = x.where((F.size(words(F.col(text))) <= 2) & (F.length(text) <= 2)).select(group, text, F.col(text).alias("_key"))
    signs = x.select(group, F.col(text).alias("_other"), F.explode(F.array_distinct(F.flatten(F.array(F.split(text, ""), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 1)), lambda i: F.substring(text, i, 2)))))).alias("_key"))
    three = tiny.join(signs, [group, "_key"])
    met = one.unionByName(two).unionByName(three)
    return met.where((F.col("_other") != F.col(text)) & F.contains("_other", text)).select(group, text).distinct()


def phrases_in(df: DataFrame, id_col: str, text_col: str, bank: list[str]) -> DataFrame:
    """(id, item): phrases of the bank found in each text, also with their first letter in the other case.

    The bank is a small fixed list (``MAX_BANK``); one automaton over it goes once over each text.
    """
    if len(bank) > MAX_BANK:
        raise ValueError(f"a bank of {len(bank)} phrases; at most {MAX_BANK}")
    forms = {}
    for x in bank:
        forms.setdefault(x, x)
    for x in bank:
        if x[:1].isalpha():
            forms.setdefault(x[:1].swapcase() + x[1:], x)

    def run(batches):
        import ahocorasick

        find = ahocorasick.Automaton()
        for form, item in forms.items():
            find.add_word(form, item)
        find.make_automaton()
        for pdf in batches:
            rows = [(i, x) for i, t in zip(pdf["id"], pdf["text"]) if t for x in dict.fromkeys(v for _, v in find.iter(t))] if forms else []
            yield pd.DataFrame(rows, columns=["id", "item"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, item string")


def crossing(df: DataFrame, id_col: str, text_col: str, train: Column, bank: list[tuple[str, str]], least: int = MIN_TEXT_CHARS) -> DataFrame:
    """(kind, item, documents): shared_text for a phrase in documents of both sides, benchmark_in_train and train_in_benchmark for a phrase
    in documents of the other side than its own.

    ``bank`` is (phrase, side: train or benchmark). Phrases of fewer than ``least`` characters are left out. A phrase inside
    a longer one of the bank is not shared by itself; nor does one cross that is inside a longer one of the documents' side.
    """
    long = sorted({(x, side) for x, side in bank if x and len(x.strip()) >= least})
    own = {side: [x for x, y in long if y == side] for side in ("train", "benchmark")}
    every = [x for x, _ in long]
    inside = lambda x, others: any(x != y and x in y for y in others)
    t = df.withColumn("_side", F.when(train, "train").otherwise("benchmark"))
    found = None
    for side in ("train", "benchmark"):
        one = phrases_in(t.where(F.col("_side") == side).select(F.col(id_col).alias("i"), F.col(text_col).alias("x")), "i", "x", sorted(set(every))).groupBy("item").agg(F.count("*").alias(side))
        found = one if found is None else found.join(one, "item", "full")
    n = found.na.fill(0, ["train", "benchmark"])
    facts = [(x, side, inside(x, every), inside(x, own["train"]), inside(x, own["benchmark"])) for x, side in long]
    b = df.sparkSession.createDataFrame(facts, "item string, side string, in_any boolean, in_train boolean, in_benchmark boolean")
    j = n.join(b, "item")
    kinds = F.array_compact(
        F.array(
            F.when((F.col("train") > 0) & (F.col("benchmark") > 0) & ~F.col("in_any"), F.struct(F.lit("shared_text").alias("kind"), (F.col("train") + F.col("benchmark")).alias("documents"))),
            F.when((F.col("side") == "benchmark") & (F.col("train") > 0) & ~F.col("in_train"), F.struct(F.lit("benchmark_in_train").alias("kind"), F.col("train").alias("documents"))),
            F.when((F.col("side") == "train") & (F.col("benchmark") > 0) & ~F.col("in_benchmark"), F.struct(F.lit("train_in_benchmark").alias("kind"), F.col("benchmark").alias("documents"))),
        )
    )
    return j.select("item", F.explode(kinds).alias("k")).select("k.kind", "item", "k.documents")


def incoherent(role: Column, age: Column, subject: Column) -> Column:
    """All rules of ages that a member of a cast breaks; an empty array for none. A null age breaks none."""
    up, down = age - subject, subject - age
    rules = [
        ("too_old", age > MAX_ANY_AGE),
        ("negative_age", age < 0),
        ("parent_too_old", role.isin("parent", "guardian") & (age > MAX_LIVING_PARENT_AGE)),
        ("parent_gap", role.isin("parent", "guardian") & ~up.between(*PARENT_GAP)),
        ("child_gap", (role == "child") & ~down.between(*PARENT_GAP)),
        ("spouse_too_young", (role == "spouse") & (age < MIN_SPOUSE_AGE)),
        ("spouse_too_old", (role == "spouse") & (age > MAX_LIVING_PARENT_AGE)),
        ("spouse_gap", (role == "spouse") & (F.abs(up) > MAX_SPOUSE_GAP)),
        ("professional_age", (role == "professional") & ~age.between(*PROFESSIONAL_AGE)),
    ]
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))


def coherence(role: Column, age: Column, subject: Column) -> Column:
    """The first rule of ages that a member of a cast breaks, or ok."""
    up, down = age - subject, subject - age
    return (
        F.when(age > MAX_ANY_AGE, "too_old")
        .when((role == "parent") & (age > MAX_LIVING_PARENT_AGE), "parent_too_old")
        .when((role == "parent") & ~up.between(*PARENT_GAP), "parent_gap")
        .when((role == "child") & ~down.between(*PARENT_GAP), "child_gap")
        .when((role == "spouse") & (age < MIN_SPOUSE_AGE), "spouse_too_young")
        .when((role == "spouse") & (F.abs(up) > MAX_SPOUSE_GAP), "spouse_gap")
        .when((role == "professional") & ~age.between(*PROFESSIONAL_AGE), "professional_age")
        .otherwise("ok")
    )
