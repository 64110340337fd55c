"""The selecting stage of the repetition operator: what it selects is counted, and nothing else."""

import random

from corpusloom.functions.wordkit import words
from corpusloom.llm import queries, repetition


def test_repetition_counts_what_the_distance_selects(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    plain = lambda n: " ".join("ord%d" % rng.randrange(200) for _ in range(n))
    slight = lambda: (w := plain(rng.randrange(8, 11))) + ". " + plain(rng.randrange(60, 300)) + ". " + w
    mild = lambda: (w := plain(14)) + ". " + plain(45) + ". " + w + "."
    rows = [(k, slight() if k % 3 else plain(rng.randrange(60, 300))) for k in range(300)] + [(400 + k, mild()) for k in range(9)]
    rows += [(500 + k, rows[300][1]) for k in range(200)] + [(800, None), (801, ""), (802, "en to tre " * 5), (803, "en to tre fire fem seks sju"), (400, plain(90))]
    share = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        g = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        share[k] = (len(g) - len(set(g))) / len(g) if g else 0
    truth = sorted(rows[k][0] for k, x in share.items() if x > 0.06)
    df = spark.createDataFrame(rows, "rec_id long, text_input string")
    chosen = sorted(r["id"] for r in repetition.selected(df, "rec_id", "text_input").collect())
    assert set(truth) <= set(chosen) and sum(x > 0 for x in share.values()) > len(chosen) + 50
    df.write.parquet(f"{tmp_path}/combined_data.parquet")
    assert sorted(r["rec_id"] for r in queries.p5_found(spark, str(tmp_path)).collect()) == truth and len(truth) == 210
    stage = repetition.selected
    monkeypatch.setattr(repetition, "selected", lambda *a, **k: stage(*a, **k).where("id != 401"))
    assert sorted(r["rec_id"] for r in queries.p5_found(spark, str(tmp_path)).collect()) == [k for k in truth if k != 401]


def test_repetition_of_short_texts_alone(spark):
    rows = [(1, "en to tre fire fem seks sju åtte ni. " * 2), (2, "en to tre fire"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "rec_id long, text string")
    assert {r["id"]: r["outlier"] for r in repetition.outliers(df, "rec_id", "text").collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [(r["id"], r["share"]) for r in repetition.repetitive(df, "rec_id", "text").collect()] == [(1, 2 / 11)]


def test_runs_are_no_fewer_than_repeated_long_sequences():
    rng = random.Random(10)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "a", "a " * 8, "a " * 9]
    h, lens = repetition.flat_words(texts, repetition.WordHashes())
    got = repetition._measured(texts, h, lens)
    for t, n, run, long in zip(texts, lens, got["repeated_run"], got["all_long"]):
        w = words(t)
        of = lambda k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        short = of(4)
        again = [short[j] in short[:j] for j in range(len(short))]
        assert long == len(of(8)) and run == sum(all(again[j : j + 5]) for j in range(long)) >= len(of(8)) - len(set(of(8)))
