"""Operators against brute force and on nulls, empty tables, ties and clashing columns."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import context
from corpusloom.functions import identifiers as I
from corpusloom.functions import labels as L
from corpusloom.functions import prompts
from corpusloom.functions import text as T
from corpusloom.operators import dedup, edits, gates, intervals, leakage, sampling, scoring, similarity, sweeps, taxonomy, validation
from corpusloom.operators.components import connected_components
from corpusloom.sources import jsonl


def greedy(expected, predicted, fold=True):
    tidy = (lambda s: s.lower().strip()) if fold else (lambda s: s)
    rest, hits = list(predicted), 0
    for e in expected:
        for i, p in enumerate(rest):
            if tidy(e) in tidy(p) or tidy(p) in tidy(e):
                rest.pop(i)
                hits += 1
                break
    return hits


def test_greedy_hits(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["", "a", "ab", " Ab ", "b", "abc", "c a", "x"])
    rows = [([word() for _ in range(rng.randrange(5))], [word() for _ in range(rng.randrange(5))]) for _ in range(400)]
    df = spark.createDataFrame(rows, "e array<string>, p array<string>")
    for fold in (True, False):
        got = [r[0] for r in df.select(scoring.greedy_hits(F.col("e"), F.col("p"), fold)).collect()]
        assert got == [greedy(e, p, fold) for e, p in rows]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges + [edges[0]], "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    empty = spark.createDataFrame([], "u long, v long")
    assert connected_components(empty).count() == 0


def test_check_digits(spark):
    def national(d):
        w1, w2 = I.NATIONAL
        return len(d) == 11 and d.isdigit() and sum(a * int(b) for a, b in zip(w1, d)) % 11 == 0 and sum(a * int(b) for a, b in zip(w2, d)) % 11 == 0

    rng = random.Random(6)
    rows = [("".join(rng.choice("0123456789") for _ in range(rng.choice([9, 11, 16]))),) for _ in range(3000)] + [("",), (None,), ("12a45678901",)]
    got = spark.createDataFrame(rows, "d string").select("d", I.is_national_id(F.col("d")), I.is_organisation_number(F.col("d")), I.is_luhn(F.col("d"))).collect()
    for d, n, o, luhn in got:
        d = d or ""
        assert bool(n) == national(d)
        if len(d) == 9 and d.isdigit():
            check = (11 - sum(a * int(b) for a, b in zip(I.ORGANISATION, d)) % 11) % 11
            assert o == (check < 10 and check == int(d[8]))
        if len(d) == 16:
            s = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d))
            assert luhn == (s % 10 == 0)
    iban = spark.createDataFrame([("NO93 8601 1117 947",), ("NO9386011117948",), (None,)], "s string").select(I.is_iban_no(F.col("s")))
    assert [bool(r[0]) for r in iban.collect()] == [True, False, False]


def test_text_functions(spark):
    rows = [(None,), ("",), ("  \n",), ("Ærlig Åse bor i Oslo 12. Hei!  Nei?\nJa",), ("aaa aaa aaa",), ("x" * 50_000,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(T.skeleton(F.col("t"))).collect()]
    assert got[:4] == [None, "", "", "N N bor i N ##. N! N? N"]
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()][3][:2] == ["ærlig", "åse"]
    assert spark.createDataFrame([("aaaa", "aa"), ("ab", ""), (None, "a"), ("abc", "z")], "t string, s string").select(T.occurrences(F.col("t"), F.col("s"))).collect() == [([0, 1, 2],), ([],), ([],), ([],)]
    assert [r[0] for r in spark.createDataFrame([("aaaa", "aa"), ("ab", "")], "t string, s string").select(T.count_occurrences(F.col("t"), F.col("s"))).collect()] == [3, 0]
    j = spark.createDataFrame([([], []), (["a"], ["a", "b"]), (["a"], [])], "a array<string>, b array<string>").select(T.jaccard(F.col("a"), F.col("b")))
    assert [r[0] for r in j.collect()] == [1.0, 0.5, 0.0]
    assert [r[0] for r in spark.createDataFrame([("Hund",), ("hund",)], "s string").select(T.swap_first(F.col("s"))).collect()] == ["hund", "Hund"]


def test_labels_and_validation(spark):
    rows = [
        (1, "Kari Moe bor i Moe. Kari  Ås", {"PERSON": ["Kari Moe", "Moe", " Kari Moe ", "kari moe", "Kari Ås", "Kari Moe", "", None, "Per"], "ODD": ["x"], "AGE": None}),
        (2, None, {"PERSON": ["Kari"]}),
        (3, "tom", None),
        (4, "Moe Moes", {"PERSON": ["Moe", "Moes"]}),
        (5, "Moes", {"PERSON": ["Moe", "Moes"]}),
    ]
    df = spark.createDataFrame(rows, "id long, text string, output map<string,array<string>>")
    got = sorted(((r["id"], r["etype"], r["span"], r["code"]) for r in validation.violations(df, "id", "text", "output", ["PERSON", "AGE"]).collect()), key=str)
    want = [(1, "AGE", None, "bad_shape"), (1, "ODD", None, "unknown_type"), (1, "PERSON", " Kari Moe ", "padded_span"), (1, "PERSON", "", "empty_span"), (1, "PERSON", None, "empty_span"), (1, "PERSON", "Kari Moe", "duplicate_span"), (1, "PERSON", "Kari Ås", "whitespace_mismatch"), (1, "PERSON", "Per", "not_a_substring"), (1, "PERSON", "kari moe", "case_mismatch"), (2, "PERSON", "Kari", "not_a_substring"), (5, "PERSON", "Moe", "redundant_nested")]
    assert got == sorted(want, key=str)
    fixed = {(r["id"], r["etype"]): r["spans"] for r in validation.fixed(df, "id", "text", "output", ["PERSON"]).collect()}
    assert fixed == {(1, "PERSON"): ["Kari Moe", "Moe", "Kari  Ås"], (4, "PERSON"): ["Moe", "Moes"], (5, "PERSON"): ["Moe", "Moes"]}
    again = spark.createDataFrame([(1, rows[0][1], {"PERSON": fixed[1, "PERSON"]})], df.schema)
    assert {r["code"] for r in validation.violations(again, "id", "text", "output", ["PERSON"]).collect()} <= {"redundant_nested"}
    canon = spark.createDataFrame([({"A": ["x", "y", "x"], "B": []},), ({"A": ["y", "x"]},), ({"A": ["y"]},), (None,)], "m map<string,array<string>>").select(L.canonical(F.col("m"))).collect()
    assert canon[0] == canon[1] != canon[2] and canon[3][0] == "[]"
    assert validation.violations(df.limit(0), "id", "text", "output", ["PERSON"]).count() == 0


def test_intervals(spark):
    rng = random.Random(7)
    rows = [(g, a := rng.randrange(60), a + rng.randrange(1, 9)) for g in range(20) for _ in range(rng.randrange(9))] + [(0, None, 4)]
    want = []
    for g in {r[0] for r in rows}:
        out = []
        for a, b in sorted((a, b) for x, a, b in rows if x == g and a is not None):
            if out and a < out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(g, *x) for x in out]
    got = intervals.merge_intervals(spark.createDataFrame(rows, "g long, a long, b long"), ["g"], "a", "b")
    assert sorted((r["g"], r["a"], r["b"]) for r in got.collect()) == sorted(want)
    tags = ["O", "I-A", "I-A", "B-A", "I-B", "O", "B-B", "I-B"]
    bio = intervals.bio_spans(spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "g long, i long, t string"), ["g"], "i", "t")
    assert sorted((r["start"], r["end"], r["etype"]) for r in bio.collect()) == [(1, 2, "A"), (3, 3, "A"), (4, 4, "B"), (6, 7, "B")]
    kept = intervals.drop_contained(spark.createDataFrame([(1, 0, 5), (1, 1, 3), (1, 0, 5), (1, 4, 9)], "g long, a long, b long"), ["g"], "a", "b")
    assert sorted((r["a"], r["b"]) for r in kept.collect()) == [(0, 5), (4, 9)]
    w = spark.createDataFrame([(0,), (5,), (128,), (129,), (400,)], "n int").select(intervals.windows(F.col("n"), 128, 32)).collect()
    assert [r[0] for r in w] == [[], [0], [0], [0, 96], [0, 96, 192, 288]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text("xyz ", min_size=1, max_size=6)), max_size=20))
def test_contained(spark, rows):
    rows = sorted(set(rows))
    want = {(g, s) for g, s in rows if any(g == h and s != t and s in t for h, t in rows)}
    df = spark.createDataFrame(rows, "g string, s string")
    assert {(r[0], r[1]) for r in leakage.contained(df, "g", "s").collect()} == want


def test_splits_and_quotas(spark):
    t = spark.createDataFrame([("a", str(k)) for k in range(10)] + [("b", "x"), (None, "y"), (None, "z")], "s string, k string")
    got = dedup.holdout(t, "s", "k", "salt", 0.25).collect()
    n = {}
    for r in got:
        n.setdefault(r["stratum"], []).append(r["side"])
    assert n["a"].count("benchmark") == 2 and n["b"] == ["train"] and n[""].count("benchmark") == 1
    q = dedup.quotas(spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25)], "n string, s double"), "n", "s", 7).collect()
    assert sum(r["quota"] for r in q) == 7
    u = dedup.upsample(spark.createDataFrame([(1,), (2,)], "i long"), F.col("i")).count()
    assert u == 3
    assert dedup.conflicts(spark.createDataFrame([("t", {"A": ["x"]}), ("t", {"A": ["x"]}), ("u", None), (None, None)], "t string, m map<string,array<string>>"), "t", "m").collect()[0]["conflict"] is False


def test_taxonomy_prompts_and_gates(spark):
    cases = [
        ("GOV_ID", "AB 12", None, "UNRESOLVED"),
        ("GOV_ID", "01028012345", "", "NATIONAL_ID"),
        ("GOV_ID", "01028012345", "Fnr. stod i Førerkort nr. 01028012345", "DRIVER_LICENSE"),
        ("GOV_ID", "987654", "Org.nr: 987654321 (lisensnummer 987654)", "FIREARMS_LICENSE"),
        ("GOV_ID", "AB-1", "fartøyet med registreringsnummer AB-1", "VESSEL_REGISTRATION"),
        ("GOV_ID", "Oslo tingrett 2021", "Fnr. Oslo tingrett 2021", "CASE_NUMBER"),
        ("FAMILY_RELATION", "er gift", "", "MARITAL_STATUS"),
        ("FAMILY_RELATION", "giftig", "", "FAMILY_RELATION"),
        ("FAMILY_RELATION", "gift med far", "", "FAMILY_RELATION"),
        ("EMPLOYMENT_INFO", "Moe Fisk AS", "", "ORGANIZATION"),
        ("EMPLOYMENT_INFO", "daglig leder i Moe Fisk AS", "", "EMPLOYMENT"),
        ("HEALTH_INFO", "blind hund", "", "HEALTH"),
        ("HEALTH_INFO", "er blind", "", "DISABILITY"),
        ("HEALTH_INFO", "insulin mot diabetes", "", "HEALTH"),
        ("HEALTH_INFO", "tabletter", "", "MEDICATION"),
        ("FINANCIAL_INFO", "1234.56.78903", "", "BANK_ACCOUNT"),
        ("FINANCIAL_INFO", "NO93 8601 1117 947", "", "IBAN"),
        ("FINANCIAL_INFO", "12 345 678 9", "lånenummer 12 345 678 9", "BANK_ACCOUNT"),
        ("FINANCIAL_INFO", "skylder 5000 kroner", "", "FINANCIAL"),
        ("DATE_TIME", "12.03.1980", "født den 12.03.1980", "DATE_OF_BIRTH"),
        ("DATE_TIME", "12.03.2020", "møtet den 12.03.2020", "DATE_TIME"),
        ("DATE_TIME", "43 år gammel", "", "AGE"),
        ("NONE", "x", "", "UNRESOLVED"),
        ("PERSON", None, "", "PERSON"),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, etype string, span string, text string")
    got = {r["k"]: r["new_type"] for r in taxonomy.convert(df).collect()}
    assert [(c, got[k]) for k, c in enumerate(cases) if got[k] != c[3]] == []
    labels = spark.createDataFrame([("1", "A", "x"), ("1", "A", "y"), ("2", "B", "z")], "id string, type string, span string")
    texts = spark.createDataFrame([("1", "x y w"), ("2", "z")], "id string, text string")
    edit = lambda *rows: spark.createDataFrame(list(rows), "id string, type string, old string, new string")
    fixed = taxonomy.correct(labels, edit(("1", "A", "x", "w"), ("2", "B", "z", None)), texts)
    assert sorted(map(tuple, fixed.collect())) == [("1", "A", "w"), ("1", "A", "y")]
    for bad in (("1", "A", "q", None), ("1", "A", "x", "not there")):
        with pytest.raises(ValueError):
            taxonomy.correct(labels, edit(bad), texts)
    moved = taxonomy.migrate(spark.createDataFrame([("1", "NONE", "x", "a x"), ("1", "PERSON", "Kari", "Kari"), ("1", "PERSON", "", ""), ("2", "NONE", "y", None)], "id string, etype string, span string, text string"), spark.createDataFrame([("1", "NONE", "x", "AGE")], "id string, etype string, span string, new_type string"))
    assert sorted(map(tuple, taxonomy.migrated(moved).collect())) == [("1", "AGE", "x"), ("1", "PERSON", "Kari")]
    assert [tuple(r) for r in taxonomy.parked(moved).collect()] == [("2", "NONE", "y", "")]
    with pytest.raises(ValueError):
        taxonomy.add_layer(labels, labels.withColumn("type", F.lit("Q")), ["id", "type", "span"], ["A", "B"])
    replies = spark.createDataFrame([('<think>x {"A":["n"]}</think> ok {"A":["y","z"],"B":"w","C":3,"D":{"q":1}} end',), ("nothing",), (None,)], "r string")
    got = [r[0] for r in replies.select(prompts.parse_output(F.col("r"))).collect()]
    assert got[0] == {"A": ["y", "z"], "B": ["w"], "C": ["3"], "D": []} and got[1:] == [None, None]
    b = spark.createDataFrame([(-3,), (0,), (9,), (10,), (None,)], "n int").select(gates.bucket(F.col("n"), [0, 10])).collect()
    assert [r[0] for r in b] == ["0-9", "0-9", "0-9", "10+", None]
    report = scoring.report(scoring.match_counts(spark.createDataFrame([("1", {"PHONE": ["a b", "c"]}), ("2", {"AGE": ["9"]})], "id string, m map<string,array<string>>"), spark.createDataFrame([("1", {"PHONE": ["A B ", "c"], "URL": ["u"]})], "id string, m map<string,array<string>>"), "id", "m"))
    total = report.where("level = 3").first()
    assert (total["expected"], total["found"], total["exact"], total["lenient"]) == (3, 3, 1, 2)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text_input":"a","output":{"A":["x"],"B":"no","C":[1]}}\n\nnot json\n{"text_input":"b"}\n{"output":{}}\n{"text_input":"torn')
    good, bad = jsonl.read_records(spark, str(p))
    rows = {r["text_input"]: r["output"] for r in good.collect()}
    assert rows == {"a": {"A": ["x"], "B": None, "C": ["1"]}, "b": None}
    assert bad.count() == 3
    out = str(tmp_path / "out")
    jsonl.write_shards(good, out, 1, "text_input")
    assert spark.read.json(out).count() == 2
    q = tmp_path / "a.tsv"
    q.write_text('1\tPERSON\t"Kari" Moe\n2\tAGE\t\n')
    assert [tuple(r) for r in jsonl.read_additions(spark, str(q)).orderBy("id").collect()] == [("1", "PERSON", '"Kari" Moe'), ("2", "AGE", None)]


def test_streams(spark, tmp_path):
    from corpusloom.streaming import incremental

    folder = str(tmp_path)
    spark.createDataFrame([(k, "t%d" % (k % 3) if k else None) for k in range(20)], "i long, text string").repartition(3).write.parquet(folder + "/docs.parquet")
    assert incremental.new_digests(spark, folder, "docs", "text").count() == 3


def test_span_functions(spark):
    from corpusloom.functions import spans as S

    df = spark.createDataFrame([("Se ⟦PERSON: Kari Moe⟧ og ⟦AGE: 9 år⟧.",), ("åpen ⟦PERSON: x",), (None,)], "t string").select(S.strip_markers(F.col("t")).alias("s")).collect()
    assert df[0]["s"]["text"] == "Se Kari Moe og 9 år." and [tuple(x) for x in df[0]["s"]["spans"]] == [("PERSON", "Kari Moe"), ("AGE", "9 år")] and df[0]["s"]["balanced"] and not df[1]["s"]["balanced"]
    e = spark.createDataFrame([("den 1. mai klokken 12 og 1. mai klokken 12", "1. mai"), ("1. mai kl 9 og 1. mai", "1. mai"), ("x", "1. mai"), (None, "a")], "t string, s string").select(S.extended(F.col("t"), F.col("s")))
    assert [r[0] for r in e.collect()] == ["1. mai klokken 12", "1. mai", "1. mai", "a"]
    c = spark.createDataFrame([("Fnr og konto: ",), ("ingen",), ("personnummer ",), (None,)], "t string").select(S.nearest_cue(F.col("t"), ["fnr", "konto", "nummer", "personnummer"]))
    assert [r[0] for r in c.collect()] == ["konto", None, "personnummer", None]
    m = spark.createDataFrame([("A er her. Dette er en tekst. Dette er Kari.", ["Kari"])], "t string, p array<string>").select(S.without_sentences(F.col("t"), "^Dette", F.col("p")))
    assert m.first()[0] == "A er her. Dette er Kari."
    a = spark.createDataFrame([("FUNN|HEALTH| har vondt \nannet\nFUNN|AGE|9|år",), ("",), (None,)], "t string").select(S.parse_audit(F.col("t"))).collect()
    assert [tuple(x) for x in a[0][0]] == [("HEALTH", "har vondt"), ("AGE", "9|år")] and not a[1][0]
    q = spark.createDataFrame([("han har vondt i kneet", "sa han har vondt i kneet nå"), ("abc", "x y"), ("a b", "a b")], "t string, q string").select(S.trimmed_to_text(F.col("t"), F.col("q")))
    assert [r[0] for r in q.collect()] == ["han har vondt i kneet", None, "a b"]
    b = spark.createDataFrame([("Kari Moe bor.", [("PERSON", 0, 8)]), ("", [])], "t string, s array<struct<etype:string,start:int,end:int>>").select(S.bio_tags(F.col("t"), F.col("s"))).collect()
    assert [tuple(x) for x in b[0][0]] == [(0, "Kari", "B-PERSON"), (5, "Moe", "I-PERSON"), (9, "bor", "O")] and b[1][0] == []


def test_leak_checks_see_other_names(spark):
    rows = [
        ("train", "Kari Nordmann bor i Oslo, saken er 12.", {"PERSON": ["Kari Nordmann", "Ola"]}),
        ("test", "Anne Hansen bor i  Bergen, saken er 47.", {"PERSON": ["Anne Hansen"]}),
        ("val", "Noe helt annet enn treningen har.", {"PERSON": ["Kari Nordmann", "Kari Nordmann", None]}),
        ("val", None, None),
    ]
    df = spark.createDataFrame(rows, "split string, text string, output map<string, array<string>>")
    got = {r["kind"]: r["n"] for r in leakage.checks(df, "split", "text", "output").collect()}
    assert got == {"shared_text": 0, "shared_skeleton": 1, "shared_name": 1}


def test_full_sweep(spark):
    text = "Fnr 010203 12345 og 01020312345, org 987 654 321, tlf 22 33 44 55, konto 1234.56.78901, bil AB 12345, MAC 0a:1b:2c:3d:4e:5f, IP 10.0.0.1, se www.eks.no/a. Våpenkort nr. 123456, merke: kjennemerke R-12-B."
    text += " Møtet 3. mars 2024 kl. 14:30 og 04.05.2023, hun er 42 år, 0150 Oslo, 2024 Deres ref, 2020 2021, pass N12345678, e-post a.b@c.no, 2024-01-31."
    rows = [(1, text), (2, None), (3, ""), (4, "3. mai 2024 og 3. mai 2024 kl. 9")]
    got = sweeps.findings(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert all(dict(rows)[r["id"]][r["start_char"] : r["end_char"]] == r["match"] for r in got)
    assert sorted((r["pattern"], r["match"]) for r in got if r["id"] == 1) == sorted([
        ("fnr_like", "010203 12345"), ("fnr_like", "01020312345"), ("org_like", "987 654 321"), ("phone_like", "22 33 44 55"), ("account_like", "1234.56.78901"),
        ("plate_like", "AB 12345"), ("mac_like", "0a:1b:2c:3d:4e:5f"), ("ip_like", "10.0.0.1"), ("url_like", "www.eks.no/a"), ("firearms_like", "123456"), ("vessel_like", "R-12-B"),
        ("date_like", "3. mars 2024 kl. 14:30"), ("date_like", "04.05.2023"), ("date_like", "2024-01-31"), ("age_like", "42 år"), ("postal_like", "0150 Oslo"),
        ("document_number_like", "N12345678"), ("email_like", "a.b@c.no"),
    ])
    assert sorted((r["pattern"], r["match"]) for r in got if r["id"] == 4) == [("date_time_mixed", "3. mai 2024"), ("date_time_mixed", "3. mai 2024 kl. 9")]


def test_number_cues_of_near_numbers(spark, tmp_path):
    from corpusloom.plans import text_queries

    rows = [(1, "fnr 12345678901 og kontonummer 10987654321"), (2, "10987654321\n" + "x" * 60 + " fnr: 12345678901."), (3, "123456789012"), (4, None)]
    spark.createDataFrame(rows, "rec_id long, text_input string").write.parquet(f"{tmp_path}/combined_data.parquet")
    got = {tuple(r) for r in text_queries.number_cues(spark, str(tmp_path)).collect()}
    assert got == {(1, "12345678901", "fnr"), (1, "10987654321", "kontonummer"), (2, "10987654321", None), (2, "12345678901", "fnr")}


def test_context_before_a_span(spark):
    rows = [("ab12 og (12)", "12", "ab12 og ("), ("xx12", "12", "xx"), ("12", "12", ""), ("tekst", "12", ""), ("a.b a.b", "a.b", ""), ("æ\\\\E x", "x", "æ\\\\E ")]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, s string")
    assert [r[0] for r in df.select(context.before(F.col("t"), F.col("s"), 20)).collect()] == [r[2] for r in rows]
    assert df.select(context.before(F.col("t"), F.col("s"), 2)).first()[0] == " ("


def test_similar_pairs_and_greedy_keeping(spark):
    rng = random.Random(12)
    texts = []
    for k in range(30):
        w = [f"w{rng.randrange(400)}" for _ in range(60)]
        for j in range(rng.randrange(1, 5)):
            v = list(w)
            for _ in range(j):
                v[rng.randrange(60)] = f"x{rng.randrange(50)}"
            texts.append(" ".join(v))
    texts += [texts[0], texts[0], "kort", "", None]
    rng.shuffle(texts)

    def seqs(t):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [seqs(t) for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("s", F.lit(1))
    first = {}
    for k, x in enumerate(sets):
        if x:
            first.setdefault(frozenset(x), k)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and like(sets[a], sets[b]) >= 0.7} | {(first[frozenset(x)], k) for k, x in enumerate(sets) if x and first[frozenset(x)] != k}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, "id", "t", 0.7).collect()} == want and len(want) > 20
    kept = []
    for k, x in enumerate(sets):
        if not any(like(x, sets[j]) >= 0.7 for j in kept):
            kept.append(k)
    assert sorted(r["id"] for r in similarity.keep_first(df, "id", "t", 0.7).where("kept").collect()) == kept
    assert similarity.keep_first(df.limit(0), "id", "t").count() == 0


def test_three_pass_sample(spark):
    rng = random.Random(13)
    rows = []
    for k in range(400):
        labels = {t: ["x"] for t, p in (("A", 0.9), ("B", 0.3), ("C", 0.02)) if rng.random() < p}
        rows.append((k, labels if rng.random() < 0.97 else None, rng.random() < 0.1, rng.choice(["talk", "talk", "talk", "file", None])))
    df = spark.createDataFrame(rows, "id long, m map<string,array<string>>, hard boolean, tpl string")
    got = sampling.three_pass(df, "id", "m", "hard", "tpl", ["A", "B", "C"], 40, 5, 0.25, "s").collect()
    assert len(got) == len({r["id"] for r in got}) == 40
    of = dict((r[0], r) for r in rows)
    n_c = sum("C" in (r[1] or {}) for r in rows)
    assert sum("C" in (of[r["id"]][1] or {}) for r in got) >= min(5, n_c) and sum(r["hard"] for r in got) >= 10
    place = sorted(range(400), key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())
    first_c = [k for k in place if "C" in (of[k][1] or {})][: min(5, n_c)]
    assert set(first_c) <= {r["id"] for r in got}
    assert sampling.three_pass(df.limit(0), "id", "m", "hard", "tpl", ["A"], 5, 1, 0.2, "s").count() == 0


def test_source_split_and_strict_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "corpus", "a"), (2, "D1", "a"), (3, "corpus", "b"), (4, None, "c"), (5, "corpus", None)], "id long, source string, t string")
    out = sampling.split_by_source(df, "t", F.col("source") != "corpus", 0, "x")
    assert {r["id"]: r["part"] for r in sampling.assert_no_leak(out, "t").collect()} == {1: "test", 2: "test", 3: "train", 4: "train", 5: "train"}
    with pytest.raises(ValueError):
        sampling.assert_no_leak(out.withColumn("part", F.col("id").cast("string")), "t")
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": "1", "text_input": "x", "output": {"A": ["x"], "B": []}, "types": ["A"]}\n\n', encoding="utf-8")
    got = jsonl.read_strict(spark, [str(good)], ["A", "B"]).collect()
    assert [(r["id"], r["output"], r["types"]) for r in got] == [("1", {"A": ["x"]}, ["A"])]
    for name, line in (("b", '{"id": "1", "text_input": "x", "output": {"Q": ["x"]}}'), ("c", '{"id": "1", "output"')):
        (tmp_path / f"{name}.jsonl").write_text(line + "\n", encoding="utf-8")
        with pytest.raises(ValueError):
            jsonl.read_strict(spark, [str(tmp_path / f"{name}.jsonl")], ["A", "B"])


def test_phrases_and_crossing(spark):
    rows = [(1, "train", "Dømt for tyveri i fjor, og mer"), (2, "test", "dømt for tyveri"), (3, "test", "ingen ting her"), (4, "train", None), (5, "test", "Mistet jobben i fjor")]
    bank = [("dømt for tyveri", "benchmark"), ("mistet jobben i fjor", "train"), ("mistet jobben", "benchmark"), ("kort", "train"), ("finnes ikke i noen", "train")]
    df = spark.createDataFrame(rows, "id long, split string, t string")
    got = {(r["kind"], r["item"], r["documents"]) for r in leakage.crossing(df, "id", "t", F.col("split") == "train", bank).collect()}
    assert got == {("shared_text", "dømt for tyveri", 2), ("benchmark_in_train", "dømt for tyveri", 1), ("train_in_benchmark", "mistet jobben i fjor", 1)}
    assert leakage.crossing(df, "id", "t", F.col("split") == "train", []).count() == 0


def test_gates_of_planned_values(spark):
    t = ["[Navn saksbehandler] og <dato>", "se [1] og [lenke](http://x)", "sak XXX og NN.", "bil NN 12345 (sett inn dato)", "N.N. har 12345xxx", None, "", "{NAVN}"]
    df = spark.createDataFrame(list(enumerate(t)), "id long, t string")
    got = {(r["id"], r["kind"]): r["n"] for r in gates.placeholder_kinds(df, "id", "t").collect()}
    assert got == {(0, "square"): 1, (0, "angle"): 1, (2, "word"): 1, (2, "nn"): 1, (3, "fill"): 1, (4, "initials"): 1, (4, "word"): 1, (7, "brace"): 1}
    assert {r["id"]: r["ok"] for r in gates.placeholders(df, "id", "t").collect()} == {0: False, 1: True, 2: False, 3: False, 4: False, 6: True, 7: False}
    v = spark.createDataFrame([(1, "a b", {"A": ["a", "c", None, ""]}), (2, None, {"A": None}), (3, "x", None)], "id long, t string, m map<string,array<string>>")
    assert {tuple(r) for r in gates.verbatim(v, "id", "t", "m").collect()} == {(1, 2, 1, False), (2, 0, 0, True)}
    names = spark.createDataFrame([("Jonas Gahr Støre",), ("Kari Moe",), (None,)], "n string")
    c = spark.createDataFrame([(1, "Da kom Jonas Gahr Støre Hansen og Kari Moe-Dahl, kari Moe"), (2, None)], "id long, t string")
    assert {r["name"] for r in gates.name_collisions(c, "id", "t", names, "n").collect()} == {"Jonas Gahr Støre"}
    r = {x["id"]: x for x in gates.repetition(spark.createDataFrame([(1, "a b c d e f g h " * 4), (2, "kort"), (3, None)], "id long, t string"), "id", "t").collect()}
    assert r[1]["share"] == round((25 - 8) / 25, 6) and not r[1]["ok"] and r[2]["ok"] and 3 not in r


def test_absorbed_and_nested_spans(spark):
    rows = [
        (1, "to barn på 15 og 12 år. Fredrikstad Sjømat AS", {"AGE": ["12 år", "15"], "FAMILY_RELATION": ["to barn på 15 og 12 år"], "LOCATION": ["Fredrikstad"], "ORGANIZATION": ["Fredrikstad Sjømat AS"]}),
        (2, "12 år og et barn på 12 år i Moss", {"AGE": ["12 år"], "FAMILY_RELATION": ["barn på 12 år"], "LOCATION": ["Moss", None], "ORGANIZATION": None}),
        (3, None, {"AGE": ["1"]}),
        (4, "x", None),
    ]
    df = spark.createDataFrame(rows, "id long, t string, m map<string,array<string>>")
    got = {tuple(r) for r in edits.absorbed_spans(df, "id", "t", "m").collect()}
    assert got == {(1, "AGE", "12 år"), (1, "AGE", "15"), (1, "LOCATION", "Fredrikstad")}
    nested = spark.createDataFrame([(1, "abc bcd", {"A": ["bc", "abc", "bcd", "b"]}), (2, "aab a", {"A": ["a", "aa"]}), (3, "aaa", {"A": ["a", "aa"]})], "id long, t string, m map<string,array<string>>")
    assert {(r["id"], r["span"]) for r in edits.redundant_nested(nested, "id", "t", "m").collect()} == {(1, "bc"), (1, "b"), (3, "a")}
    assert edits.redundant_nested(nested.limit(0), "id", "t", "m").count() == 0


def test_edits_and_sections(spark):
    c = spark.createDataFrame([("POSTAL_CODE", "5055 Bergen"), ("POSTAL_CODE", "00-123"), ("ADDRESS", "5055 Bergen"), ("ADDRESS", "Vei 5, 5055 Bergen"), ("X", "5055 Bergen"), ("X", None)], "e string, s string")
    assert [r[0] for r in c.select(edits.conform(F.col("e"), F.col("s"))).collect()] == ["5055", None, None, "Vei 5, 5055 Bergen", "5055 Bergen", None]
    k = spark.createDataFrame([("corpus",), ("SYN-1",), ("D1",), (None,)], "s string")
    assert [r[0] for r in k.select(edits.source_kind(F.col("s"))).collect()] == ["corpus", "synthetic", "annotated", None]
    iv = spark.createDataFrame([([(0, 5), (3, 9), (5, 6), (5, 8)],), ([],)], "x array<struct<start:bigint,end:bigint>>")
    assert [[tuple(i) for i in r[0]] for r in iv.select(edits.first_of_overlapping(F.col("x"))).collect()] == [[(0, 5), (5, 8)], []]
    u = spark.createDataFrame([(0, 6, [(1, 3), (5, 9)]), (2, 2, [])], "a int, b int, c array<struct<start:int,end:int>>")
    assert [r[0] for r in u.select(edits.uncovered_characters(F.col("a"), F.col("b"), F.col("c"))).collect()] == [[0, 3, 4], []]
    f = spark.createDataFrame([("Wiśniewski Łódź Åse Øyvind é",)], "s string")
    assert f.select(edits.fold(F.col("s"))).first()[0] == "Wisniewski Lodz Ase Øyvind e"
    ages = spark.createDataFrame([("2000-02-29", "2021-02-28"), ("2000-02-29", "2021-03-01"), ("2000-05-01", "2020-05-01")], "b string, d string")
    assert [r[0] for r in ages.select(edits.age_on(F.col("b").cast("date"), F.col("d").cast("date"))).collect()] == [20, 21, 20]
    s = spark.createDataFrame([("a b c d e F g", "x A B C D E f"), ("a b", "a b"), (None, "a")], "a string, b string")
    assert [r["shared"] for r in edits.shares_run(s, "a", "b").collect()] == [True, False, False]
    body = "en to tre fire fem seks sju åtte"
    t = spark.createDataFrame([(1, f"{body} ni\n\n{body}\n\n\n{body} ti"), (2, "a\n\nb"), (3, None)], "id long, t string")
    parts = edits.sections(t, "id", "t")
    assert [tuple(r) for r in edits.repeated_section(parts, "id").collect()] == [(1, 1, 1)]
    assert min(r["budget"] for r in edits.section_budgets(parts, "id", 10).collect()) == 150
    p = edits.prefix_join(spark.createDataFrame([("Storgata 5",), ("Stor",), (None,)], "s string"), "s", spark.createDataFrame([("Stor",), ("Storgata",), ("",), (None,)], "p string"), "p")
    assert sorted(map(tuple, p.select("s", "prefix").collect())) == [("Stor", "Stor"), ("Storgata 5", "Stor"), ("Storgata 5", "Storgata")]
    b = edits.shortest_first(spark.createDataFrame([(k, k % 3) for k in range(7)] + [(9, None)], "id long, n int"), "id", "n", 2).collect()
    assert [r["id"] for r in sorted(b, key=lambda r: (r["batch"], r["length"], r["id"]))] == [0, 3, 6, 1, 4, 2, 5]
