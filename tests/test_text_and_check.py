"""Text kernel and evidence checks against hand-made goldens."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import check


def column(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_fold_keeps_length(spark):
    texts = ["İstanbul", "ISPARTA", "ılık", "Straße", "ΣΊΣΥΦΟΣ ς", "µ", ""]
    got = column(spark, texts, tx.fold)
    assert got == [tx.fold_text(t) for t in texts]
    assert [len(g) for g in got] == [len(t) for t in texts]


def test_tokens_and_words(spark):
    assert column(spark, ["IPX7Ayak 8gDDR4 mAh é", "Tier 3 of 2 kg", None, "abcDeF abcDefGhi"], tx.tokens) == [
        ["ipx", "7", "ayak", "8", "gddr", "4", "mah", "é"], ["tier", "3", "of", "2", "kg"], None, ["abc", "def", "abc", "def", "ghi"]]
    assert column(spark, ["Tier 3 of 2 kg on it", "no so"], tx.words) == [["tier", "3", "of", "2", "kg"], []]


def test_composition_of_marked_rows_only(spark):
    df = spark.createDataFrame([(1, "é"), (2, "e"), (3, None)], "i int, t string")
    got = {r.i: r.t for r in tx.composed(df, "t").collect()}
    assert got == {1: unicodedata.normalize("NFC", "é"), 2: "e", 3: None}


def test_sentences_names_stamps(spark):
    assert column(spark, ["One. Two!\nThree", " \n ", ""], tx.sentences) == [["One.", "Two!", "Three"], [], []]
    assert column(spark, ["#docx:Delegation Basics.docx", "#said", "chat 2023/04/09 (Sun) 09:00"], tx.source_name) == ["Delegation Basics", "said", "00"]
    days = column(spark, ["chat 2023/04/09 (Sun) 09:00", "#docx:manual", "log 2023/13/45"], tx.stamp_day)
    assert [str(d) for d in days] == ["2023-04-09", "None", "None"]


@pytest.mark.parametrize("text,want", [
    ("5 m", (5, 5, "m")), ("100 V -240 V", (100, 240, "v")), ("-3 °C", (-3, -3, "°c")), ("15,6 kg", (15.6, 15.6, "kg")), ("8 GB,", (8, 8, "gb")),
    ("14.4 V / 6500 mAh", (14.4, 14.4, "v")), ("360 * 380 mm", (360, 360, None)), ("none", None), ("", None), (None, None),
])
def test_measure(spark, text, want):
    got = column(spark, [text], tx.measure)[0]
    assert (tuple(got) if got else None) == want


def test_sql_functions_are_the_column_functions(spark):
    tx.register(spark)
    texts = ["-3,5 mm to 7 mm", "20 °C - 25 °C", "1.2.3", "IPX7Ayak 8gDDR4 İŞ", "50 %, 6", "e\u0301 4 KM.", "", None]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("sql_texts")
    spoken = spark.sql("SELECT t, cairn_measure(t) m, cairn_tokens(t) k, cairn_fold(t) f FROM sql_texts")
    built = spark.table("sql_texts").select("t", tx.measure(F.col("t")).alias("m"), tx.tokens(F.col("t")).alias("k"), tx.fold("t").alias("f"))
    assert spoken.collect() == built.collect()


def test_overlap_is_three_valued(spark):
    rows = [("8 g", "9 g"), ("3 kg", "3 cm"), ("100 V -240 V", "220 V"), ("x", "3 g")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = df.withColumn("a", tx.measure(F.col("a"))).withColumn("b", tx.measure(F.col("b"))).orderBy("i").select(tx.overlap(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [False, None, True, None]


def test_stems_equal_brute_force(spark):
    words = ["plan", "plans", "planets", "planet", "plane", "bandında", "bandındadır", "band", "valve", "valves", "valley", "abc", "abd", "ab"]

    def root(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select("a", "b", tx.same_stem(F.col("a"), F.col("b")).alias("s"), tx.kin(F.col("a"), F.col("b")).alias("k")).collect():
        n = root(r.a, r.b)
        tails = max(len(r.a), len(r.b)) - n <= 3
        assert r.s == (r.a == r.b or n >= 5 and tails), (r.a, r.b)
        assert r.k == (r.a == r.b or n >= 3 and tails), (r.a, r.b)


def test_record_pairs(spark):
    got = column(spark, ["WARRANTY: 2 years. LIST PRICE: 40 crowns.", "The source of the difficulty is this: x", "· 3. DURATION: 5 days"], tx.record_pairs)
    assert [[(p.head, p.value) for p in g] for g in got] == [[("WARRANTY", "2 years"), ("LIST PRICE", "40 crowns")], [], [("DURATION", "5 days")]]


CHECKS = [
    ("The valve holds 8 bar.", "The valve holds 8 bar at room temperature.", True, 1.0),
    ("The valve holds 9 bar.", "The valve holds 8 bar at room temperature.", False, 1.0),
    ("The cellar valve holds 8 bar.", "The valve holds 8 bar at room temperature.", True, 0.833333),
    ("", "anything", True, 0.0), (None, None, True, 0.0), ("1. The valve holds 8 bar", "The valve holds 8 bar", True, 1.0),
    ("Tier 1", "Tier 3 and room 1", False, 1.0),
]


def test_check_examples(spark):
    df = spark.createDataFrame([(i, a, e, "x") for i, (a, e, _, _) in enumerate(CHECKS)], "i int, answer string, evidence string, ok string").drop("ok")
    got = check.check(df, "answer", "evidence").orderBy("i").collect()
    assert [(r.figures_ok, round(r.coverage, 6)) for r in got] == [(f, c) for _, _, f, c in CHECKS]
    assert [r.ok for r in got] == [f and c == 1.0 for _, _, f, c in CHECKS]


def test_grounded_sentences_drop_mixtures(spark):
    df = spark.createDataFrame([(1, "Nobody told me. The valve holds 8 bar. The valve was obsoleted yesterday.", "The valve holds 8 bar."), (2, "One only", "x"), (3, None, None)], "i int, a string, e string")
    got = {r.i: r.kept for r in check.grounded_sentences(df, "i", "a", "e").collect()}
    assert got[1] == "Nobody told me. The valve holds 8 bar." and got[2] == "One only" and not got[3]


def test_specific_and_grounded_in(spark):
    r = spark.createDataFrame([("a", "in", "b"), ("a", "in", "c"), ("b", "in", "c")], "subject string, predicate string, value string")
    assert {(x.subject, x.value) for x in check.specific(r).collect()} == {("a", "b"), ("b", "c")}
    df = spark.createDataFrame([("blue kettle", "the kettle"), ("lamp", "the kettle"), ("a", "b")], "v string, m string")
    assert [x[0] for x in df.select(check.grounded_in(F.col("v"), F.col("m"))).collect()] == [True, False, True]
