"""Operators for training data against small fixtures, brute force and round trips."""

import itertools
import random
import unicodedata
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from cairn.llm import bad_pairs, mixture, personal, same_look, survivor, tokens


# 1 ---------------------------------------------------------------------------------------------------------------

RUNS = "row_id long, question_id string, said string, gold string, text string, form string"


def test_one_form_of_look_alikes(spark):
    texts = {
        "Ｔhe vаlve": "The valve", "şe": "şe", "a​b﻿": "ab", "ﬂame": "flame", "K": "K", "17 m²": "17 m²",
        "17 m2": "17 m2", "İ": "İ", "İ": "İ", "ı": "ı", "\U0001f469‍\U0001f527": "\U0001f469‍\U0001f527",
        "\U0001f469\U0001f527": "\U0001f469\U0001f527", "": "", "​": "", "ệ": "ệ", "ệ": "ệ", "Φάς": "Φάς",
        "a‍‌b": "ab", "ی‌ا": "ی‌ا", "plain text.": "plain text.", "가": "가", "가": "가",
    }
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string")
    got = {r.text: r.form for r in same_look.one_form(rows).collect()}
    assert got == texts


def test_pairs_hold_only_equal_looks(spark):
    rows = [
        (1, "q", "a b", None, "x", "y"), (2, "q", "a b", "g", "x", "y"), (2, "q", "a b", "g", "x", "y"), (3, "q", "a b", "g‍", "x", "y"),
        (4, "q", "A b", None, "x", "y"), (5, "r", "a b", "g", "x", "y"), (6, None, "a b", "g", "x", "y"), (None, "q", "ａ b", "g", "x", "y"),
    ]
    df = spark.createDataFrame(rows, RUNS)
    got = {tuple(r) for r in same_look.same_look_pairs(df, "question_id", "row_id", ["said", "gold"]).collect()}
    assert got == {("said", 1, 2), ("said", 2, 3), ("gold", 2, 3)}
    assert same_look.same_look_pairs(df.limit(0), "question_id", "row_id", ["said"]).count() == 0


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    forms = ["valve", "vаlve", "val​ve", "Valve", "vаlve.", "ｖalve", "valvé", "valvé"]
    rows = [(i, rng.choice("ab"), rng.choice(forms), rng.choice(forms), "", "") for i in range(60)]
    df = spark.createDataFrame(rows, RUNS)
    form = {r.text: r.form for r in same_look.one_form(df, "said").union(same_look.one_form(df, "gold")).collect()}
    want = {
        (f, a[0], b[0]) for a, b in itertools.combinations(rows, 2) for f, i in (("said", 2), ("gold", 3))
        if a[1] == b[1] and a[i] != b[i] and form[a[i]] == form[b[i]]
    }
    assert {tuple(r) for r in same_look.same_look_pairs(df, "question_id", "row_id", ["said", "gold"]).collect()} == want


def test_forms_of_long_text_and_null(spark):
    long = "а́ " * 30_000
    df = spark.createDataFrame([(1, long, "k"), (2, None, "k"), (3, "", "k")], "row_id long, said string, form string")
    got = {r.row_id: r for r in same_look.with_forms(df, ["said"]).collect()}
    assert got[1].said == "á " * 30_000 and got[2].said is None and got[3].said == "" and got[1].form == "k"


def test_pieces_and_whole_texts_agree(spark):
    """Cutting at plain spaces changes no form, and neither does the way round for printable ASCII."""
    rng = random.Random(3)
    signs = ["a", "b", " ", " ", "é", "e\u0301", "\u0301", "\u0327", "\u200b", "\u00a0", "ｗ", "а", "한", "\u1112\u1161", "👩\u200d🔧", "\ufe0f", "\n", ".", "ﬁ", "\u3000"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["plain text only", "x " * 5_000 + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.form for r in same_look.one_form(df).collect()}
    whole = df.distinct().select("text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    want = {r.text: r.form or "" for r in whole.join(same_look.piece_forms(whole), ["h1", "h2"], "left").collect()}
    assert got == want and set(got) == set(texts)


def test_classes_hold_the_pairs(spark):
    rows = [(1, "q", "a b", None), (2, "q", "a\u00a0b", None), (3, "q", "a b", None), (4, "q", "c", None), (5, "r", "a\u200bb", None), (5, "r", "a\u200bb", None), (6, "r", "ab", "x")]
    df = spark.createDataFrame(rows, "row_id long, question_id string, said string, gold string")
    got = sorted(map(tuple, same_look.same_look_classes(df, "question_id", "row_id", ["said", "gold"]).collect()))
    assert got == [("said", 1, 1, 3, 2), ("said", 2, 1, 3, 2), ("said", 3, 1, 3, 2), ("said", 5, 5, 2, 2), ("said", 6, 5, 2, 2)]
    assert sorted(map(tuple, same_look.same_look_pairs(df, "question_id", "row_id", ["said", "gold"]).collect())) == [("said", 1, 2), ("said", 2, 3), ("said", 5, 6)]


def test_mapping_is_stable():
    """What a mapping gives is mapped to itself, so a form's form is the form."""
    table = {c: "".join(p for p, *_ in pieces) for c, pieces in same_look.mapping_rows()}
    again = [c for c, text in table.items() if "".join(table.get(x, x) for x in text) != text]
    assert not again
    assert all(unicodedata.normalize("NFD", t) == t for t in table.values())


# 2 ---------------------------------------------------------------------------------------------------------------

DYN = """record_key long, subject long, predicate long, value_text string, unit string, source string, level int, trust double,
    witnesses int, stated_at timestamp, last_seen timestamp, loaded_at timestamp, episodic boolean, sources array<string>, rank string, bundle string"""


def record(key, value="Eight bar", level=3, trust=0.5, witnesses=1, unit=None, source="a", at="2025-01-01", subject=1):
    day = datetime.fromisoformat(at) if at else None
    return (key, subject, 1, value, unit, source, level, trust, witnesses, day, day, datetime(2026, 1, 1), level != 5, [source or ""], "r", "b")


def test_fields_survive_by_rank(spark):
    rows = [
        record(1, " EIGHT BAR ", level=9, trust=float("nan"), unit="bar", source="unknown"), record(2, level=4, trust=2.0, source=" "), record(3, level=4, witnesses=3, at="1999-01-01"),
        record(3, level=4, witnesses=3, at="1999-01-01"), record(4, "other"), record(5, None), record(6, "single"), record(6, "single"), record(7, level=None, witnesses=0, trust=None, at=None, source=None),
    ]
    got = {(r.group_key, r.field): r.record_key for r in survivor.surviving_fields(spark.createDataFrame(rows, DYN)).collect()}
    assert got == {
        (1, "level"): 3, (1, "witnesses"): 3, (1, "stated_at"): 2, (1, "trust"): 3, (1, "source"): 3, (1, "unit"): 1,
    }


def test_survivors_of_nothing(spark):
    empty = spark.createDataFrame([], DYN)
    assert survivor.surviving_fields(empty).count() == 0
    assert survivor.surviving_records(empty).count() == 0
    assert survivor.surviving_bundles(empty).count() == 0


def test_branch_and_bound_equals_all_choices():
    rng = random.Random(1)
    for _ in range(200):
        options = {
            b: sorted(((rng.random(), {b: rng.randint(0, 2)}, (b, i)) for i in range(rng.randint(1, 4))), key=lambda o: -o[0]) for b in "xyz"
        }
        pairs = {(a, b) for a in range(3) for b in range(3) if rng.random() < 0.6}
        fits = lambda v: "x" not in v or "z" not in v or (v["x"], v["z"]) in pairs
        best = max(
            (sum(o[0] for o in c) for c in itertools.product(*options.values()) if fits({k: v for o in c for k, v in o[1].items()})), default=None
        )
        got = survivor.branch_and_bound(options, fits)
        assert (got is None) == (best is None)
        if got:
            assert sum(o[0] for b, os in options.items() for o in os if o[2] == got[b]) == pytest.approx(best)


def test_every_survivor_is_chosen_by_the_search(spark, monkeypatch):
    assert survivor.branch_and_bound({"b": [(5, {}, 1)], "a": [(7, {}, 2), (7, {}, 3)]}, lambda v: True) == {"a": 2, "b": 1}
    rows = spark.createDataFrame([record(1, level=4), record(2, witnesses=5, unit="bar")], DYN)
    plan = survivor.surviving_fields(rows)._jdf.queryExecution().toString()
    assert "choose(" in plan
    assert {(r.field, r.record_key) for r in survivor.surviving_fields(rows).collect()} == {
        ("level", 1), ("source", 1), ("stated_at", 1), ("trust", 1), ("unit", 2), ("witnesses", 1)}


def held(key, witnesses, episodic, **more):
    row = record(key, witnesses=witnesses, **more)
    return (*row[:12], episodic, *row[13:])


def test_bundles_keep_dependencies(spark):
    # the most trusted evidence has one witness, the most trusted standing is settled: both together are not allowed
    rows = [held(1, 1, True, trust=0.6), held(2, 0, False, trust=0.9), held(3, 2, True, trust=0.1), held(4, 1, True, trust=0.3)]
    got = {r.bundle: r.record_key for r in survivor.surviving_bundles(spark.createDataFrame(rows, DYN)).collect()}
    # 1 with its own standing (0.6 + 0.6) beats 3 with the settled one of 2 (0.1 + 0.9)
    assert got == {"evidence": 1, "standing": 1, "provenance": 2}


def test_groups_without_a_full_choice_keep_their_best_part(spark):
    # settled records of one witness only: evidence and standing exclude each other, the rest is free
    rows = [held(1, 1, False, trust=0.2, unit="bar"), held(2, 1, False, trust=0.9), held(3, 1, False, trust=0.4, subject=2), held(4, None, False, trust=0.7, subject=2)]
    got = {(r.group_key, r.bundle): r.record_key for r in survivor.surviving_bundles(spark.createDataFrame(rows, DYN)).collect()}
    assert got == {(1, "evidence"): 2, (1, "provenance"): 2, (1, "unit"): 1, (3, "standing"): 4, (3, "provenance"): 4}


def test_best_part_equals_all_choices():
    rng = random.Random(4)
    for _ in range(200):
        options = {b: sorted(((rng.random(), {b: rng.randint(0, 2)}, (b, i)) for i in range(rng.randint(1, 3))), key=lambda o: -o[0]) for b in "xyz"}
        pairs = {(a, b) for a in range(3) for b in range(3) if rng.random() < 0.15}
        fits = lambda v: "x" not in v or "z" not in v or (v["x"], v["z"]) in pairs
        choices = itertools.product(*([None, *options[b]] for b in "xyz"))
        best = max((sum(o is not None for o in c), sum(o[0] for o in c if o)) for c in choices if fits({k: v for o in c if o for k, v in o[1].items()}))
        got = survivor.best_part(options, fits)
        assert (len(got), sum(o[0] for os in options.values() for o in os if o[2] in got.values())) == (best[0], pytest.approx(best[1]))


# 3 ---------------------------------------------------------------------------------------------------------------

PAIRS = "pair_id long, question string, gold string, said string, abstained boolean, three string, word string"
Q = "What pressure does the Corridine valve hold?"


def test_defects(spark):
    whole = "The Corridine valve holds 8 bar at room temperature."
    stamp = " (~ chat 2025/08/08 (Fri) 12:20)"
    cases = {
        1: (Q, "8 bar", whole, None), 2: (Q, "8 bar", whole + stamp, None), 3: (Q, "8 bar", "8 bar", None), 4: (Q, "8 bar", None, "empty"), 5: (Q, "8 bar", " ​\n", "empty"),
        6: (Q, "8 bar", "n/a" + stamp, "empty"), 7: (Q, "8 bar", whole[:30], "truncated"), 8: (Q, "8 bar", whole + stamp[:20], "truncated"), 9: (Q, "8 bar", "The Corridine valve holds…", "truncated"),
        10: (Q, "8 bar", "Sorry, I couldn't find it in any of the sources.", "refusal"), 11: (Q, None, "I do not know.", None), 12: (Q, "This was never mentioned.", "I do not know.", None),
        13: (Q, "8 bar", Q.upper(), "echo"), 14: (Q, "8 bar", f"You asked: {Q}" + stamp, "echo"), 15: (Q, "8 bar", f"{Q} {whole}", None), 16: (Q, "8 bar", f"{Q} 8 bar.", None),
        17: (Q, "8 bar", "La válvula Corridine aguanta 8 bar, según la guía que se lee aquí.", "other_language"), 18: (Q, "8 bar", whole[:-1] + ' as the sign "El guarda apuntó las cifras dos veces" says.', None),
        19: (Q, "8 bar", "I don't know who wrote it, but here it is: " + whole, None), 20: (None, None, None, "empty"), 21: (Q, "8 bar", whole[:-1], None), 22: (Q, "8 bar", "9 bar", None),
    }
    rows = [(k, q, g, s, True, "t", "w") for k, (q, g, s, _) in cases.items()]
    got = {r.pair_id: r.defect for r in bad_pairs.defects(spark.createDataFrame(rows + rows[:4], PAIRS)).collect()}
    assert got == {k: d for k, (*_, d) in cases.items() if d}
    assert bad_pairs.defects(spark.createDataFrame([], PAIRS)).count() == 0


def test_endings_count_a_text_once_on_any_layout(spark):
    rows = [(k, Q, "8 bar", "The valve holds 8 bar. It opens at", True, "t", "w") for k in range(12)] + [(99, "Who?", "Ada", "Ada wrote it.", True, "t", "w")]
    once = {tuple(r) for r in bad_pairs.endings(spark.createDataFrame(rows[11:], PAIRS).coalesce(1)).collect()}
    many = bad_pairs.endings(spark.createDataFrame(rows, PAIRS).repartition(6))
    assert {tuple(r) for r in many.collect()} == once


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        asked = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        said = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        runs = {tuple(asked[i:j]) for i in range(len(asked)) for j in range(i + 1, len(asked) + 1)}
        hit, longest = bad_pairs.SuffixAutomaton(asked).copied(said)
        spans = [(i, j) for i in range(len(said)) for j in range(i + 1, len(said) + 1) if tuple(said[i:j]) in runs]
        assert longest == max((j - i for i, j in spans), default=0)
        assert hit == [any(i <= k < j and j - i >= 2 for i, j in spans) for k in range(len(said))]


# 6, 7 ------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, ids string, tokens string"


def test_ids_round_trip_and_parts(spark):
    texts = [None, "", "The boat <|endoftext|> leaves.", "ı̇ş 🙂 \x00 é", "word " * 40_000, "x" * 60_000]
    df = spark.createDataFrame([(i, t, None, "", "") for i, t in enumerate(texts)], DOCS)
    ids = tokens.encoded(df)
    assert ids.columns == ["doc_id", "ids"]
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got[0] == [] and got[1] == [] and max(got[2]) < 50_256
    back = {r.doc_id: r.text for r in tokens.decoded(ids).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    tokenizer = tokens.encoding(tokens.read_ranks())
    mixed = "a  b c\n d it's 12 " * 9_000
    assert tokens.encode(mixed, tokenizer) == tokenizer.encode_ordinary(mixed)
    assert tokens.encoded(df.limit(0)).count() == 0


def test_mixture_holds_shares_and_caps(spark):
    docs = [(i, "some words of a text " * (1 + i % 5), "big" if i % 10 else "small", "", "") for i in range(600)] + [(9_999, "x", None, "", ""), (9_998, None, "big", "", "")]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 4), ("gone", 0.2, 2), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixture.shares(df, targets, exact=True).collect()}
    assert set(report) == {"big", "small", "gone", "zero"}
    assert report["big"].actual_share == pytest.approx(0.625, abs=0.05) and report["small"].actual_share == pytest.approx(0.375, abs=0.05)
    assert report["gone"].actual_share == 0 and all(r.most_copies <= r.max_repeats for r in report.values())
    # the size is that of the corpus, and nothing falls short
    whole = sum(r.tokens for r in report.values())
    loose = {r.source: r for r in mixture.shares(df, targets.withColumn("max_repeats", F.lit(20))).collect()}
    assert sum(r.tokens_used for r in loose.values()) == pytest.approx(whole, rel=0.05) and not any(r.shortfall for r in loose.values())
    assert loose["big"].actual_share == pytest.approx(0.625, abs=0.03) and loose["gone"].tokens == 0
    tokenizer = tokens.encoding(tokens.read_ranks())
    assert whole == sum(len(tokenizer.encode_ordinary(d[1])) for d in docs if d[1] and d[2])
    # a cap that binds is reported, not made up for
    tight = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    short = {r.source: r for r in mixture.shares(df, tight).collect()}
    assert short["small"].most_copies == 1 and short["small"].shortfall == pytest.approx(0.5 * whole - short["small"].tokens, abs=1) and short["big"].shortfall == 0
    same = {r.source: r for r in mixture.shares(df, tight, exact=True).collect()}
    assert same["big"].actual_share == pytest.approx(0.5, abs=0.1) and same["small"].copies == 60 and same["small"].shortfall == 0
    assert all(r.within_cap and r.whole for r in mixture.limits(mixture.shares(df, targets)).collect())
    plan = mixture.mixture(df, targets)._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan"):]
    assert "SortMergeJoin" not in plan and "BuildLeft" not in plan  # no text is shuffled or broadcast
    out = mixture.mixture(df, targets, exact=True).collect()
    assert sum(r.n_tokens for r in out if r.source == "small") == report["small"].tokens_used
    assert {(r.doc_id, r.copy) for r in out} == {(r.doc_id, r.copy) for r in mixture.mixture(df.repartition(7), targets, exact=True).collect()}
    asked = {r.source: r for r in mixture.shares(df, targets, 10**9).collect()}
    assert asked["small"].rate == 4 and asked["big"].rate == 2
    assert mixture.mixture(df.limit(0), targets).count() == 0 and mixture.mixture(df, targets.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------

FOUND = [
    ("Reply to <leo.oskulent (at) post (dot) gannet (dot) invalid> before Friday.", {("email", "leo.oskulent (at) post (dot) gannet (dot) invalid")}),
    ("user@ is not a full address, @lantern_club and lib-tide@27.4.1 are none.", set()),
    ("Write to leo at post dot gannet dot invalid soon.", {("email", "leo at post dot gannet dot invalid")}),
    ("ferry Martha Star sailed; Lantern Row is closed between gates 22 and 2.", set()),
    ("On Tuesday Captain Martha Mirvadour-Ketradour's report arrived.", {("name", "Martha Mirvadour-Ketradour")}),
    ("AYLİN YORVUMANE'in raporu geldi. Sayın E. Dornockby ile konuştuk.", {("name", "AYLİN YORVUMANE"), ("name", "E. Dornockby")}),
    ("Kontakt: Halvivash, Greta", {("name", "Halvivash, Greta")}),
    ("The gauge at 192.0.2.27 answered in 782 ms. Nobody saw it.", set()),
    ("Meter reading: 108341014253. Order 426-3789 was closed on 2026-03-17. Batch 8196 787 26.", set()),
    ("Tel. (030) 23125-175 or +44 20 7946 0003", {("phone", "(030) 23125-175"), ("phone", "+44 20 7946 0003")}),
    ("call zero seven seven zero zero nine zero zero two four one now", {("phone", "zero seven seven zero zero nine zero zero two four one")}),
    ("TCKN 426 274 772 11 dosyada. Tel: 00005421424", {("id_number", "426 274 772 11"), ("phone", "00005421424")}),
    ("SSN: 953-18-9635, NI no. QQ 41 04 85 C, DNI: 85.901.571-O", {("id_number", "953-18-9635"), ("id_number", "QQ 41 04 85 C"), ("id_number", "85.901.571-O")}),
    ("Deliver to Flat 6, 113 Lantern Row, Dunmallow 00485 before noon.", {("address", "Flat 6, 113 Lantern Row, Dunmallow 00485")}),
    ("Anschrift: Seilerstraße 76\n00286 Tornhafen", {("address", "Seilerstraße 76\n00286 Tornhafen")}),
    ("vive en Calle del Farol 67, 2.º B, 00978 Isla Ferán. Al calentar", {("address", "Calle del Farol 67, 2.º B, 00978 Isla Ferán")}),
    ("Paketi gönder: Fener Sokak No: 73 D: 2, 00630 Kuzgunca", {("address", "Fener Sokak No: 73 D: 2, 00630 Kuzgunca")}),
    ("48B Cooper's Yard\n07700 900241", {("address", "48B Cooper's Yard"), ("phone", "07700 900241")}),
    ("Mаil: g​rаce@post.tеst, Tomás Yorvenzik", {("email", "g​rаce@post.tеst"), ("name", "Tomás Yorvenzik")}),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_personal_pieces(text, want):
    assert {(k, text[a:b]) for k, a, b in personal.found(text)} == want


def test_personal_table_and_mask(spark):
    rows = [(1, FOUND[0][0] * 2, None, "", ""), (1, FOUND[0][0] * 2, None, "", ""), (2, None, None, "", ""), (3, " ", None, "", ""), (4, "word " * 100_000 + FOUND[4][0], None, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id, r.kind) for r in personal.personal(df).collect()) == [(1, "email"), (4, "name")]
    out = {r.doc_id: r.text for r in personal.masked(df).collect()}
    assert out[2] is None and out[3] == " " and out[1] == "Reply to <[EMAIL]> before Friday." * 2 and out[4].endswith("Captain [NAME]'s report arrived.")
    assert personal.personal(df.limit(0)).count() == 0


def test_offsets_map_back():
    rng = random.Random(4)
    signs = ["a", "​", "é", "ｂ", "а", " (at) ", " ", "x", "\r\n", "ﬁ"]
    for _ in range(500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 12)))
        read, points = personal.plain(text)
        places = [personal._source(points, i) for i in range(len(read) + 1)]
        assert places == sorted(places) and places[-1] <= len(text)
        assert all(0 <= p <= len(text) for p in places)


# wordings that are in no list -------------------------------------------------------------------------------------------

# written for this test alone; the detector knows single words of denial and of knowing, no phrase
UNSEEN_REFUSALS = [
    "I have no data on that.", "That isn't something my notes cover.", "Nobody ever told me about it.", "I was never given that detail.", "There is no trace of it here.",
    "My records don't include this.", "I lack the context to say.", "I'm unable to determine it.", "It can't be confirmed from what I have.", "No source of mine states this.",
    "I regret I cannot recall that.", "None of the documents specify it.", "Bu konuda hiçbir veri yok.", "Bunu hatırlamıyorum.", "Kaynaklarda belirtilmemiş.", "Maalesef buna ulaşamadım.",
    "Elimde böyle bir not yok.", "Notlarda böyle bir şeye rastlamadım.", "Kimse bana anlatmadı.", "No recuerdo ese dato.", "Ninguna fuente lo menciona.", "No dispongo de esa información.",
    "Nadie lo ha dicho.", "Lamentablemente no sabría decirlo.", "Dazu habe ich keine Daten.", "Das geht aus den Notizen nicht hervor.", "Ich erinnere mich nicht daran.",
    "Leider habe ich keinen Hinweis.", "Niemand hat es mir gesagt.", "Das ist mir nicht bekannt.", "Keine meiner Quellen nennt das.",
]
PLAIN_DENIALS = [
    "The lamp is not red but blue.", "It leaves at noon, not at ten.", "Nothing was sold on Monday.", "No, the valve stands open.", "Kapı açık değil, kapalı.", "No, la caja está llena.",
    "Nein, das Boot fährt um neun.", "The mill has no roof.", "Der Kessel ist nicht rot.", "She never liked the tea.", "La puerta no es azul.", "Lamba kırmızı değil.",
]


def test_refusals_of_other_words():
    found = [t for t in UNSEEN_REFUSALS if bad_pairs.is_refusal("What does the mill cost?", t, "eight crowns")]
    assert len(found) >= 0.9 * len(UNSEEN_REFUSALS)
    assert not [t for t in PLAIN_DENIALS if bad_pairs.is_refusal("What does the mill cost?", t, "eight crowns")]


def test_copied_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        asked, said = ([rng.choice("abcd") for _ in range(rng.randint(1, 9))] for _ in range(2))
        runs = {tuple(asked[i:j]) for i in range(len(asked)) for j in range(i + 1, len(asked) + 1)}
        want = [any(i <= k < j and tuple(said[i:j]) in runs for i in range(len(said)) for j in range(i + 2, len(said) + 1)) for k in range(len(said))]
        hit, longest = bad_pairs.SuffixAutomaton(asked).copied(said)
        assert hit == want and longest == max((j - i for i in range(len(said)) for j in range(i + 1, len(said) + 1) if tuple(said[i:j]) in runs), default=0)


def test_given_names_are_learned(spark):
    """Names outside the fixed list, shown by the family names that others of the corpus bear."""
    families = ["Brackwell", "Tornhagen", "Kuzgunlar", "Feranzo"]
    texts = [f"We met {g} {f} at the mill." for f in families for g in ("Anna", "Peter")]
    texts += [f"Then {g} {f} came." for g in ("Zorvan", "Quillia") for f in families] + ["Quillia Brackwell and Zorvan Feranzo left.", "The Old Brackwell stands. Old Mill, Old Town, Old Harbour."] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], "doc_id long, text string")
    learned = personal.name_evidence(df)
    assert {r.word for r in learned.collect()} >= {"zorvan", "quillia"} and not {r.word for r in learned.collect()} & {"then", "old", "met"}
    lacking = {r.found for r in personal.personal(df).collect()}
    got = {r.found for r in personal.personal(df, given=learned).collect()}
    want = {f"{g} {f}" for g in ("Zorvan", "Quillia") for f in families}
    assert not want & lacking and want <= got
    assert personal.name_evidence(df.limit(0)).count() == 0
