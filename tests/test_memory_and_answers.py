"""The facade end to end, the seams, and the answer-side operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn import conversation, seams
from cairn.functions import text as tx
from cairn.memory import Memory
from cairn.operators import answers, claims, entities, identity
from cairn.streaming import learn


def test_memory_learns_asks_and_saves(spark, tmp_path):
    (tmp_path / "t.csv").write_text("probe,pressure\nCorridine,8 bar\nZanwestel,25 bar\n")
    m = Memory(spark, str(tmp_path / "store"))
    assert m.learn("The keeper counted the seals. The boat leaves at noon.", "#doc:log")["evidence"] == 2
    assert m.learn("The keeper counted the seals.", "#doc:log")["evidence"] == 0
    assert m.learn(str(tmp_path / "t.csv"))["facts"] == 2
    q = spark.createDataFrame([(1, "What pressure has Corridine?"), (2, "When does the boat leave?"), (3, "zzz")], "query_id int, query string")
    got = {r.query_id: (r.answer, r.abstained, r.from_graph) for r in m.ask(q).collect()}
    assert got == {1: ("8 bar", False, True), 2: ("The boat leaves at noon.", False, False), 3: (None, True, False)}
    # a second file says the same: a witness more, no second row
    (tmp_path / "u.csv").write_text("probe,pressure\nCorridine,8 bar\nZanwestel,26 bar\n")
    assert m.learn(str(tmp_path / "u.csv"))["facts"] == 2
    held = {(r.subject, r.value): (r.witnesses, round(r.trust, 3)) for r in m.records.collect()}
    assert held["Corridine", "8 bar"] == (2, 0.66) and len(held) == 3
    assert sorted(v[1] for k, v in held.items() if k[0] == "Zanwestel")[0] < 0.4  # a rival loses its voice
    m.records = m.records.filter("value <> '26 bar'")
    m.save()
    again = Memory(spark, str(tmp_path / "store"))
    assert again.evidence.count() == 2 and again.records.count() == 2
    assert again.run_mind(dt.datetime(2026, 1, 1)) == ["sleep"] and again.records.count() == 2
    assert {r.value for r in again.about("Corridine").collect()} == {"8 bar"}
    assert {r.source: r.lines for r in again.where("seal").collect()} == {}
    assert {r.source: r.lines for r in again.where("keepers").collect()} == {"#doc:log": 1}


def test_mind_derives_to_saturation(spark):
    m = Memory(spark)
    for a, b in [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "d"), ("d", "e")]:
        m.learn_cell(a, "in", b, "#doc:x")
    m.learn_cell("a", "in", "a", "#doc:x")  # its own subject: refused
    assert m.records.count() == 6
    done = m.run_mind(dt.datetime(2026, 1, 1))
    assert "derive" in done and done[-1] == "sleep"
    got = {(r.subject, r.value): r for r in m.records.filter("source = '#inference'").collect()}
    assert set(got) == {("a", "d"), ("a", "e"), ("b", "e"), ("c", "e")} and all(r.level == 1 for r in got.values())


def test_small_answer_operators(spark):
    row = spark.range(1).select(
        tx.without_marks(F.lit("The lamp (~ chat 2025) is #doc:a red")), tx.bare(F.lit("«lamp!»")), answers.shown_span(F.lit("2025-01-01").cast("date"), F.lit("2025-01-03").cast("date")),
        answers.months_between(F.lit("2024-11-30").cast("date"), F.lit("2025-02-01").cast("date")), seams.prompt(F.lit("a"), F.lit(None).cast("string")),
        answers.maxsim(F.array(F.array(F.lit(1.0), F.lit(0.0))), F.array(F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(0.0)))),
        answers.substance_ok(F.lit("red lamp"), F.lit("which lamp"), F.lit(""), F.lit("")), answers.substance_ok(F.lit("lamp"), F.lit("which lamp"), F.lit(""), F.lit("mill")),
        answers.field_ok(F.lit("8 bar"), F.lit("what pressure"), F.lit("pressure"), F.lit("pressure 9")),
    ).first()
    assert tuple(row) == ("The lamp is red", "lamp", "2 days (3 including the last day)", 3, "FACTS:\na\n\nQUESTION: ", 1.0, True, False, False)
    ranked = spark.createDataFrame([(1, 1, "s1", "#said", "me"), (1, 2, "s2", "#doc:a", None), (1, 3, "s3", "#doc:b", "me"), (1, 4, "s4", "#said", None), (1, 5, "s5", "#said", None)], "query_id int, rank int, sid string, source string, speaker string")
    named = spark.createDataFrame([(1, "#doc:b")], "query_id int, source string")
    assert [r.sid for r in answers.named_first(ranked, named).orderBy("place").collect()] == ["s3", "s2", "s1", "s4"]
    assert [r.sid for r in answers.speaker_first(ranked, "me").orderBy("rank").collect()] == ["s1", "s3", "s2", "s4", "s5"]


def test_stream_of_repeated_events(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    spark.createDataFrame([("a", day), ("a", day), ("b", day), ("b", day + dt.timedelta(minutes=3))], "k string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    run = learn.deduplicated_stream(stream, "k", "at").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_engine_retries_and_remembers():
    calls = []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("down")
        return prompt.upper()

    engine = conversation.Engine(call, wait=0.01, remembered=1)
    assert engine("a") == "A" and engine("a") == "A" and len(calls) == 3
    assert engine("b") == "B" and engine("a") == "A" and len(calls) == 5  # one prompt is remembered
    with pytest.raises(conversation.EngineTimeout):
        conversation.Engine(lambda p: 1 / 0, wait=5, budget=0.1)("x")
    with pytest.raises(ZeroDivisionError):
        conversation.Engine(lambda p: 1 / 0, tries=1)("x")


def test_replies_are_read(spark):
    df = spark.createDataFrame([(1, 'Sure: {"answer": "8 bar", "lines": [1, 3, 2, 4]} ok'), (2, "none"), (3, None), (4, '{"answer": "x", "lines": 2}')], "i int, r string")
    got = {r.i: (r.q.said, r.q.held) for r in df.select("i", conversation.quoted_reply(F.col("r")).alias("q")).collect()}
    assert got == {1: ("8 bar", [0, 2, 1]), 2: (None, None), 3: (None, None), 4: ("x", [1])}
    row = spark.range(1).select(conversation.listed_reply(F.lit("1. lamp\n- kettle, lamp\n")), conversation.verdict_reply(F.lit("Yes, it is.")), conversation.verdict_reply(F.lit("maybe")), conversation.shape(F.lit(" Count ")), conversation.shape(F.lit("x"))).first()
    assert tuple(row) == (["lamp", "kettle"], True, None, "count", "none")


def test_turns_keep_their_scope(spark):
    rows = spark.createDataFrame([("1", "#doc:harbour guide", "The boat leaves at noon."), ("2", "#doc:mill notes", "The boat of the mill is red."), ("3", "#doc:mill notes", "Kettle: 8 crowns.")], "sid string, source string, sentence string")
    turns = spark.createDataFrame([(1, 1, "user", "When leaves the boat in the harbour guide?", None), (1, 2, "assistant", "At noon.", None), (1, 3, "user", "What colour has the boat?", None), (1, 4, "user", "tell of the boat", "material"), (2, 1, "user", "zzz", None)],
                                  "conv_id int, turn int, role string, text string, shape string")
    told = spark.createDataFrame([(1, 1, ["#doc:harbour guide"])], "conv_id int, turn int, sources array<string>")
    assert {(r.conv_id, r.turn): r.scope for r in conversation.scopes(turns, told, rows).collect()} == {(1, 1): ["#doc:harbour guide"], (1, 3): ["#doc:harbour guide"], (1, 4): [], (2, 1): []}
    none = spark.createDataFrame([], "entity string, field string, value string")
    got = {(r.conv_id, r.turn): r for r in conversation.respond(rows, turns, none, told).collect()}
    assert got[1, 3].answer == "The boat leaves at noon." and got[1, 3].mark == "(~ harbour guide)" and got[2, 1].abstained
    assert [r.sentence for r in conversation.said_rows(turns).filter("sid = 'said:1:3'").collect()] == ["What colour has the boat?"]
    laid = conversation.material(rows, spark.createDataFrame([(1, "kettle")], "brief_id int, topic string"))
    assert {r.line for r in laid.collect()} >= {"Kettle: 8 crowns."}
    drafts = spark.createDataFrame([(1, 0, "the Kettle costs 8"), (1, 1, "the Kettle costs 9"), (1, 2, "so it stands")], "brief_id int, pos int, line string")
    assert [r.text for r in conversation.composed(drafts, laid).collect()] == ["the Kettle costs 8\nso it stands"]


def test_entity_lookups(spark):
    found = spark.createDataFrame([("1", "a", "lamp post"), ("1", "a", "red mill"), ("2", "a", "lamp post"), ("2", "a", "blue boat"), ("3", "b", "blue boat"), ("3", "b", "old keeper")], "sid string, source string, entity string")
    assert [r.sid for r in entities.witnesses(found, "lamp post", "red mill").collect()] == ["1"]
    chars = spark.createDataFrame([("1", 9), ("2", 5), ("3", 7)], "sid string, chars int")
    assert [r.sid for r in entities.meeting_or_bridge(found, chars, ["lamp post", "red mill"]).collect()] == ["1"]
    assert [r.sid for r in entities.meeting_or_bridge(found, chars, ["lamp post", "old keeper"]).collect()] == ["3", "2"]
    lines = spark.createDataFrame([("1", "a", ["the", "old", "lamp", "post", "stands"])], "sid string, source string, toks array<string>")
    names = spark.createDataFrame([("lamp post",), ("old lamp post",), ("stands",)], "entity string")
    assert {r.entity for r in entities.named_in(lines, names).collect()} == {"old lamp post", "stands"}


def test_claim_gate(spark):
    edges = spark.createDataFrame([("lamp", "harbour"), ("Ferry", "sea bird colony")], "subject string, value string")
    said = spark.createDataFrame([(1, 0, "Hello."), (1, 1, "The lamp is in the harbour."), (1, 2, "The lamp is in the mill."), (2, 0, "birds"), (3, 0, "my bank")], "answer_id int, pos int, sentence string")
    told = spark.createDataFrame([(1, 1, "harbour", "LAMP"), (1, 2, "lamp", "mill"), (2, 0, "ferry", "colonies"), (3, 0, "bank", "mine")], "answer_id int, pos int, subject string, value string")
    assert {r.answer_id: r.text for r in claims.verified(said, told, edges).collect()} == {1: "Hello. The lamp is in the harbour.", 2: "birds", 3: ""}
    assert {r.answer_id: r.text for r in claims.verified(said, told, edges, mode="ASSIST").collect()}[1].endswith("mill. ‹unverified›")
    echo = spark.createDataFrame([(3, "the bank is mine")], "answer_id int, said string")
    assert {r.answer_id: r.text for r in claims.verified(said, told, edges, echo).collect()}[3] == "my bank"


def test_quoted_answers(spark):
    lines = ["The valve holds 8 bar. It stands near the mill.", "The boat leaves at noon.", "The kettle is red; the lamp is blue."]
    rows = [(1, "What pressure holds the valve?", "The valve holds 8 bar.", [0]), (2, "What?", "The valve holds 9 bar.", [0]), (3, "What?", "x", [7]), (4, "What?", "The kettle is blue.", [2]),
            (5, "What?", "The valve holds 8 bar.", []), (6, "What?", "boat noon lamp", [1])]
    df = spark.createDataFrame([(i, q, s, lines, h) for i, q, s, h in rows], "answer_id int, question string, said string, lines array<string>, held array<int>")
    got = {r.answer_id: (r.accepted, r.why) for r in claims.quoted(df).collect()}
    assert got[1] == (True, None) and got[3] == (False, "lines") and got[5] == (False, "lines") and got[4] == (False, "joined") and got[6] == (False, "joined")
    assert not got[2][0]


def test_regions_and_assertions(spark):
    assert claims.regions([["a", "b", "c"], ["a", "b", "x"], ["q"], ["b", "x", "y"]]) == [0, 0, 2, 0]
    proofs = ["the boat leaves at noon", "the mill stands near water", "a kettle is red"]
    rows = [(1, "The boat leaves at noon.", proofs), (2, "Nothing is told of it.", proofs), (3, "whatever", proofs[:2]), (4, None, proofs)]
    got = {r.answer_id: r.asserted for r in claims.asserts_fact(spark.createDataFrame(rows, "answer_id int, answer string, proofs array<string>")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_choices_of_answers(spark):
    q, a, x = F.lit("what is red"), F.lit("the kettle stands red"), F.array(F.lit("the kettle stands red"))
    row = spark.range(1).select(claims.shortcut(q, a, x), claims.shortcut(F.lit("kettle red"), F.lit("red kettle"), F.array(F.lit("other"))), claims.shortcut(q, F.lit("mill"), x)).first()
    assert tuple(row) == ("accept", "refuse", None)
    proof = spark.createDataFrame([(1, "The harbour guide says so", 0, "the boat", "#doc:mill"), (1, "The harbour guide says so", 1, "so it says", "#doc:harbour guide"), (2, "boat at noon", 0, "a mill", "#a"), (2, "boat at noon", 1, "boat at noon", "#b")],
                                  "answer_id int, said string, place int, line string, origin string")
    assert {r.answer_id: r.origin for r in claims.load_bearing(proof, spark.createDataFrame([("#doc:tide board",)], "source string")).collect()} == {1: "#doc:harbour guide", 2: "#b"}
    c = spark.createDataFrame([(1, 0, "which boat", "a mill", "the boat", True), (1, 1, "which boat", "the boat", "the boat", True), (1, 2, "which boat", "the boat boat", "the boat", False), (2, 0, "q", "a", "b", None)],
                              "query_id int, place int, question string, said string, proof string, passes boolean")
    assert [(r.query_id, r.place) for r in claims.selected(c).collect()] == [(1, 1)]
    events = spark.createDataFrame([(1, "blue kettle", "was bought", "purchase"), (1, "lamp, kettle", "were sold", "sale"), (1, "mill", "burned", "loss")], "passage_id int, thing string, happened string, kind string")
    passages = spark.createDataFrame([(1, "#said", "I bought the blue kettles today")], "passage_id int, source string, text string")
    assert [(r.subject, r.value) for r in claims.events_told(events, passages).collect()] == [("blue kettle", "was bought")]


def test_identities(spark):
    labels = spark.createDataFrame([("valve", 7, 3)], "label string, key long, seen int")
    keys, all_ = identity.ensured(spark.createDataFrame([("Valve",), ("(mill)",), ("  ",)], "name string"), labels)
    got = {r.name: r.key for r in keys.collect()}
    assert got["Valve"] == 7 and got["(mill)"] > 0 and len(got) == 2
    assert {r.label for r in all_.filter(F.col("key") == got["(mill)"]).collect()} == {"(mill)", "mill"}
    assert identity.unit_identities(spark.createDataFrame([("mm",)], "token string")).first().key < 0
    known = spark.createDataFrame([(i, 1, 1, v) for i, v in [(1, "a"), (2, "b"), (3, "a")]] + [(4, 2, 1, "a")], "record_key long, subject long, predicate long, value string")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {r.record_key: r.field for r in identity.contradiction_fields(known, links).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    edges = spark.createDataFrame([("x", "causes", "y"), ("y", "causes", "z")], "subject string, predicate string, value string")
    assert [r.cause for r in identity.causes_of(edges, "z").collect()] == ["y"] and [r.effect for r in identity.effects_of(edges, "x").collect()] == ["y"]
    assert identity.neighbours(edges, spark.createDataFrame([("y",)], "key string")).count() == 2


def test_seams(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in df.select(seams.encoded(F.col("t"), lambda ts: [[1.0] for _ in ts])).collect()] == [[1.0], None]
    assert [r[0] for r in df.select(seams.judged("answers", F.col("t"), F.col("t"), F.col("t"), lambda k, q, a, e: 1.0 if q else 1 / 0)).collect()] == [1.0, None]
    assert [r[0] for r in df.select(seams.asked(F.col("t"), str.upper)).collect()] == ["A", None]
    with pytest.raises(Exception, match="no engine"):
        df.select(seams.asked(F.col("t"))).collect()
    rows = spark.createDataFrame([(1, "the lamp is red"), (2, None)], "k int, t string")
    got = seams.extracted(rows, "k", "t", lambda t: [("lamp", "colour", "red"), ("lamp", "colour", "blue")]).collect()
    assert [(r.k, r.value) for r in got] == [(1, "red")]


def test_answer_operators(spark):
    q = spark.createDataFrame([(1, "valves of the harbour guide"), (2, "zzzz")], "query_id int, query string")
    voc = spark.createDataFrame([("valve",), ("harbour",), ("guide",), ("the",)], "word string")
    assert {(r.query_id, r.word) for r in answers.unseen_demands(q, voc).collect()} == {(2, "zzzz")}
    src = spark.createDataFrame([("#doc:harbour guide",), ("#doc:mill guide",)], "source string")
    assert [(r.query_id, r.source) for r in answers.sources_named(q, src).collect()] == [(1, "#doc:harbour guide")]
    heads = spark.createDataFrame([("#doc:harbour guide", "price", "8 crowns"), ("#doc:mill guide", "price", "9 crowns")], "source string, head string, value string")
    asked = spark.createDataFrame([(1, "the price in the harbour guide"), (2, "the price")], "query_id int, query string")
    assert [(r.query_id, r.answer) for r in answers.record_answer(heads, asked).collect()] == [(1, "price: 8 crowns.")]
    lines = spark.createDataFrame([(1, dt.date(2025, 1, 2), "bought the lamp", "a"), (2, dt.date(2025, 3, 2), "sold the kettle", "a"), (3, None, "x", "b")], "sid long, day date, sentence string, source string")
    things = spark.createDataFrame([(1, "lamp"), (1, "kettle"), (2, "lamp"), (2, "gone")], "question_id int, thing string")
    assert [(r.question_id, r["first"]) for r in answers.order_of_two(lines, things).collect()] == [(1, "lamp")]
    assert [r.block for r in answers.telling(lines).collect()] == ["2025/01/02 bought the lamp\n2025/03/02 sold the kettle"]
    row = spark.createDataFrame([("8 bar, 9 crowns", "nine: 9 crowns at 8 bar", "three boats, 12 boats left", "how many boats")], "a string, b string, c string, d string")
    got = row.select(answers.spoken_row(F.col("a"), F.col("b")), answers.spoken_row(F.col("a"), F.col("c")), answers.stated_tally(F.col("c"), F.col("d")),
                     answers.line_admissible(F.lit("The Corridine holds 8"), F.lit("the corridine holds 8 bar")), answers.line_admissible(F.lit("then Zan holds 9"), F.lit("corridine 8"))).collect()[0]
    assert tuple(got) == ("nine: 9 crowns at 8 bar", "8 bar, 9 crowns", True, True, False)
