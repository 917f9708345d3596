"""Store, retrieval, record graph, entity graph, plans and streams on small fixtures."""

import datetime as dt
import io
import json
import math
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import entities, nested, records, retrieve, schema_drift, seats, store
from cairn.plans import algebra
from cairn.sources import readers
from cairn.streaming import learn


def test_windows_and_dedup(spark):
    text = " ".join(f"Line {i}." for i in range(8))
    docs = spark.createDataFrame([(1, text, None), (2, "A. a. A.", "s"), (3, None, "s"), (4, "", "s")], "doc_id long, text string, source string")
    rows = store.sentence_rows(docs)
    got = {(r.size, r.start) for r in store.windows(rows).filter("doc_id = 1").collect()}
    assert got == {(3, 0), (3, 2), (3, 4), (6, 0), (6, 2), (12, 0)}
    assert sorted(r.pos for r in store.deduplicated(rows).filter("doc_id = 2").collect()) == [0]


def test_table_reading(spark):
    text = "intro\n| probe | range |\n|---|---|\n| A | 1 V |\n| B | 2 V |\nend\nOne 1\nTwo 2\nThree 2\nFour 9"
    lines = store.line_rows(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    assert {(r.name, r.value) for r in store.table_records(lines).collect()} == {("probe", "A"), ("probe", "B"), ("range", "1 V"), ("range", "2 V")}
    assert [(r.start, r.lines) for r in store.locator_runs(lines).collect()] == [(6, 4)]


def test_layout_of_a_shattered_table():
    cells = ["probe", "12 V", "a long remark", "x"] * 5
    period = store.row_period([len(c) for c in cells])
    assert period == 4
    assert store.cut_rows(cells, period) == [cells[i : i + 4] for i in range(0, 20, 4)]
    assert store.row_period([3] * 5) is None
    assert store.anchor_level([0, 4, 4, 4] * 4, 4) == 0


def brute_cut(lengths, period, anchors, profile):
    """The cheapest cost over all ways to cut, by trying each."""
    loose, n = max(1.0, sum(profile) / len(profile)), len(lengths)

    def rest(i):
        best = loose * (n - i) if not any(a >= i for a in anchors) else math.inf
        for w in (period - 1, period, period + 1):
            inside = sum(i <= a < i + w for a in anchors)
            if w >= 2 and i + w <= n and inside <= 1:
                cost = sum(abs(lengths[i + k] - profile[min(k, period - 1)]) for k in range(w)) + loose * (abs(w - period) + (inside == 0))
                best = min(best, cost + rest(i + w))
        return best

    return min(loose * i + rest(i) for i in range((anchors[0] if anchors else 0) + 1))


def test_rows_are_cut_at_least_cost(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(40):
        n, period = int(rng.integers(6, 12)), int(rng.integers(2, 4))
        lengths, anchors = rng.integers(1, 9, n).tolist(), sorted(rng.choice(n, 2, replace=False).tolist())
        profile = rng.integers(1, 9, period).astype(float)
        assert store._Run(lengths, period, anchors).solve(profile)[0] == pytest.approx(brute_cut(lengths, period, anchors, profile.tolist()))
    # a heading above, and one cell wrapped onto a second line
    rows = [["Pump", "8 bar and more", "12", "red"], ["Hose", "6 bar at noon", "14", "blue"], ["Tank", "9 bar by night", "7", "long text", "wrapped"], ["Lamp", "3 bar in rain", "21", "grey"], ["Mill", "5 bar of wind", "30", "green"]]
    cells = ["List", *(c for r in rows for c in r)]
    anchors = [i for i, c in enumerate(cells) if c in {r[0] for r in rows}]
    assert store.cut_rows(cells, 4, anchors) == rows


def test_tables_of_texts(spark):
    body = "\n".join(x for i in range(5) for x in (f"Part{chr(97 + i)}", f"   {i} bar and some more", f"   1{i}", "   red"))
    long = "\n".join("This is a long line of plain prose that tells much about the harbour and its keeper." for _ in range(4))
    docs = spark.createDataFrame([(1, f"{long}\n{body}\n{long}"), (2, "name|size|price\n---|---|---\nlamp|3|8\nkettle|4|9"), (3, "a\tb\tc\nd\te\tf\ng\th"), (4, None), (5, "")], "doc_id int, text string")
    got = {}
    for r in store.table_windows(docs).orderBy("doc_id", "at").collect():
        got.setdefault((r.doc_id, r.kind), []).append(r.text)
    assert got[1, "row"] == [f"Part{chr(97 + i)} · {i} bar and some more · 1{i} · red" for i in range(5)]
    assert got[2, "delimited"][1:] == ["name: lamp · size: 3 · price: 8", "name: kettle · size: 4 · price: 9"]
    assert got[3, "delimited"] == ["a · b · c", "d · e · f"]


def test_locators_go_and_named_columns_stay(spark):
    rows = [(1, i, t) for i, t in enumerate(["Harbour 3", "Mill 7", "Ferry 12", "Lamp"])] + [(2, i, t) for i, t in enumerate(["Thing   Page", "Harbour 3", "Mill 7", "Ferry 12"])]
    got = {(r.doc_id, r.pos): r.line for r in store.without_locators(spark.createDataFrame(rows, "doc_id int, pos int, line string")).collect()}
    assert [got[1, i] for i in range(4)] == ["Harbour", "Mill", "Ferry", "Lamp"] and [got[2, i] for i in range(1, 4)] == ["Harbour 3", "Mill 7", "Ferry 12"]


def test_known_item_retrieval(spark):
    texts = [f"The {a} near {b} was counted on page {i}" for i, (a, b) in enumerate((a, b) for a in ("valve", "kettle", "lantern", "compass") for b in ("saltmere", "tornhafen", "kuzgunca", "oskel"))]
    rows = spark.createDataFrame([(f"1:{i}", "#doc:x" if i % 2 else "#doc:y", t) for i, t in enumerate(texts)], "sid string, source string, sentence string")
    queries = spark.createDataFrame([(i, " ".join(w for w in t.split() if w in ("valve", "kettle", "lantern", "compass", "saltmere", "tornhafen", "kuzgunca", "oskel"))) for i, t in enumerate(texts)], "query_id int, query string")
    top = {r.query_id: r.sid for r in retrieve.find(rows, queries).filter("rank = 1").collect()}
    assert top == {i: f"1:{i}" for i in range(len(texts))}
    turned = retrieve.find(rows, queries.limit(1), most=3, rerank=lambda t: list(range(len(t)))[::-1]).collect()
    assert len(turned) <= 3
    assert {r.source: r.lines for r in retrieve.where(rows, "valves").collect()} == {"#doc:y": 2, "#doc:x": 2}


def lines_of(spark, texts):
    return spark.createDataFrame([(f"1:{i}", s, t) for i, (s, t) in enumerate(texts)], "sid string, source string, sentence string")


def test_field_names_are_keyed(spark):
    long = "many words stand in this line of plain prose without any figure at all"
    texts = [("a", t) for t in ("Bellek: 8 g", "The big Working Pressure Limit : 9", "Screen 15 inch wide", "15 inch screen", "see the section 11", f"{long} 7 of it: none 3", "Kasa gri | Pil 4 saat sürer", *[long] * 7)]
    got = {(int(r.sid[2:]), r.word) for r in store.key_words(lines_of(spark, texts)).collect()}
    assert got == {(0, "bellek"), (1, "working"), (1, "pressure"), (1, "limit"), (2, "screen"), (5, "of"), (6, "pil")}


def test_scores_group_words_and_double_field_names(spark):
    texts = [("a", "Pressure: 8 bar"), ("a", "some pressure arose there"), ("b", "pressures fell there again"), ("b", "valve stood open"), ("c", "nothing else happened")]
    rows = lines_of(spark, texts)
    q = spark.createDataFrame([(1, "pressure pressures"), (2, "valve")], "query_id int, query string")
    lengths = rows.select("sid", F.size(tx.words(F.col("sentence"))).alias("n_words"))
    got = {(r.query_id, r.sid): r.score for r in retrieve.scored(q, store.postings(rows), store.key_words(rows), lengths, 0.0).collect()}
    mean = (3 + 4 + 4 + 3 + 3) / 5
    part = lambda held, n: math.log(1 + 5 / held) / (0.8 + 0.2 * n / mean)
    want = {(1, "1:0"): 2 * part(3, 3), (1, "1:1"): part(3, 4), (1, "1:2"): part(3, 4), (2, "1:3"): part(1, 3)}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_fusion_and_interleaving(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), ("c", 1)], "key string, rank int")
    assert [x.key for x in retrieve.rrf(r).orderBy("place").collect()] == ["b", "a", "c"]
    one, two = spark.createDataFrame([("a", 1), ("b", 2)], "key string, rank int"), spark.createDataFrame([("b", 1), ("c", 2)], "key string, rank int")
    assert [x.key for x in retrieve.interleave(one, two, 3).orderBy("place").collect()] == ["a", "b", "c"]


def brute_seats(lines, most):
    """The whole ranking (source, words) in one walk."""
    cap, many = max(1, min(2, most - 1)), len({x[1] for x in lines}) > 1
    taken, over = [], []
    for sid, source, words in lines:
        close = sum(seats.near(set(w), set(words)) for _, _, w in taken)
        full = close >= (1 if many else cap) or many and sum(x[1] == source for x in taken) >= cap
        (over if full or len(taken) == most else taken).append((sid, source, words))
    return [x[0] for x in (taken + over)[:most]]


def test_seats_see_the_whole_ranking(spark):
    w = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03d}")
    rows = [(1, 99.0 - i, f"s{i}", "A" if i < 4 else "B", f"word{w(i)} other{w(i)} third{w(i)}") for i in range(6)]
    # one source holds the first 300 lines, and many lines repeat
    rows += [(2, 900.0 - i, f"t{i:03d}", "A" if i < 300 else f"C{i}", f"word{w(i % 40)} other{w(i % 40)} third{w(i % 40)}") for i in range(310)]
    rows += [(3, 50.0 - i, f"u{i}", "A", "same words here always") for i in range(9)]
    df = spark.createDataFrame(rows, "query_id int, score double, sid string, source string, sentence string")
    got = {}
    for r in seats.seats(df, 4, chunk=8).orderBy("seat").collect():
        got.setdefault(r.query_id, []).append(r.sid)
    want = {q: brute_seats([(r[2], r[3], r[4].split()) for r in rows if r[0] == q], 4) for q in (1, 2, 3)}
    assert got == want and got[1] == ["s0", "s1", "s4", "s5"] and got[2] == ["t000", "t001", "t300", "t301"]
    assert seats.seats(df.limit(0), 4).count() == 0


def test_later_statement_speaks(spark):
    rows = [(1, 1, "a", "chat 2023/05/25 (Thu)", "my best time of 27 minutes"), (1, 2, "b", "chat 2023/06/01 (Thu)", "the best time of 25 minutes now"),
            (1, 3, "c", "manual", "best time of 30 minutes"), (2, 1, "d", "log 2024/01/01", "weight of 3 kg"), (2, 2, "e", "log 2024/01/01", "weight of 4 kg")]
    df = spark.createDataFrame(rows, "query_id int, seat int, sid string, source string, sentence string")
    assert sorted(r.sid for r in seats.without_superseded(df).collect()) == ["b", "c", "d", "e"]


def test_measurement_gets_a_seat(spark):
    texts = [("m", "Screen 15 mm"), ("m", "width 12 inch"), ("m", "width 9 inch"), ("m", "depth 7 mm"), ("m", "the screen of this device is bright and shows many menus of all kinds")] + [("m", f"screen menu number {w} opens here") for w in "abcdefgh"]
    rows = lines_of(spark, texts)
    q = spark.createDataFrame([(1, "how many inches has the screen")], "query_id int, query string")
    got = retrieve.find(rows, q, most=2).collect()
    assert "Screen 15 mm" in {r.sentence for r in got} and len(got) <= 3


def claims(spark, rows):
    return spark.createDataFrame(rows, "subject string, predicate string, value string, source string, level int, at timestamp")


def test_admission_counts_witnesses_once(spark):
    day = dt.datetime(2025, 1, 1)
    got = records.admitted(claims(spark, [("a", "p", "x", "s1", 4, day), ("a", "p", "x", "s1", 4, day), ("a", "p", "x", "s2", 4, day), ("a", "p", "y", None, 5, day)])).collect()
    assert [(r.witnesses, round(r.trust, 6)) for r in got] == [(2, round(0.6 + 0.4 * 0.15, 6))]


def test_arbitration_and_sleep(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(1, "a", "p", "x", 4, 2, day, 0.6, True), (2, "a", "p", "y", 4, 1, day, 0.7, True), (3, "a", "p", "x", 2, 1, day, 0.5, True), (4, "b", "p", "z", None, None, None, 0.05, True), (5, "c", "p", "z", 5, 1, day, 0.7, True)]
    df = spark.createDataFrame(rows, "record_key long, subject string, predicate string, value string, level int, witnesses int, at timestamp, trust double, episodic boolean")
    got = {r.record_key: (r.lost, r.new_trust) for r in records.arbitrated(df).collect()}
    assert got == {1: (False, 0.6), 2: (True, 0.2), 3: (False, 0.5), 4: (False, 0.05), 5: (False, 0.7)}
    slept = {r.record_key: (r.new_trust, r.now_episodic) for r in records.slept(df.withColumn("last_seen", F.col("at")), F.lit(dt.datetime(2025, 2, 1))).collect()}
    assert slept[1] == (0.65, False) and slept[2] == (0.67, True) and slept[4] == (0.05, True) and slept[5] == (0.7, True)


def test_closure_equals_brute_force(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("y", "y")]
    df = spark.createDataFrame([("p", *e) for e in edges], "predicate string, subject string, value string")
    known = {e for e in edges if e[0] != e[1]}
    while more := {(a, d) for a, b in known for c, d in known if b == c and a != d} - known:
        known |= more
    assert {(r.subject, r.value) for r in records.closure(df).collect()} == known
    assert [r.closed for r in records.triangles(spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "a", "c")], "predicate string, subject string, value string")).collect()] == [1]


def test_closure_of_a_long_chain(spark):
    df = spark.createDataFrame([("p", i, i + 1) for i in range(36)], "predicate string, subject int, value int").coalesce(1)
    assert {(r.subject, r.value, r.hops) for r in records.closure(df).collect()} == {(i, j, j - i) for i in range(37) for j in range(i + 1, 37)}


def test_labels_and_lookup(spark):
    labels = spark.createDataFrame([("Harbour", 1, 5), ("harbour", 2, 9), ("Kettle", 3, None)], "label string, key long, seen int")
    names = spark.createDataFrame([("HARBOUR",), ("harbours",), ("kettles!",), ("zzz",)], "name string")
    assert {r.name: r.key for r in records.resolved(names, labels).collect()} == {"HARBOUR": 2, "harbours": 2, "kettles!": 3, "zzz": None}
    cells = spark.createDataFrame([("Corridine valve", "pressure", "8 bar"), ("Corridine", "pressure", "9 bar"), ("Corridine valve", "colour", "blue")], "entity string, field string, value string")
    q = spark.createDataFrame([(1, "What pressure has the Corridine valve?"), (2, "What is it?"), (3, "What pressure and colour has the Corridine valve?")], "question_id int, question string")
    assert {r.question_id: r.value for r in records.lookup(cells, cells.select("entity").distinct(), q).collect()} == {1: "8 bar"}


def test_pagerank_equals_power_iteration(spark):
    links = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 3.0), ("a", "c", 1.0)]
    df = spark.createDataFrame([(a, b, 1, g) for a, b, g in links], "a string, b string, k11 long, g2 double")
    near: dict = {}
    for a, b, g in links:
        near.setdefault(a, {})[b] = g
        near.setdefault(b, {})[a] = g
    score = {"a": 1.0}
    for _ in range(entities.ROUNDS):
        new = {"a": 1 - entities.DAMPING}
        for n, v in score.items():
            for m, g in near[n].items():
                new[m] = new.get(m, 0) + entities.DAMPING * v * g / sum(near[n].values())
        score = new
    got = {r.entity: r.score for r in entities.pagerank(df, spark.createDataFrame([("w", "a"), ("w", "gone")], "walk string, entity string")).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in score.items()}
    assert [r.entity for r in entities.linked(df, "c").collect()] == ["d", "b", "a"]
    assert {r.entity for r in entities.communities(df, least=1).collect()} == set("abcd")


def test_collocations_find_the_phrase(spark):
    rows = [(f"{i}", "s", ["old", "mill", f"w{i}", f"v{i}"]) for i in range(6)] + [(f"x{i}", "s", [f"w{i}", "other", f"z{i}"]) for i in range(6)]
    df = spark.createDataFrame(rows, "sid string, source string, toks array<string>")
    got = {r.gram: r for r in entities.collocations(df).collect()}
    assert set(got) == {"old mill"} and got["old mill"].cohesion == pytest.approx(math.log(6 * 42 / 36), abs=1e-6)


def test_communities_leave_out_what_most_sources_hold(spark):
    held = {"head": "stuv", "a": "s", "b": "s", "c": "st", "x": "u", "y": "u", "z": "uv"}
    sources = [*"stuv", ""]
    found = spark.createDataFrame([(f"{src}{e}", src, e) for e, all_ in held.items() for src in [*all_, ""]], "sid string, source string, entity string")
    lines = spark.createDataFrame([(src, src) for src in sources], "sid string, source string")
    assert {r.entity for r in entities.everywhere(found, lines).collect()} == {"head"}
    few = lines.filter("source in ('s', 't')")
    assert entities.everywhere(found.filter("source in ('s', 't')"), few).count() == 0
    links = [("a", "b", 2.0), ("a", "c", 2.0), ("b", "c", 2.0), ("x", "y", 2.0), ("x", "z", 2.0), ("y", "z", 2.0)] + [(min(e, "head"), max(e, "head"), 9.0) for e in "abcxyz"]
    df = spark.createDataFrame([(a, b, 1, g) for a, b, g in links], "a string, b string, k11 long, g2 double")
    groups: dict = {}
    for r in entities.communities(df, common=entities.everywhere(found, lines)).collect():
        groups.setdefault(r.label, set()).add(r.entity)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["x", "y", "z"]]


def brute_phrases(lines, longest=5, least=3, pmi=1.0):
    """Phrases of token lists by the definition: cohesive, sticky, free and maximal."""
    n, beside, total = {}, {}, sum(map(len, lines))
    for toks in lines:
        for size in range(1, longest + 1):
            for i in range(len(toks) - size + 1):
                gram = tuple(toks[i : i + size])
                n[gram] = n.get(gram, 0) + 1
                for side, at in ((0, i - 1), (1, i + size)):
                    if 0 <= at < len(toks):
                        near = beside.setdefault((gram, side), {})
                        near[toks[at]] = near.get(toks[at], 0) + 1
    keep = {}
    for gram, count in n.items():
        if len(gram) < 2 or count < least:
            continue
        parts = [(n[gram[:cut]], n[gram[cut:]]) for cut in range(1, len(gram))]
        cohesion = min(math.log(count * total / (a * b)) for a, b in parts)
        sticky = all(max(count / a, count / b) > 0.5 for a, b in parts)
        free = all(2 * max(beside.get((gram, side), {"": 0}).values()) <= count for side in (0, 1))
        if cohesion >= pmi and sticky and free:
            keep[gram] = (count, round(cohesion, 6))
    inside = {h[i : i + k] for h in keep for k in range(2, len(h)) for i in range(len(h) - k + 1)}
    return {" ".join(g): v for g, v in keep.items() if g not in inside}


def test_phrases_of_four_and_five_words_equal_brute_force(spark):
    rng, names = random.Random(3), ["red salt mill road", "great bay of tall ships", "old harbour master", "iron gate", "one two three four five six"]
    lines = [[f"w{rng.randint(0, 999)}", *rng.choice(names).split(), f"v{rng.randint(0, 999)}"] for _ in range(150)]
    df = spark.createDataFrame([(str(i), f"s{i % 7}", t) for i, t in enumerate(lines)], "sid string, source string, toks array<string>")
    found = entities.collocations(df)
    got = {r.gram: (r.n, r.cohesion) for r in found.collect()}
    assert got == {g: (n, pytest.approx(c, abs=1e-6)) for g, (n, c) in brute_phrases(lines).items()}
    assert {"red salt mill road", "great bay of tall ships"} <= set(got)
    held = entities.mentions(df, found.select(F.col("gram").alias("entity"))).groupBy("entity").count().collect()
    assert {r.entity: r["count"] for r in held} == {g: sum(g in " ".join(t) for t in lines) for g in got}


def test_long_lines_are_whole(spark):
    rows = spark.createDataFrame([("1", "s", " ".join(f"word{i}" for i in range(250)) + " far end")], "sid string, source string, sentence string")
    assert entities.line_tokens(rows).first().toks[-3:] == ["249", "far", "end"] and entities.line_tokens(rows).select(F.size("toks")).first()[0] == 502
    found = spark.createDataFrame([(sid, "s", f"e{i:03}") for sid, n in (("1", 90), ("2", 3)) for i in range(n)], "sid string, source string, entity string")
    got = {(r.a, r.b): r.k11 for r in entities.edges(found, spark.createDataFrame([(9,)], "total long")).collect()}
    assert got == {(f"e{i:03}", f"e{j:03}"): 1 + (j < 3) for j in range(90) for i in range(j)}


def test_plans(spark):
    d = dt.date
    lines = spark.createDataFrame([(1, d(2025, 1, 3), "bought a lamp", 5.0), (2, d(2025, 2, 1), "bought a kettle", 8.0), (3, d(2025, 2, 9), "sold a kettle", 4.0), (4, None, "kettle talk", None)], "sid long, day date, sentence string, amount double")
    value = lambda p, **k: [tuple(r) for r in algebra.run(p, lines, **k).collect()]
    assert value("a = anchor: bought\nb = latest: kettle\nc = span: a, b") == [(37,)]
    assert value("l = lines: kettle\nc = count: l") == [(3,)]
    assert value("a = amount: lamp\nb = amount: sold\nc = per: a, b") == [(1.25,)]
    assert value("n = now:", now=F.lit(d(2026, 1, 1))) == [(d(2026, 1, 1),)]
    assert algebra.run("a = anchor: x\nb = span: a, a", lines, read=False) is None
    for bad in ("", "a = nothing: x", "a = span: b, c", "a = anchor:", "l = lines: x\ns = span: l, l", "a = now:\n" * 2, "\n".join(f"a{i} = now:" for i in range(7))):
        assert algebra.parsed(bad) is None
    assert algebra.run("l = lines: kettle\nc = count: l", lines, want=("days",)) is None


def test_keyed_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "x", "s1", 4), ("a", "x", "s1", 4), ("a", "x", "s2", 4), ("b", "y", "s1", 1)], "subject string, value string, source string, level int").write.parquet(str(src))
    stream = spark.readStream.schema("subject string, value string, source string, level int").parquet(str(src))
    q = learn.reinforced(stream).writeStream.outputMode("update").format("memory").queryName("witnessed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.subject: (r.witnesses, r.trust) for r in spark.table("witnessed").collect()}
    assert got == {"a": (2, 0.66), "b": (1, 0.3)}
    done = learn.learn_into(stream, str(tmp_path / "out"), str(tmp_path / "c2"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


# ---- readers --------------------------------------------------------------------------------------------------------


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="S"/></sheets></workbook>')
        cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{r}"><v>{v}</v></c>'
        rows = [["Title"], ["probe", "range", "power"], ["A", 5.0, 40.5], ["B", 6.0, 41.0]]
        body = "".join(f'<row r="{i}">' + "".join(cell(f"{'ABC'[j]}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("probe;range\nA;5 m\nB;\n")
    assert [r.row for r in readers.learned(spark, str(tmp_path / "a.csv")).collect()] == [{"probe": "A", "range": "5 m"}, {"probe": "B"}]
    (tmp_path / "b.xlsx").write_bytes(workbook())
    assert [r.row for r in readers.learned(spark, str(tmp_path / "b.xlsx")).filter("row is not null").collect()] == [
        {"probe": "A", "range": "5", "power": "40.5"}, {"probe": "B", "range": "6", "power": "41"}]
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    assert readers.learned(spark, str(tmp_path / "c.xlsx")).collect()[0].text.startswith("BadZipFile")
    (tmp_path / "d.txt").write_text("One. Two.")
    got = readers.learned(spark, str(tmp_path / "d.txt")).collect()[0]
    assert (got.source, got.text) == ("#text:d.txt", "One. Two.")
    assert readers.learned(spark, "plain words", "me").collect()[0].source == "me"
    for bad in (str(tmp_path), str(tmp_path / "gone.csv")):
        with pytest.raises(ValueError):
            readers.learned(spark, bad)


def test_small_readers(spark):
    cells = ["Range: 5 m, Max power: 40 W", "Height 410 mm", "Height of the mast 410 mm", "410 mm high", "Height 410 mm net weight", "A: 1 B2: 3", None, ""]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", readers.key_values(F.col("c")).alias("k"), readers.leading_value(F.col("c")).alias("l")).orderBy("i").collect()
    assert [None if r.k is None else [tuple(p) for p in r.k] for r in got] == [[("Range", "5 m"), ("Max power", "40 W")], [], [], [], [], [("A", "1 B2: 3")], None, []]
    assert [None if r.l is None else tuple(r.l) for r in got][1:6] == [("Height", "410 mm"), None, None, ("Height", "410 mm net weight"), ("A:", "1 B2: 3")]
    rows = [("t", 0, ["", "a", "b"]), ("t", 1, ["", "c", "d"]), ("t", 2, ["x", "e", "f"]), ("u", 0, ["k", "v", "w"]), ("u", 1, ["", "v", "w"])]
    df = spark.createDataFrame(rows, "source string, pos int, cells array<string>")
    assert {(r.source, r.pos): r.cells for r in readers.without_sparse_first(df, "source").collect()} == {
        ("t", 0): ["a", "b"], ("t", 1): ["c", "d"], ("t", 2): ["e", "f"], ("u", 0): ["k", "v", "w"], ("u", 1): ["", "v", "w"]}
    assert sorted((r.key, r.value) for r in readers.table_claims(df.filter("source = 't'")).collect()) == [("a", "b"), ("c", "d"), ("e", "f")]
    fetch = lambda title, language: ("text", "url") if language == "en" and title == "Lamp" else 1 / 0
    found = readers.summaries(spark.createDataFrame([("Lamp",), ("Gone",), (None,)], "title string"), fetch).collect()
    assert sorted(map(tuple, found)) == [("Gone", "", ""), ("Lamp", "text", "url")]


def test_preambles_become_rows(spark):
    rows = [("#xlsx:a", "Stock", 0, "Keeper: hut 12 Season: spring", None), ("#docx:b", "prose", 0, "Note: none.", None), ("#pdf:c", "error", 0, "PDF needs a reader", None), ("#text:d", "t", 0, "<b><i><u></u></i></b>x", None)]
    df = spark.createDataFrame(rows, "source string, part string, pos int, text string, row map<string,string>")
    assert [r.row for r in readers.with_preambles(df).filter("row is not null").collect()] == [{"": "Stock", "Keeper": "hut 12", "Season": "spring"}]
    assert {tuple(r) for r in readers.warnings(df).collect()} == {("#pdf:c", "PDF needs a reader"), ("#text:d", "most of the text is markup")}


def test_saved_evidence(spark, tmp_path):
    (tmp_path / "m.evidence").write_text(json.dumps([["The boat leaves.", "#doc:a", ""], ["Hello", "#said", "me"]]))
    (tmp_path / "bad.evidence").write_text("[[cut")
    assert [(r.source, r.speaker, r.sentence) for r in readers.read_evidence(spark, str(tmp_path / "m.evidence")).orderBy("sid").collect()] == [("#doc:a", "", "The boat leaves."), ("#said", "me", "Hello")]
    assert readers.read_evidence(spark, str(tmp_path / "bad.evidence")).count() == 0
    (tmp_path / "m.expansion").write_text('{"bounds": [3, 4], "other": 1}')
    assert readers.read_aids(spark, str(tmp_path / "m.expansion")) == {"bounds": [3, 4]} and readers.read_aids(spark, str(tmp_path / "gone")) == {}


def test_saved_memory():
    raw = json.dumps({"records": []}).encode()
    framed = b"LMM1" + struct.pack(">BII", 4, len(raw), zlib.crc32(raw)) + zlib.compress(raw)
    assert readers.read_saved_memory(framed) == {"records": []}
    for broken in (framed[:4] + b"\x09" + framed[5:], framed[:9] + b"\0\0\0\0" + framed[13:]):
        with pytest.raises(ValueError):
            readers.read_saved_memory(broken)


# ---- nested bodies and drifting schemas ------------------------------------------------------------------------------


def brute_nodes(body):
    """Paths by plain recursion."""
    def load(x):
        try:
            return load(json.loads(x)) if isinstance(x, str) and x.strip()[:1] in '{["' else x
        except ValueError:
            return x

    def question(q, path):
        yield path
        for name, b in (load(q.get("buckets")) or {}).items():
            if b is not None:
                yield f"{path}.buckets.{name}"
        for field in ("takip", "evidence"):
            v = load(q.get(field))
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(x, dict):
                    yield from question(x, f"{path}.takip[{i}]") if field == "takip" else [f"{path}.evidence[{i}]"]

    try:
        top = load(body)
    except (ValueError, TypeError):
        return
    if isinstance(top, dict):
        for arm in ("engine_only", "graph_first"):
            a = load(top.get(arm))
            v = load(a.get("questions")) if isinstance(a, dict) else None
            for i, q in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(q, dict):
                    yield from question(q, f"{arm}.questions[{i}]")


BODIES = [
    '{"engine_only": {"questions": [{"soru": "a", "calls": "3", "buckets": {"read-back": {"calls": 1}, "x": null}, "evidence": {"source": "s", "lines": [1]}, "takip": [null, {"takip": {"soru": "c"}}]}, null]}, "ingest": {"facts": 7}}',
    json.dumps(json.dumps({"graph_first": json.dumps({"questions": {"soru": "b"}})})), '{"engine_only": {"questions": [', "[]", "", None, "7", '{"engine_only": null}', '{"a": NaN}',
]


def test_nodes_equal_brute_force(spark):
    df = spark.createDataFrame([(f"r{i}", b, "k") for i, b in enumerate(BODIES)] + [("r0", json.dumps(json.loads(BODIES[0]), indent=1), "k")], "run_id string, body string, kind string")
    nodes = nested.label_trees(df, "run_id")
    got = sorted((r.run_id, r.node_path) for r in nodes.filter("kind in ('question', 'bucket', 'evidence')").collect())
    assert got == sorted((f"r{i}", p) for i, b in enumerate(BODIES) if b and b != '{"a": NaN}' for p in brute_nodes(b))
    tables = nested.run_tables(df)
    assert [(r.bucket, r.calls, r.parent_path) for r in tables["buckets"].collect()] == [("read-back", 1, "engine_only.questions[0]")]
    assert {(r.node_path, r.parent_path, r.calls) for r in tables["questions"].filter("run_id = 'r0'").collect()} == {
        ("engine_only.questions[0]", "engine_only", 3), ("engine_only.questions[0].takip[1]", "engine_only.questions[0]", None),
        ("engine_only.questions[0].takip[1].takip[0]", "engine_only.questions[0].takip[1]", None)}
    assert tables["runs"].filter("facts = 7").count() == 1
    assert nested.below(nodes, "run_id", "arm", "question").filter("run_id = 'r0'").count() == 3
    assert nested.label_trees(df.limit(0), "run_id").count() == 0


def test_any_depth():
    body = '{"takip": [' * 30_000 + "{}" + "]}" * 30_000
    rows = nested.label('{"engine_only": {"questions": [' + body + "]}}")
    assert len(rows) == 30_003 and rows[-1][5] == 30_002
    inside = {r[2]: r for r in rows}
    assert all(inside[r[4]][2] < r[2] and inside[r[4]][3] > r[3] for r in rows if r[4] is not None)


LINE = "file_path string, series string, written_at timestamp, loaded_at timestamp, line_no int, body string, path string"


def test_changes_between_files(spark):
    def file(n, *bodies):
        return [(f"f{n}", "s", dt.datetime(2025, 1, n), dt.datetime(2025, 2, 1), i, json.dumps(b) if not isinstance(b, str) else b, "x") for i, b in enumerate(bodies, 1)]

    rows = (
        file(1, {"a": 1, "b": {"x": 1, "y": "t"}, "c": [1], "d": 1, "z": None}, {"a": "odd", "b": {"x": 1}}, {"a": 2}, "{cut")
        + file(2, {"a": 1.5, "b": {"x": 1, "w": "t"}, "c": [{"k": 1}], "e": {"k": 1}}) * 2
        + file(3, {"a": 1.5, "b": 3, "c": [1], "e": {"k": 1}, "A": True})
        + [(None, "s", None, None, 1, '{"q": 1}', "x"), ("f9", None, dt.datetime(2025, 1, 9), None, 1, '{"q": 1}', "x")]
    )
    df = spark.createDataFrame(rows, LINE)
    got = {tuple(r) for r in schema_drift.changes(df).collect()}
    assert got == {
        ("f2", "retyped", "a", "a"), ("f2", "renamed", "b.y", "b.w"), ("f2", "removed", "d", ""), ("f2", "added", "", "e"),
        ("f3", "retyped", "b", "b"), ("f3", "added", "", "A"),
    }
    assert schema_drift.changes(df.limit(0)).count() == 0
    wide = schema_drift.consistent_table(df)
    assert {"a", "A~2", "b.x", "failed"} <= set(wide.columns) or {"A", "a~2"} <= set(wide.columns)
    assert wide.filter("not valid").count() == 1
    name = "a" if "a" in wide.columns else "a~2"
    assert [r.failed for r in wide.filter("size(failed) > 0").select("failed").collect()] and wide.filter(F.col(f"`{name}`") == 1.5).count() == 2
    assert ("f1", "a") in {(r.file_path, r.path) for r in schema_drift.failed_casts(df).collect()}


def test_renames_fold_into_one_column(spark):
    def file(name, n, *bodies):
        return [(name, "s", dt.datetime(2025, 1, n), dt.datetime(2025, 2, 1), i, json.dumps(b), "x") for i, b in enumerate(bodies, 1)]

    rows = (
        file("s1", 1, {"calls": 1, "b": {"x": 1, "k": "t"}}) + file("s2", 2, {"n_calls": 2, "b": {"x": 2, "k": "t"}})
        + file("s3", 3, {"call_count": 3, "b": {"x": 3, "k": "t"}}) + file("s4", 4, {"Calls": 4, "b": {"x": 4, "k": "t"}}, {"Calls": "many"}, {"Calls": 44})
        + file("s5", 5, {"Calls": 5, "c": {"x": 5, "k": "t"}}) + file("s6", 6, {"Calls": 6, "c": {"y": 6, "k": "t"}})
    )
    df = spark.createDataFrame(rows, LINE)
    wide = schema_drift.consistent_table(df)
    got = {(r.file_path, r.line_no): r.asDict() for r in wide.collect()}
    assert wide.columns[5:-1] == ["b.k", "b.x", "calls"]
    assert [got[f"s{i}", 1]["calls"] for i in range(1, 7)] == [1, 2, 3, 4, 5, 6] and got["s4", 2]["failed"] == {"calls": "many"}
    assert [got[f"s{i}", 1]["b.x"] for i in range(1, 7)] == [1, 2, 3, 4, 5, 6]
    assert schema_drift.failed_casts(df).collect()[0][:2] == ("s4", "calls")
    # names that stand side by side in a file are different fields
    beside = schema_drift.consistent_table(spark.createDataFrame(rows + file("s7", 7, {"Calls": 7, "calls": 70, "c": {"y": 7}}), LINE))
    last = {r.file_path: r.asDict() for r in beside.filter("file_path in ('s2', 's7')").collect()}
    assert sorted(v for k, v in last["s7"].items() if k.lower().startswith("calls")) == [7, 70] and 2 in last["s2"].values()
    assert schema_drift.consistent_table(df.limit(0)).count() == 0
