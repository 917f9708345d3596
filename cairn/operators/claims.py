"""Gates and choices on the answering side: claims against the graph, quoted answers, replies of engines, tallies, record rows (GT-12 .. GT-16, TXT-27, AG-07, RK-16 .. RK-18, GR-27)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text as tx
from cairn.operators import check, retrieve
from cairn.session import checkpointed

UNVERIFIED = " ‹unverified›"
TRIPLE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "predicate", "value")]))


def edges_both_ways(edges: DataFrame) -> DataFrame:
    """JN-05: (a, b) of the graph's edges in either direction, by folded label; derived edges count."""
    one = edges.select(tx.fold("subject").alias("a"), tx.fold("value").alias("b")).filter("a is not null and b is not null")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def long_words(c: Column) -> Column:
    return F.filter(F.split(tx.fold(c), r"\s+"), lambda w: F.length(w) >= tx.CONTENT)


def attested(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """GT-12: (subject, value) of the different claims whose edge the graph holds.

    Either the two labels are the ends of an edge, whichever way, or a word of the claimed value has the stem of a word of one of
    the subject's own values.
    """
    asked = claims.select("subject", "value").distinct().withColumns({"a": tx.fold("subject"), "b": tx.fold("value")})
    direct = asked.join(edges_both_ways(edges), ["a", "b"], "left_semi").select("subject", "value")
    root = lambda c: F.left(c, F.lit(tx.ROOT))  # noqa: E731  words of one stem agree in it
    want = asked.select("subject", "value", "a", F.explode(F.array_distinct(long_words(F.col("value")))).alias("w")).withColumn("r", root("w"))
    have = edges.select(tx.fold("subject").alias("a"), F.explode(F.array_distinct(long_words(F.col("value")))).alias("h")).distinct().withColumn("r", root("h"))
    kindred = want.join(have, ["a", "r"]).filter(tx.same_stem(F.col("w"), F.col("h"))).select("subject", "value")
    return direct.unionByName(kindred).distinct()


def verified(sentences: DataFrame, claims: DataFrame, edges: DataFrame, echo: DataFrame | None = None, mode: str = "STRICT") -> DataFrame:
    """GT-12: (answer_id, text): an answer's sentences whose every claim the graph holds; sentences without claims pass.

    ``sentences``: (answer_id, pos, sentence); ``claims``: (answer_id, pos, subject, value) as an extraction read them again; ``echo``:
    (answer_id, said), the user's own words, which may be repeated.  STRICT drops other sentences, ASSIST marks them.  An answer of
    which nothing is left has an empty text.
    """
    held = claims.join(attested(claims, edges).withColumn("held", F.lit(True)), ["subject", "value"], "left")
    if echo is not None:
        spoken = echo.groupBy("answer_id").agg(F.flatten(F.collect_list(tx.tokens(F.col("said")))).alias("spoken"))
        all_said = lambda c: F.forall(tx.tokens(F.coalesce(F.col(c), F.lit(""))), lambda w: tx.stem_held(w, F.col("spoken"))) & (F.size(tx.tokens(F.col(c))) > 0)
        held = held.join(spoken, "answer_id", "left").withColumn("held", F.coalesce("held", F.col("spoken").isNotNull() & all_said("value") & all_said("subject")))
    bad = held.groupBy("answer_id", "pos").agg(F.max((~F.coalesce("held", F.lit(False))).cast("int")).alias("bad"))
    marked = sentences.join(bad, ["answer_id", "pos"], "left").withColumn("bad", F.coalesce("bad", F.lit(0)))
    text = F.when(F.col("bad") == 0, F.col("sentence")).when(F.lit(mode == "ASSIST"), F.concat("sentence", F.lit(UNVERIFIED)))
    kept = marked.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("pos", text.alias("t"))))).alias("k"))
    return kept.select("answer_id", F.array_join("k.t", " ").alias("text"))


def regions(lines: list[list[str]]) -> list[int]:
    """GT-13: the region of each of a few lines, given their words: lines that share most of their words, directly or over others."""
    sets = [set(w) for w in lines]
    of = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and of[i] != of[j] and (2 * both > len(sets[i] | sets[j]) or 2 * both > min(len(sets[i]), len(sets[j]))):
                new, old = min(of[i], of[j]), max(of[i], of[j])
                of = [new if x == old else x for x in of]
    return of


region_ids = F.pandas_udf(lambda words: words.map(regions), T.ArrayType(T.IntegerType()))


def _word_lists(c: str) -> Column:
    return F.transform(c, lambda x: F.array_distinct(tx.words(x)))


def quoted(answers: DataFrame) -> DataFrame:
    """GT-14: (answer_id, accepted, why): an answer that names its lines is taken where they carry it whole.

    ``answers``: (answer_id, question, said, lines array<string>, held array<int>).  At most the first three named lines count and all
    must exist; one region of them must carry every word of the answer, and their figures all its numbers.
    ``why`` is the first test that fails: 'lines', 'joined', 'beyond', 'figures'.
    """
    named = answers.withColumn("held", F.slice(F.coalesce("held", F.array().cast("array<int>")), 1, 3))
    offered = (F.size("held") > 0) & F.forall("held", lambda i: i.isNotNull() & (i >= 0) & (i < F.size("lines")))
    quote = named.withColumn("offered", F.coalesce(offered, F.lit(False))).withColumn(
        "quote", F.when(F.col("offered"), F.array_join(F.transform("held", lambda i: F.get("lines", i)), "\n")).otherwise(""))
    parts = quote.withColumn("parts", F.when(F.col("quote") != "", tx.sentences(F.col("quote"), ".!?;")).otherwise(F.array().cast("array<string>")))
    kind = parts.schema["answer_id"].dataType.simpleString()

    def joined_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, question, said, texts, words in batch.itertuples(index=False):
                by: dict[int, list[str]] = {}
                for region, text in zip(regions(list(words)), texts):
                    by.setdefault(region, []).append(text)
                rows += [(key, question, said, "\n".join(t)) for t in by.values()]
            yield pd.DataFrame(rows, columns=["answer_id", "question", "said", "text"])

    each = parts.select("answer_id", "question", "said", "parts", _word_lists("parts").alias("pw")).mapInPandas(
        joined_regions, f"answer_id {kind}, question string, said string, text string")
    one = check.prepared(each, "said", "text", "question").withColumn("share", check.coverage("said")).groupBy("answer_id").agg(F.max("share").alias("best"))
    all_ = check.prepared(quote, "said", "quote", "question").withColumns({"share": check.coverage("said"), "figures": check.digits_ok()})
    joined = all_.join(one, "answer_id", "left")
    why = (
        F.when(~F.col("offered"), "lines").when(F.coalesce("best", F.lit(0.0)) < 1, "joined").when(F.col("share") < 1, "beyond").when(~F.col("figures"), "figures")
    )
    return joined.select("answer_id", why.isNull().alias("accepted"), why.alias("why"))


def asserts_fact(answers: DataFrame) -> DataFrame:
    """GT-13: (answer_id, asserted): some sentence is mostly carried by the proof and has a number, or a word that fewer than half of its regions hold.

    ``answers``: (answer_id, answer, proofs array<string>), the proofs of one answer a few lines.  Fewer than three regions count as asserting.
    """
    proof = answers.select("answer_id", "answer", F.coalesce("proofs", F.array().cast("array<string>")).alias("proofs")).withColumn("pw", _word_lists("proofs"))
    placed = proof.withColumn("ids", region_ids("pw"))
    grouped = F.transform(F.array_distinct("ids"), lambda r: F.array_distinct(F.flatten(F.transform(F.filter(
        F.arrays_zip("ids", "pw"), lambda z: z["ids"] == r), lambda z: z["pw"]))))
    each = placed.withColumn("regions", grouped).select(
        "answer_id", "regions", F.array_join("proofs", "\n").alias("proof"), F.explode_outer(tx.sentences(F.coalesce("answer", F.lit("")))).alias("sentence"))
    scored = check.prepared(each, "sentence", "proof").withColumn("share", check.coverage("sentence"))
    few = lambda w: 2 * F.size(F.filter("regions", lambda r: F.array_contains(r, w))) < F.size("regions")
    says = (F.col("share") > 0.5) & F.exists("_aw", lambda w: tx.is_number(w) | few(w))
    return scored.groupBy("answer_id").agg(F.max(F.coalesce((F.size("regions") < 3) | says, F.lit(False))).alias("asserted"))


def shortcut(question: Column, answer: Column, lines: Column) -> Column:
    """GT-16: what structure alone says before any judge is asked: 'accept' where a line and the answer carry each other whole,
    'refuse' where the answer adds no word to the question, else null."""
    words = lambda c: F.array_distinct(tx.words(F.coalesce(c, F.lit(""))))

    def told(a: Column) -> Column:
        same = F.exists(F.coalesce(lines, F.array().cast("array<string>")), lambda x: tx.let(words(x), lambda w: (
            F.size(F.filter(a, lambda t: ~tx.stem_held(t, w))) + F.size(F.filter(w, lambda t: ~tx.stem_held(t, a)))) == 0))
        return F.when((F.size(a) > 0) & same, "accept").when(F.size(F.array_except(a, words(question))) == 0, "refuse")

    return tx.let(words(answer), told)


def reply_triples(reply: Column, field: str = "triples") -> Column:
    """TXT-27: the triples of an engine's reply: those of its first whole JSON object, lists or objects, with a subject, without marks.

    No object, or one that is no JSON, gives none; a null reply gives null.
    """
    def read(replies: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(text: str | None):
            if text is None:
                return None
            try:
                found = decoder.raw_decode(text, text.index("{"))[0]
            except ValueError:
                return []
            rows = []
            for t in found.get(field) or []:
                if isinstance(t, dict):
                    parts = [t.get("subject"), t.get("predicate") or t.get("relation"), t.get("value") or t.get("object")]
                elif isinstance(t, list):
                    parts = [*t, None, None, None][:3]
                else:
                    continue
                named = ["" if p is None else str(p).strip() for p in parts]
                if named[0]:
                    rows.append(dict(zip(("subject", "predicate", "value"), named)))
            return rows

        return replies.map(one)

    bare = lambda x: F.regexp_replace(x, r"\p{M}+", "")
    found = F.pandas_udf(read, TRIPLE)(reply)
    return F.transform(found, lambda t: F.struct(*(bare(t[n]).alias(n) for n in ("subject", "predicate", "value"))))


def malformed(subject: Column, value: Column) -> Column:
    """TXT-27: the subject has swallowed the value: all its words and more."""
    s, v = (F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")) for c in (subject, value))
    return (F.size(v) > 0) & (F.size(F.array_except(v, s)) == 0) & (F.size(s) > F.size(v))


def events_told(events: DataFrame, passages: DataFrame) -> DataFrame:
    """GR-27: (source, subject, predicate, value, kind) of the events of an extraction that their passage carries.

    ``events``: (passage_id, thing, happened, kind); ``passages``: (passage_id, source, text).  Every word of the thing must be
    held by the passage up to its ending; a thing that lists several is none.  Names stay strings, apart from the identities.
    """
    met = events.join(passages, "passage_id").filter(~F.col("thing").rlike(r"[,;\n]"))
    letters = F.filter(tx.tokens(F.col("thing")), lambda w: w.rlike(r"^\p{L}+$"))
    held = tx.let(tx.tokens(F.col("text")), lambda t: F.forall(letters, lambda w: tx.stem_held(w, t)))
    return met.filter((F.size(letters) > 0) & held).select("source", F.col("thing").alias("subject"), F.lit("event").alias("predicate"), F.col("happened").alias("value"), "kind").distinct()


def source_count(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """AG-07: (query_id, n): how many source names hold a word of the question, for the word of at least two and fewer than all names that most hold."""
    names = sources.select("source").filter("source is not null").distinct()
    word = names.select("source", F.explode(F.array_distinct(tx.words(tx.source_name(F.col("source"))))).alias("word"))
    whole = names.agg(F.count(F.lit(1)).alias("all"))
    held = word.groupBy("word").agg(F.count_distinct("source").alias("n")).join(F.broadcast(whole), F.lit(True)).filter("n >= 2 and n < all")
    asked = questions.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    return asked.join(held, "word").groupBy("query_id").agg(F.max("n").alias("n"))


def item_tally(items: DataFrame, lines: DataFrame) -> DataFrame:
    """AG-07: (query_id, n, items): the different items of a list that lines of the store carry; fewer than two are no tally.

    ``items``: (query_id, item), as an engine listed them; ``lines``: (sid, sentence).  An item is carried where one line holds all its
    words up to their endings; items of the same words are one.
    """
    asked = items.select("query_id", "item", F.array_sort(F.array_distinct(tx.words(F.col("item")))).alias("iw")).filter(F.size("iw") > 0)
    known = asked.select("iw").distinct().select("iw", F.explode("iw").alias("w"))
    root = lambda c: F.left(c, F.lit(tx.CONTENT))
    # a sentence is read once, whatever lines say it
    texts = lines.select("sentence").distinct().select(F.xxhash64("sentence").alias("t"), F.array_distinct(tx.words(F.col("sentence"))).alias("hs"))
    held = checkpointed(texts.filter(F.size("hs") > 0)).select("t", F.explode("hs").alias("h"))
    # words meet once, whatever lines hold them
    pairs = checkpointed(known.select("w").distinct().join(held.select("h").distinct(), root("w") == root("h")).filter(tx.same_stem(F.col("w"), F.col("h"))).select("w", "h"))
    # an item of one word needs no line; of the others only the sets of their words that some sentence holds count, found by the item's rarest word
    one = known.filter(F.size("iw") == 1).join(pairs.select("w").distinct(), "w", "left_semi").select("iw")
    several = known.filter(F.size("iw") > 1)
    mine = pairs.join(several.select("w").distinct(), "w", "left_semi")
    sets = checkpointed(held.join(mine, "h").groupBy("t").agg(F.array_sort(F.collect_set("w")).alias("ws")).filter(F.size("ws") > 1).select("ws").distinct())
    each = sets.select("ws", F.explode("ws").alias("w"))
    rarest = several.join(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w").groupBy("iw").agg(F.min(F.struct("n", "w")).alias("r")).select("iw", F.col("r.w").alias("w"))
    met = one.unionByName(rarest.join(each, "w").filter(F.size(F.array_except("iw", "ws")) == 0).select("iw"))
    carried = asked.join(met.select("iw").distinct(), "iw", "left_semi")
    each = carried.groupBy("query_id", "iw").agg(F.min("item").alias("item"))
    return each.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("item")), "; ").alias("items")).filter("n >= 2")


def record_rows(rows: DataFrame, questions: DataFrame, most: int = 4, least_sources: int = 2) -> DataFrame:
    """RK-16: (query_id, place, sid, row): the record rows of a question's source, fields of several sources first, then those asked for.

    ``questions``: (query_id, source, query); ``rows``: (sid, source, sentence).
    """
    each = rows.select("sid", "source", F.posexplode(tx.record_pairs(F.col("sentence"))).alias("nth", "p")).select(
        "sid", "source", "nth", "p.value", F.col("p.head").alias("head"), tx.words(F.col("p.head")).alias("hw"))
    fieldish = each.select("hw", "source").distinct().groupBy("hw").agg((F.count(F.lit(1)) >= least_sources).alias("field"))
    asked = questions.select("query_id", "source", tx.words(F.col("query")).alias("qw"))
    # one row for each head and value of a source: the first that says it
    first = each.groupBy("source", "hw", "value").agg(F.min(F.struct("sid", "nth", "head")).alias("a")).join(fieldish, "hw")
    met = asked.join(first, "source").withColumn("asked", F.size(F.filter("hw", lambda k: F.exists("qw", lambda w: tx.same_stem(k, w) | tx.kin(k, w)))))
    by = Window.partitionBy("query_id", "source").orderBy(F.col("field").desc(), F.col("asked").desc(), "a.sid", "a.nth")
    return met.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).select(
        "query_id", "place", F.col("a.sid").alias("sid"), F.concat("a.head", F.lit(": "), "value", F.lit(".")).alias("row"))


def load_bearing(proofs: DataFrame, sources: DataFrame) -> DataFrame:
    """RK-17: (answer_id, origin): the source an answer rests on.

    The first origin whose whole name the answer speaks; else the first by name of all sources of two words or more whose name it speaks;
    else that of the line that covers it best, the first of equals.  ``proofs``: (answer_id, said, place, line, origin).
    """
    real = proofs.filter("origin is not null and origin <> ''")
    said = proofs.select("answer_id", F.explode(F.array_distinct(tx.words(F.col("said")))).alias("t")).distinct()
    names = sources.select("source").unionByName(real.select(F.col("origin").alias("source"))).distinct()
    word = names.select("source", F.explode(F.array_distinct(tx.words(tx.source_name(F.col("source"))))).alias("w"))
    size = word.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    head = lambda c: F.left(c, F.lit(tx.CONTENT))
    pairs = said.select("t").distinct().join(word.select("w").distinct(), head("t") == head("w")).filter(tx.kin(F.col("t"), F.col("w")))
    spoken = said.join(pairs, "t").join(word, "w").groupBy("answer_id", "source").agg(F.count_distinct("w").alias("n")).join(size, "source").filter("n = size")
    own = real.join(spoken.select("answer_id", F.col("source").alias("origin")), ["answer_id", "origin"]).groupBy("answer_id").agg(F.min_by("origin", "place").alias("own"))
    any_ = spoken.filter("size >= 2").groupBy("answer_id").agg(F.min("source").alias("any"))
    covered = check.prepared(real, "said", "line").withColumn("share", check.coverage("said"))
    best = covered.groupBy("answer_id").agg(F.max_by("origin", F.struct("share", (-F.col("place")).alias("p"))).alias("best"))
    return proofs.select("answer_id").distinct().join(own, "answer_id", "left").join(any_, "answer_id", "left").join(best, "answer_id", "left").select(
        "answer_id", F.coalesce("own", "any", "best", F.lit("")).alias("origin"))


def selected(candidates: DataFrame) -> DataFrame:
    """RK-18: (query_id, place, said): of the candidates that the judges let pass the one that reaches most of the question, then the best carried one.

    ``candidates``: (query_id, place, question, said, proof, passes); carried is the share of words in the proof, halved where its
    figures are not the proof's, times the share of the proof's words in use.
    """
    ready = check.prepared(candidates, "said", "proof", "question").withColumns({"carried": check.carried(), "share": check.coverage("said"), "figures": check.digits_ok()})
    use = F.size(F.array_intersect("_aw", "_ew")) / F.greatest(F.size("_ew"), F.lit(1))
    score = F.when(F.col("figures"), 1.0).otherwise(0.5) * F.col("share") * use
    rank = F.struct(F.round("carried", 9).alias("c"), F.round(score, 9).alias("s"), (-F.col("place")).alias("p"))
    best = ready.filter(F.coalesce("passes", F.lit(False))).groupBy("query_id").agg(F.max_by(F.struct("place", "said"), rank).alias("b"))
    return best.select("query_id", "b.place", "b.said")


def answered(rows: DataFrame, questions: DataFrame, records: DataFrame, most: int = 6, least: float = 0.5, proofs: bool = True) -> DataFrame:
    """CV-01, CV-04: (query_id, answer, sources, proof, kind, coverage, abstained): the deterministic chain of an answer.

    A record where exactly one is meant ('record'), else how many sources where their names are asked for ('count'), else the best line,
    if it carries at least ``least`` of the question's words ('line'); else nothing is said.  ``records``: (entity, field, value).
    With ``proofs=False`` there are no ``sources`` and no ``proof``: the line for a measurement, which is a proof but never the best line, is not looked for.
    """
    from cairn.operators import records as graph

    known = graph.lookup(records, records.select("entity").distinct(), questions.select(F.col("query_id").alias("question_id"), F.col("query").alias("question")))
    counting = questions.filter(F.col("query").rlike(r"(?i)\b(how many|kaç|cuántos|cuántas|wie viele)\b"))
    counted = source_count(counting, rows)
    found = retrieve.find(rows, questions, most, measured=proofs)
    best = found.groupBy("query_id").agg(
        F.min_by(F.struct("sentence", "source"), "rank").alias("b"), F.sort_array(F.collect_set("source")).alias("sources"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]).alias("proof"))
    all_ = questions.join(known.select(F.col("question_id").alias("query_id"), "value"), "query_id", "left").join(counted, "query_id", "left").join(best, "query_id", "left")
    carried = check.prepared(all_.withColumn("line", F.col("b.sentence")), "line", "line", "query").withColumn("reach", check.carried())
    kind = F.when(F.col("value").isNotNull(), "record").when(F.col("n").isNotNull(), "count").when(F.col("line").isNotNull() & (F.col("reach") >= least), "line")
    answer = F.when(F.col("kind") == "record", F.col("value")).when(F.col("kind") == "count", F.col("n").cast("string")).when(F.col("kind") == "line", F.col("line"))
    told = carried.withColumn("kind", kind).withColumn("answer", answer)
    empty = F.array().cast("array<string>")
    out = told.select("query_id", "answer", F.coalesce("sources", empty).alias("sources"), F.coalesce("proof", empty).alias("proof"), "kind",
                      F.round(F.when(F.col("line").isNotNull(), F.col("reach")), 6).alias("coverage"), F.col("kind").isNull().alias("abstained"))
    return out if proofs else out.drop("sources", "proof")
