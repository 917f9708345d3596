"""Answer-side operators: admission tests, joins of names and fields, tallies and layouts (GT-08 .. GT-17 but for the gates in ``claims``, JN-03 .. JN-10, AG-07 .. AG-15, RK-05 .. RK-18, PL-15 .. PL-18)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text as tx
from cairn.operators import retrieve


def unseen_demands(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """GT-08: (query_id, word): question words whose stem no word of the index has.

    ``questions``: (query_id, query).  An equi-join on the whole word and on five-letter roots, on distinct words only.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    words = asked.select("word").distinct()
    known = vocabulary.select(F.col("word").alias("term")).distinct()
    rooted = words.withColumn("root", F.left("word", F.lit(tx.ROOT))).join(known.withColumn("root", F.left("term", F.lit(tx.ROOT))), "root").filter(
        tx.same_stem(F.col("word"), F.col("term"))
    ).select("word").distinct()
    return asked.join(rooted, "word", "left_anti").select("query_id", "word")


def substance_ok(answer: Column, question: Column, name: Column, body: Column) -> Column:
    """GT-09: the answer has a word that is neither the question's nor a source name's, or all it borrows stands in the named lines."""
    a, q, n, b = (F.array_distinct(tx.words(F.coalesce(c, F.lit("")))) for c in (answer, question, name, body))
    own = F.size(F.array_except(a, F.array_union(q, n))) > 0
    return own | (F.size(F.array_except(a, b)) == 0)


def field_ok(claim: Column, question: Column, field: Column, line: Column) -> Column:
    """GT-10: where the question names a field and the claim has numbers, the field's line shares one of them."""
    numbers = lambda c: F.filter(tx.tokens(F.coalesce(c, F.lit(""))), tx.is_number)
    named = F.size(F.array_except(tx.words(F.coalesce(field, F.lit(""))), tx.words(F.coalesce(question, F.lit(""))))) == 0
    return ~named | (F.size(numbers(claim)) == 0) | F.arrays_overlap(numbers(claim), numbers(line))


def line_admissible(line: Column, material: Column) -> Column:
    """GT-17: every capitalised or numeric word of a draft line is attested in the material; a fully titled line needs one."""
    plain = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)
    marked = F.filter(plain, lambda w: w.rlike(r"^[\p{Lu}\p{N}]"))
    held = tx.words(F.coalesce(material, F.lit("")))
    hit = F.filter(marked, lambda w: tx.stem_held(tx.fold(w), held))
    titled = (F.size(plain) > 0) & (F.size(marked) == F.size(plain))
    return F.when(titled, F.size(hit) > 0).otherwise(F.size(hit) == F.size(marked))


def supported(claims: DataFrame, records: DataFrame) -> DataFrame:
    """GT-15: (claim_id, backed, doubtful): a spoken record of the subject and value stands behind the claim."""
    spoken = records.filter((F.col("trust") >= 0.4) & ~F.isnan("trust")).groupBy("subject", "value").agg(
        F.max("witnesses").alias("witnesses"), F.max("level").alias("level")
    )
    joined = claims.join(spoken, ["subject", "value"], "left")
    backed = F.col("level").isNotNull()
    return joined.select("claim_id", backed.alias("backed"), (backed & (F.coalesce("witnesses", F.lit(1)) <= 1) & (F.col("level") <= 1)).alias("doubtful"))


def sources_named(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """JN-09: (query_id, source): sources that a question names by a word of one source's name alone; the best covered names of several stay."""
    word = sources.select("source").distinct().select("source", F.explode(F.array_distinct(tx.words(tx.source_name(F.col("source"))))).alias("word"))
    size = word.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    rare = word.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"))
    asked = questions.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    hits = asked.join(rare.filter("n = 1").select("word", "source"), "word").select("query_id", "source").distinct()
    shared = asked.join(word, "word").groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("held"))
    covered = hits.join(shared, ["query_id", "source"]).join(size, "source").withColumn("share", F.col("held") / F.col("size"))
    best = F.rank().over(Window.partitionBy("query_id").orderBy(F.col("share").desc()))
    return covered.withColumn("r", best).filter("r = 1").select("query_id", "source")


def meeting_lines(mentions: DataFrame, entities: list[str]) -> DataFrame:
    """JN-03: (sid): lines that carry all of up to three named entities."""
    wanted = sorted(set(entities))[:3]
    return mentions.filter(F.col("entity").isin(*wanted)).groupBy("sid").agg(F.count_distinct("entity").alias("n")).filter(F.col("n") == len(wanted)).select("sid")


def speaker_first(lines: DataFrame, speaker: str) -> DataFrame:
    """JN-10: the asker's lines before the others, each in their order."""
    by = Window.partitionBy("query_id").orderBy((F.coalesce("speaker", F.lit("")) != speaker).cast("int"), "rank")
    return lines.withColumn("rank", F.row_number().over(by))


def record_answer(heads: DataFrame, questions: DataFrame) -> DataFrame:
    """JN-08: (query_id, answer): one named source and one named field with exactly one value.

    ``heads``: (source, head, value); a field is a head that at least two sources write.
    """
    fields = heads.groupBy("head").agg(F.count_distinct("source").alias("n")).filter("n >= 2").select("head", tx.words(F.col("head")).alias("hw"))
    named = sources_named(questions, heads)
    single = named.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")).filter("n = 1")
    asked = questions.join(single.drop("n"), "query_id").withColumn("qw", tx.words(F.col("query")))
    first = fields.withColumn("word", F.explode("hw"))
    hit = asked.withColumn("word", F.explode("qw")).join(first, "word").filter(F.size(F.array_except("hw", "qw")) == 0).select("query_id", "source", "head").distinct()
    one = hit.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"), F.first("head").alias("head")).filter("n = 1").drop("n")
    values = one.join(heads, ["source", "head"]).groupBy("query_id", "head").agg(F.count_distinct("value").alias("n"), F.first("value").alias("value")).filter("n = 1")
    return values.select("query_id", F.concat("head", F.lit(": "), "value", F.lit(".")).alias("answer"))


def heads_by_vote(bridge: DataFrame, questions: DataFrame) -> DataFrame:
    """AG-15: (query_id, head): heads with most weight of the question's reader words, ln(1+H/|heads of the word|).

    ``bridge``: (word, head); a word that is part of the head itself is left out.
    """
    kept = bridge.filter(~F.array_contains(tx.words(F.col("head")), F.col("word"))).distinct()
    all_heads = kept.agg(F.count_distinct("head").alias("h"))
    weight = kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(all_heads), F.lit(True)).select("word", F.log(1 + F.col("h") / F.col("n")).alias("w"))
    asked = questions.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    score = asked.join(kept, "word").join(weight, "word").groupBy("query_id", "head").agg(F.round(F.sum("w"), 6).alias("vote"))
    return score.withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("vote").desc()))).filter("r = 1").select("query_id", "head", "vote")


def stated_tally(line: Column, question: Column) -> Column:
    """AG-08: a number stands within two words of a word of the question's."""
    toks, q = tx.tokens(line), tx.words(question)
    near = lambda i: F.exists(F.array(*(F.get(toks, i + k) for k in (-2, -1, 1, 2))), lambda t: t.isNotNull() & ~tx.is_number(t) & tx.stem_held(t, q))
    return F.when(F.size(toks) > 0, F.exists(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: tx.is_number(F.get(toks, i)) & near(i))).otherwise(F.lit(False))


def spoken_row(row: Column, spoken: Column) -> Column:
    """PL-18: a rephrased row is kept where its numbers are the same, each as often."""
    numbers = lambda c: F.array_sort(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), 0))
    return F.when(numbers(row) == numbers(spoken), spoken).otherwise(row)


def order_of_two(lines: DataFrame, things: DataFrame) -> DataFrame:
    """PL-15: (question_id, first): of two things the one anchored at the earlier line that shares more than half of its words.

    ``things``: (question_id, thing); ``lines``: (sid, day, sentence).  A tie or a missing anchor gives no row.
    """
    wanted = things.select("question_id", "thing", F.array_distinct(tx.words(F.col("thing"))).alias("tw")).withColumn("word", F.explode("tw"))
    held = lines.filter("day is not null").select("sid", "day", F.explode(F.array_distinct(tx.words(F.col("sentence")))).alias("word"))
    shared = wanted.join(held, "word").groupBy("question_id", "thing", F.size("tw").alias("n"), "sid", "day").agg(F.count(F.lit(1)).alias("hit")).filter(2 * F.col("hit") > F.col("n"))
    at = shared.groupBy("question_id", "thing").agg(F.min("day").alias("day"))
    both = at.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("day", "thing")).alias("lo"), F.max("day").alias("hi"))
    return both.filter("n = 2 and lo.day < hi").select("question_id", F.col("lo.thing").alias("first"))


def shown_span(a: Column, b: Column) -> Column:
    """PL-16, TXT-30: 'D days (D+1 including the last day)'."""
    d = F.abs(F.datediff(a, b))
    return F.concat(d.cast("string"), F.lit(" days ("), (d + 1).cast("string"), F.lit(" including the last day)"))


def shown_day(day: Column) -> Column:
    """TXT-30: a day as 'yyyy/mm/dd'."""
    return F.date_format(day, "yyyy/MM/dd")


def months_between(a: Column, b: Column) -> Column:
    """TXT-30: whole calendar months from one day's month to the other's, whichever is first."""
    key = lambda d: 12 * F.year(d) + F.month(d)
    return F.abs(key(a) - key(b))


def telling(lines: DataFrame, most_chars: int = 120_000) -> DataFrame:
    """PL-17: (source, block): the lines of a source in the order of their days, where all are dated and the whole is short enough.

    The length is checked before anything is gathered, so a group is bounded by ``most_chars``.
    """
    fits = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("day").alias("d"), F.sum(F.length("sentence") + 1).alias("chars")).filter(f"n = d and chars <= {most_chars}")
    kept = lines.join(fits.select("source"), "source", "left_semi")
    return kept.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "sid", "sentence"))), lambda x: F.concat(F.date_format(x["day"], "yyyy/MM/dd"), F.lit(" "), x["sentence"])), "\n").alias("block"))


def profiles(rows: DataFrame, lines: int = 12, chars: int = 1200) -> DataFrame:
    """RK-12: (source, profile): a source's name and its longest lines, up to so many characters; cut before it is gathered."""
    by = Window.partitionBy("source").orderBy(F.length("sentence").desc(), "sid")
    top = rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= lines)
    joined = top.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "sentence"))), lambda x: x["sentence"]), " ").alias("p"))
    return joined.select("source", F.left(F.concat_ws(" ", tx.source_name(F.col("source")), "p"), F.lit(chars)).alias("profile"))


def named_first(ranked: DataFrame, named: DataFrame, own: str = "#said", most_own: int = 2) -> DataFrame:
    """RK-05: lines of named sources first, own speech last and two of it at most."""
    marked = ranked.join(named.withColumn("is_named", F.lit(1)), ["query_id", "source"], "left")
    order = [F.when(F.col("source") == own, 2).when(F.col("is_named").isNotNull(), 0).otherwise(1), "rank"]
    placed = marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn(
        "nth", F.row_number().over(Window.partitionBy("query_id", F.col("source") == own).orderBy("rank"))
    )
    return placed.filter((F.col("source") != own) | (F.col("nth") <= most_own)).drop("is_named", "nth")


def scoped(rows: DataFrame, questions: DataFrame, most: int = 6) -> DataFrame:
    """RK-08: (query_id, sid, shared): lines of a question's scope by the number of its exact words, then sid; ``rows`` has query_id."""
    q = questions.select("query_id", F.array_distinct(tx.words(F.col("query"))).alias("qw"))
    hit = rows.join(q, "query_id").withColumn("shared", F.size(F.array_intersect("qw", tx.words(F.col("sentence"))))).filter("shared > 0")
    by = Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "sid")
    return hit.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most).select("query_id", "sid", "shared")


def maxsim(query: Column, line: Column) -> Column:
    """RK-13: the mean over the query's piece vectors of the greatest cosine with the line's."""
    best = F.transform(query, lambda q: F.array_max(F.transform(line, lambda x: retrieve.cosine(q, x))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.size(best)


def judged_suspects(records: DataFrame, verdict: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """GR-15: (subject, predicate, anchor, value, rival): each other value of a slot against its anchor by a verdict (UD-04).

    The anchor has the highest level, then witnesses, then trust, then the smallest key; recency is not asked.
    The verdict is true, false or null (stays a suspect).
    """
    rank = F.struct(F.coalesce("level", F.lit(-1)).alias("l"), F.coalesce("witnesses", F.lit(-1)).alias("w"), F.coalesce("trust", F.lit(-1.0)).alias("t"), (-F.col("record_key")).alias("k"), "value")
    anchor = records.groupBy("subject", "predicate").agg(F.max(rank).alias("a")).select("subject", "predicate", F.col("a.value").alias("anchor"))
    others = records.select("subject", "predicate", "value").distinct().join(anchor, ["subject", "predicate"]).filter("value <> anchor")
    return others.withColumn("rival", F.pandas_udf(verdict, T.BooleanType())("anchor", "value"))
