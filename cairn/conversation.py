"""Turns of conversations over a store: shapes, topic scope, composition, passages, engines and the reading of their replies (CV-02 .. CV-06, EN-02, EN-03, SNK-07, ST-04, UD-05, UD-06).

Everything runs for many conversations at once.  An engine is a caller's function from a prompt to a reply; none is part of the package.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.functions import text as tx
from cairn.operators import answers, claims, retrieve

# The shapes a turn may declare.
SHAPES = ("material", "count", "sum", "derive", "span", "order", "when", "recap", "none")
SAID, SHORTEST_SAID, HISTORY = "#said", 12, 12


class EngineTimeout(RuntimeError):
    """An engine's time is used up."""


class Engine:
    """UD-06: a caller's engine with a time budget, repeated tries at growing waits, and a memory of its last prompts."""

    def __init__(self, call: Callable[[str], str], tries: int = 4, wait: float = 1.0, longest_wait: float = 30.0, budget: float = 90.0, remembered: int = 256):
        self.call, self.tries, self.wait, self.longest_wait, self.budget, self.remembered = call, tries, wait, longest_wait, budget, remembered
        self.known: OrderedDict[str, str] = OrderedDict()

    def __call__(self, prompt: str) -> str:
        if prompt in self.known:
            self.known.move_to_end(prompt)
            return self.known[prompt]
        ends, wait, last = time.monotonic() + self.budget, self.wait, None
        for turn in range(self.tries):
            try:
                reply = self.call(prompt)
                break
            except Exception as e:  # an engine may fail in any way
                last = e
            if turn + 1 < self.tries:
                if time.monotonic() + wait > ends:
                    raise EngineTimeout(f"no reply within {self.budget} s") from last
                time.sleep(wait)
                wait = min(2 * wait, self.longest_wait)
        else:
            raise last
        self.known[prompt] = reply
        if len(self.known) > self.remembered:
            self.known.popitem(last=False)
        return reply


def shape(declared: Column) -> Column:
    """CV-03: a declared shape, if it is one; else 'none'."""
    low = F.lower(F.trim(declared))
    return F.when(low.isin(*SHAPES), low).otherwise("none")


QUOTED = T.StructType([T.StructField("said", T.StringType()), T.StructField("held", T.ArrayType(T.IntegerType()))])


def quoted_reply(reply: Column) -> Column:
    """EN-02: struct (said, held) of a reply {"answer": text, "lines": [numbers from 1]}; held counts from 0, at most three; else nulls."""
    def read(replies: pd.Series) -> pd.DataFrame:
        decoder, rows = json.JSONDecoder(), []
        for text in replies:
            said, held = None, None
            try:
                found = decoder.raw_decode(text, text.index("{"))[0]
                lines = found.get("lines")
                lines = [lines] if isinstance(lines, int) else lines if isinstance(lines, list) else []
                said, held = str(found["answer"]).strip() or None, [n - 1 for n in lines if isinstance(n, int) and not isinstance(n, bool)][:3]
            except (AttributeError, KeyError, TypeError, ValueError):
                pass
            rows.append((said, held))
        return pd.DataFrame(rows, columns=["said", "held"])

    return F.pandas_udf(read, QUOTED)(reply)


def listed_reply(reply: Column, most: int = 6) -> Column:
    """EN-02: the different items of a reply in lines or after commas, without list marks; at most ``most``."""
    parts = F.transform(F.split(F.coalesce(reply, F.lit("")), r"[\n,;]+"), lambda x: F.regexp_replace(x, r"^[\s\-*•\d.)]+|[\s.]+$", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)


def verdict_reply(reply: Column) -> Column:
    """EN-03: true or false by the reply's first word, null where it is neither yes nor no."""
    word = F.lower(F.regexp_extract(F.coalesce(reply, F.lit("")), r"^\W*(\w+)", 1))
    return F.when(word == "yes", True).when(word == "no", False)


def said_rows(turns: DataFrame) -> DataFrame:
    """CV-05: (sid, source, sentence) of what users said at some length, as lines of the store."""
    spoken = turns.filter((F.col("role") == "user") & (F.length(F.trim("text")) >= SHORTEST_SAID))
    return spoken.select(F.concat_ws(":", F.lit("said"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sid"), F.lit(SAID).alias("source"), F.trim("text").alias("sentence"))


def scopes(turns: DataFrame, answered: DataFrame, sources: DataFrame) -> DataFrame:
    """CV-05: (conv_id, turn, scope array): the documents a user's turn is about.

    A turn that names documents is about those; one of shape 'material' is about all; any other inherits the documents of the last answer before it.
    ``turns``: (conv_id, turn, role, text, shape); ``answered``: (conv_id, turn, sources array).  An empty scope is no limit.
    """
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), shape(F.col("shape")).alias("shape"))
    keyed = asked.withColumn("query_id", F.struct("conv_id", "turn"))
    named = retrieve.name_bonus(keyed, sources).groupBy("query_id").agg(F.sort_array(F.collect_set("source")).alias("named"))
    joined = keyed.join(named, "query_id", "left").join(answered.select("conv_id", "turn", F.col("sources").alias("told")), ["conv_id", "turn"], "left")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("told", ignorenulls=True).over(before)
    empty = F.array().cast("array<string>")
    scope = F.when(F.col("shape") == "material", empty).when(F.size("named") > 0, F.col("named")).otherwise(F.coalesce(last, empty))
    return joined.select("conv_id", "turn", scope.alias("scope"))


def material(rows: DataFrame, topics: DataFrame, seats: int = 24) -> DataFrame:
    """CV-06: (brief_id, topic, place, source, line): what is laid out for each topic of a brief: its best lines and its sources' record rows.

    ``topics``: (brief_id, topic).  A topic has at least four lines, and ``seats`` are shared by the topics of a brief.
    """
    many = topics.groupBy("brief_id").agg(F.count_distinct("topic").alias("n"))
    asked = topics.select("brief_id", "topic").distinct().withColumn("query_id", F.xxhash64("brief_id", "topic")).join(many, "brief_id")
    found = retrieve.find(rows, asked.select("query_id", F.col("topic").alias("query")), seats)
    share = F.greatest(F.lit(4), (F.lit(seats) / F.col("n")).cast("int"))
    best = found.join(asked, "query_id").filter(F.col("rank") <= share).select("brief_id", "topic", "query_id", F.col("rank").alias("place"), "source", F.col("sentence").alias("line"))
    wanted = best.select("query_id", "source", F.col("topic").alias("query")).distinct()
    records = claims.record_rows(rows, wanted).join(rows.select("sid", "source"), "sid").join(asked, "query_id").select(
        "brief_id", "topic", "query_id", (F.lit(1000) + F.col("place")).alias("place"), "source", F.col("row").alias("line"))
    return best.unionByName(records).drop("query_id").distinct()


def composed(drafts: DataFrame, laid: DataFrame) -> DataFrame:
    """CV-06, GT-17: (brief_id, text): the lines of a draft whose names and numbers the brief's material holds, in order.

    ``drafts``: (brief_id, pos, line), as an engine wrote them; ``laid`` is what ``material`` gives, a few lines a brief.
    """
    held = laid.groupBy("brief_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "line", tx.source_name(F.col("source"))))), " ").alias("held"))
    kept = drafts.join(held, "brief_id", "left").filter(answers.line_admissible(F.col("line"), F.col("held")))
    return kept.groupBy("brief_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def each_line(composed_texts: DataFrame, on_line: Callable[[str, str], None]) -> None:
    """UD-05: a caller's function for each admitted line, on the executors: (brief id, line) in order."""
    def give(rows: Iterator) -> None:
        for r in rows:
            for line in r["text"].split("\n"):
                on_line(str(r["brief_id"]), line)

    composed_texts.foreachPartition(give)


def passages(rows: DataFrame, queries: DataFrame, most: int = 6) -> DataFrame:
    """SNK-07: (query_id, rank, text, source, score), the retriever's form of ``retrieve.find``."""
    return retrieve.find(rows, queries, most).select("query_id", "rank", F.col("sentence").alias("text"), "source", "score")


def respond(rows: DataFrame, turns: DataFrame, records: DataFrame, answered_before: DataFrame) -> DataFrame:
    """CV-02: (conv_id, turn, answer, sources, kind, abstained, mark) of each user's question within its scope.

    A turn's own documents are searched first; where they give nothing the whole store is.  ``mark`` names the sources of what is said.
    ``records``: (entity, field, value).
    """
    asked = turns.filter("role = 'user'").withColumn("query_id", F.xxhash64("conv_id", "turn"))
    scope = scopes(turns, answered_before, rows).withColumn("query_id", F.xxhash64("conv_id", "turn"))
    inside = scope.select("query_id", F.explode("scope").alias("source"))
    own = retrieve.find(rows, asked.join(inside.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.col("text").alias("query")), scope=inside)
    best = own.groupBy("query_id").agg(F.min_by(F.struct("sentence", "source"), "rank").alias("own"))
    told = claims.answered(rows, asked.select("query_id", F.col("text").alias("query")), records)
    both = asked.select("conv_id", "turn", "query_id").join(told, "query_id").join(best, "query_id", "left")
    mine = F.col("own").isNotNull() & (F.coalesce(F.col("kind"), F.lit("line")) == "line")
    source = F.when(mine, F.array("own.source")).otherwise(F.when(F.col("kind") == "line", F.slice("sources", 1, 2)).otherwise(F.array().cast("array<string>")))
    return both.select(
        "conv_id", "turn", F.when(mine, F.col("own.sentence")).otherwise(F.col("answer")).alias("answer"), source.alias("sources"),
        F.when(mine, "line").otherwise(F.col("kind")).alias("kind"), (F.col("abstained") & ~mine).alias("abstained"),
        F.when(F.size(source) > 0, F.concat(F.lit("(~ "), F.array_join(F.transform(source, tx.source_name), " · "), F.lit(")"))).alias("mark"))


def histories(stream: DataFrame) -> DataFrame:
    """ST-04: (conv_id, turns, history) as keyed state: the last messages of each conversation, given out at each change.

    ``stream``: (conv_id, turn, role, text).  A conversation's state holds twelve messages at most and ends after a day without one.
    """
    kind = stream.schema["conv_id"].dataType.simpleString()

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, held = state.get if state.exists else (0, [])
        held = list(held)
        for batch in batches:
            batch = batch.sort_values("turn")
            n += len(batch)
            held = [*held, *(f"{r}: {t}" for r, t in zip(batch["role"], batch["text"]))][-HISTORY:]
        state.update((n, held))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "history": [held]})

    return stream.groupBy("conv_id").applyInPandasWithState(
        advance, f"conv_id {kind}, turns long, history array<string>", "turns long, history array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)
