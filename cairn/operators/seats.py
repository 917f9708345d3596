"""Seats of a ranking: few lines of each region and source, later statements before earlier ones, and a line for a measurement asked for (RK-04 .. RK-07).

A walk over a ranking is sequential, so it goes chunk by chunk: a task holds one question's chunk and its few seats so far, never a
whole ranking, and only questions whose seats are not settled go on to the next chunk, which is twice as long.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text as tx
from cairn.operators.retrieve import top
from cairn.session import checkpointed

CHUNK = 64
SCAN = 300  # fixed value: how far down the line of a measurement is looked for
STATE = "query_id {}, taken array<struct<sid:{},source:string,sentence:string,words:array<string>>>, over array<struct<sid:{},source:string,sentence:string,words:array<string>>>, done boolean"


def near(a: set, b: set) -> bool:
    """TXT-25: two word sets share more than half of their union, or of the smaller."""
    both = len(a & b)
    return both > 0 and (2 * both > len(a | b) or 2 * both > min(len(a), len(b)))


def _walk(taken: list, over: list, lines: list, most: int, cap: int, many: bool) -> bool:
    """Seats the lines (sid, source, sentence, words) in turn; whether all seats are taken."""
    by_source: dict = {}
    for t in taken:
        by_source[t[1]] = by_source.get(t[1], 0) + 1
    sets = [set(t[3]) for t in taken]
    for line in lines:
        if len(taken) == most:
            return True
        words = set(line[3])
        crowded = sum(near(w, words) for w in sets) >= (1 if many else cap) or many and by_source.get(line[1], 0) >= cap
        if crowded:
            if len(over) < most:
                over.append(line)
            continue
        by_source[line[1]] = by_source.get(line[1], 0) + 1
        taken.append(line)
        sets.append(words)
    return len(taken) == most


def seats(ranked: DataFrame, most: int = 6, chunk: int = CHUNK, order: Column | None = None) -> DataFrame:
    """RK-04: (query_id, seat, sid, source, sentence): greedy seats with caps for a region and a source; what overflows refills.

    ``ranked``: (query_id, score, sid, source, sentence) and whatever ``order`` (the tie column) needs.  At most two lines of a source
    are seated where a ranking has several sources, and one of a region; of one source two of a region.  The whole ranking counts.
    """
    cap = max(1, min(2, most - 1))
    made = tx.words(F.col("sentence"))
    known = checkpointed(ranked.withColumn("words", F.array_distinct(made)))
    kinds = [known.schema[c].dataType.simpleString() for c in ("query_id", "sid")]
    schema = STATE.format(kinds[0], kinds[1], kinds[1])
    about = known.groupBy("query_id").agg((F.count_distinct("source") > 1).alias("many"), F.count(F.lit(1)).alias("lines"))
    about = checkpointed(about)

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        taken, over = [], []
        if len(first := part[part["rank"] == 0]):
            unpack = lambda rows: [(r["sid"], r["source"], r["sentence"], list(r["words"])) for r in rows]
            taken, over = unpack(first["taken"].iloc[0]), unpack(first["over"].iloc[0])
        rest = part[part["rank"] > 0]
        full = _walk(taken, over, list(zip(rest["sid"], rest["source"], rest["sentence"], rest["words"])), most, cap, bool(part["many"].iloc[0]))
        pack = lambda rows: [{"sid": s, "source": o, "sentence": t, "words": list(w)} for s, o, t, w in rows]
        done = full or int(part["upto"].iloc[0]) >= int(part["lines"].iloc[0])
        return pd.DataFrame({"query_id": [part["query_id"].iloc[0]], "taken": [pack(taken)], "over": [pack(over)], "done": [done]})

    state, settled, low, high = None, None, 0, chunk
    while True:
        live = known if state is None else known.join(state.select("query_id"), "query_id", "left_semi")
        part = top(live, high, order).filter(F.col("rank") > low).select("query_id", "rank", "sid", "source", "sentence", "words")
        kept = T._parse_datatype_string(schema)
        part = part.withColumns({c: F.lit(None).cast(kept[c].dataType) for c in ("taken", "over")})
        if state is not None:
            empty = {c: F.lit(None).cast(part.schema[c].dataType) for c in ("sid", "source", "sentence", "words")}
            part = part.unionByName(state.select("query_id", "taken", "over").withColumns({"rank": F.lit(0), **empty}))
        part = part.join(about, "query_id").withColumn("upto", F.lit(high))
        walked = checkpointed(part.groupBy("query_id").applyInPandas(settle, schema))
        now = walked.filter("done")
        settled = now if settled is None else settled.unionByName(now)
        state = walked.filter("not done")
        if state.isEmpty():
            break
        low, high = high, 2 * high
    each = settled.select("query_id", F.posexplode(F.slice(F.concat("taken", "over"), 1, most)).alias("seat", "line"))
    return each.select("query_id", (F.col("seat") + 1).alias("seat"), "line.sid", "line.source", "line.sentence")


_FIRST_DIGIT = re.compile(r"\d")


def _family(source: str) -> tuple[str, tuple] | None:
    """The name before a stamp's first digit, and all its numbers."""
    m = _FIRST_DIGIT.search(source or "")
    name = " ".join(re.findall(r"[^\W\d_]{3,}", source[: m.start()].casefold())) if m else ""
    return (name, tuple(map(int, re.findall(r"\d+", source)))) if name else None


def _named_numbers(words: list[str]) -> dict[tuple, set]:
    """The numbers of a line under the one or two plain words before each."""
    has_digit = [any(c.isdigit() for c in w) for w in words]
    out: dict[tuple, set] = {}
    for i, w in enumerate(words):
        name = tuple(x for x, d in zip(words[max(0, i - 2) : i], has_digit[max(0, i - 2) : i]) if not d) if has_digit[i] else ()
        if name:
            out.setdefault(name, set()).add(w)
    return out


def later_speaks(lines: list[tuple]) -> list[int]:
    """RK-06: places of the lines (source, words) that stay: of two of one dated family that give one name other numbers, the later.

    Pairs are met in the lines' order, and a line that has lost its place takes no more part.
    """
    read = [(_family(s), _named_numbers(list(w))) for s, w in lines]
    gone: set[int] = set()
    for i in range(len(read)):
        for j in range(i + 1, len(read)):
            (a, na), (b, nb) = read[i], read[j]
            if i in gone or j in gone or not a or not b or a[0] != b[0] or a[1] == b[1]:
                continue
            if any(nb.get(name, numbers) != numbers for name, numbers in na.items()):
                gone.add(i if a[1] < b[1] else j)
    return [i for i in range(len(read)) if i not in gone]


def without_superseded(seated: DataFrame) -> DataFrame:
    """RK-06 over seats (query_id, seat, sid, source, sentence): a row is one question's few seats."""
    def keep(sources: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([later_speaks(list(zip(s, w))) for s, w in zip(sources, words)], dtype=object)

    others = [c for c in seated.columns if c not in ("query_id", "seat")]
    held = seated.select("query_id", F.struct("seat", *others, tx.words(F.col("sentence")).alias("words")).alias("line"))
    listed = held.groupBy("query_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    stay = F.pandas_udf(keep, T.ArrayType(T.IntegerType()))("lines.source", "lines.words")
    each = listed.withColumn("stay", stay).select("query_id", F.explode(F.transform("stay", lambda i: F.get("lines", i))).alias("line"))
    return each.select(*(c if c == "query_id" else F.col(f"line.{c}").alias(c) for c in seated.columns))


def asks_quantity(queries: DataFrame, quantities: DataFrame) -> DataFrame:
    """(query_id, asks): the words of a question that are, begin with, or share the stem of a token the corpus binds to numbers."""
    word = queries.select("query_id", F.explode(F.array_distinct(tx.words(F.col("query")))).alias("word"))
    token = quantities.select("token").distinct()
    met = (F.col("word") == F.col("token")) | F.startswith("word", F.col("token")) | tx.same_stem(F.col("word"), F.col("token"))
    # all of these share the first letter
    return word.join(token, F.left("word", F.lit(1)) == F.left("token", F.lit(1))).filter(met).groupBy("query_id").agg(F.collect_set("word").alias("asks"))


def measurement_seat(ranked: DataFrame, seated: DataFrame, queries: DataFrame, keys: DataFrame, quantities: DataFrame, bounds: DataFrame) -> DataFrame:
    """RK-07: (query_id, sid, source, sentence): one more line for a question that asks for a quantity by its word.

    Of the first ``SCAN`` ranked lines (query_id, rank, sid, source, sentence) that are short, name one of the question's words as a field (``keys``: word, sid),
    state a measure in a unit of the corpus (``quantities``: token) and do not spell the word asked for, the one most of whose words are the
    question's; lines of a region that is seated already give way.  ``bounds`` is one row (chars, toks) of record size.
    """
    asked = queries.select("query_id", F.array_distinct(tx.words(F.col("query"))).alias("qw"))
    token = quantities.select("token").distinct()
    lines = ranked.filter(F.col("rank") <= SCAN).join(asks_quantity(queries, quantities), "query_id").join(asked, "query_id")
    field = keys.select("sid", F.col("word").alias("key")).distinct()
    keyed = lines.join(field, "sid").filter(F.exists("qw", lambda q: tx.kin(q, F.col("key")))).select("query_id", "rank", "sid", "source", "sentence", "asks", "qw").distinct()
    sized = keyed.join(F.broadcast(bounds), F.lit(True)).withColumns({"t": tx.tokens(F.col("sentence")), "m": tx.measure(F.col("sentence"))})
    sized = sized.filter((F.length("sentence") <= F.col("chars")) & (F.size("t") <= F.col("toks")) & F.col("m.unit").isNotNull())
    units = sized.join(token.select(F.col("token").alias("unit")), F.col("m.unit") == F.col("unit"), "left_semi")
    known = units.withColumn("mine", F.array_distinct(tx.content(F.col("t")))).filter(~F.exists("asks", lambda a: tx.stem_held(a, F.col("mine"))))
    held = seated.groupBy("query_id").agg(F.collect_list(F.struct("sid", F.array_distinct(tx.words(F.col("sentence"))).alias("w"))).alias("held"))
    both = lambda w: F.size(F.array_intersect("mine", w))
    fresh = known.join(held, "query_id", "left").filter(~F.coalesce(F.exists("held", lambda h: (h["sid"] == F.col("sid")) | (
        2 * both(h["w"]) > F.greatest(F.least(F.size("mine"), F.size(h["w"])), F.lit(1)))), F.lit(False)))
    hit = F.size(F.filter("mine", lambda w: tx.is_number(w) | tx.stem_held(w, F.col("qw"))))
    best = fresh.withColumn("hit", hit).groupBy("query_id").agg(F.max_by(F.struct("sid", "source", "sentence"), F.struct(
        (F.col("hit") / F.greatest(F.size("mine"), F.lit(1))).alias("share"), "hit", (-F.size("mine")).alias("short"), (-F.col("rank")).alias("first"))).alias("b"))
    return best.select("query_id", "b.sid", "b.source", "b.sentence")
