"""Column-level evidence checks: is a sentence carried by its evidence (GT-01 .. GT-11, GT-18)?

All are expressions over two or three text columns of one row; nothing is shuffled.
Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as tx


def _bigrams(toks: Column) -> Column:
    return F.when(F.size(toks) > 1, F.transform(F.sequence(F.lit(0), F.size(toks) - 2), lambda i: F.struct(F.get(toks, i).alias("a"), F.get(toks, i + 1).alias("b")))).otherwise(
        F.array().cast("array<struct<a:string,b:string>>")
    )


def prepared(df: DataFrame, answer: str, evidence: str, question: str | None = None) -> DataFrame:
    """The row's token arrays under reserved names, computed once for all checks."""
    listless = F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), r"(?m)^\s*\d{1,2}[.)]\s+", "")
    asked = F.coalesce(F.col(question), F.lit("")) if question else F.lit("")
    held = F.coalesce(F.col(evidence), F.lit(""))
    given = F.concat_ws(" ", held, asked)
    step = df.withColumns({
        "_at": tx.tokens(F.coalesce(F.col(answer), F.lit(""))), "_lt": tx.tokens(listless), "_bt": tx.tokens(held), "_gt": tx.tokens(given), "_qt": tx.tokens(asked),
    })
    return step.withColumns({
        "_aw": F.array_distinct(tx.content(F.col("_at"))), "_gw": F.array_distinct(tx.content(F.col("_gt"))), "_ew": F.array_distinct(tx.content(F.col("_bt"))),
        "_qw": F.array_distinct(tx.content(F.col("_qt"))), "_ha": tx.anchors(F.col("_at")), "_ga": tx.anchors(F.col("_gt")), "_bp": _bigrams(F.col("_bt")),
    })


RESERVED = ("_at", "_lt", "_bt", "_gt", "_qt", "_aw", "_gw", "_ew", "_qw", "_ha", "_ga", "_bp")


def digits_ok() -> Column:
    """GT-01: every number of the answer stands in the evidence beside one of the same neighbours."""
    at, bt = F.col("_lt"), F.col("_bt")
    pair = lambda a, b: F.array_contains("_bp", F.struct(a.alias("a"), b.alias("b")))

    def fits(i: Column) -> Column:
        t, before, after = F.get(at, i), F.get(at, i - 1), F.get(at, i + 1)
        near = F.coalesce(pair(before, t), F.lit(False)) | F.coalesce(pair(t, after), F.lit(False))
        return ~tx.is_number(t) | (F.array_contains(bt, t) & ((F.size(at) == 1) | near))

    return F.when(F.size(at) > 0, F.forall(F.sequence(F.lit(0), F.size(at) - 1), fits)).otherwise(F.lit(True))


def digits_present() -> Column:
    """GT-02: every number of the answer stands somewhere in the evidence."""
    return F.size(F.array_except(F.filter(F.col("_at"), tx.is_number), F.col("_bt"))) == 0


def coverage(answer: str) -> Column:
    """GT-03: the share of the answer's words that evidence and question carry; no words give 0."""
    given = F.col("_gw")
    hosts = F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(r"([\p{L}\p{N}]+)['’][\p{L}]{2,}"), 1)
    tails = F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(r"[\p{L}\p{N}]+['’]([\p{L}]{2,})"), 1)
    attested = F.filter(F.arrays_zip(hosts.alias("h"), tails.alias("t")), lambda z: tx.stem_held(tx.fold(z["h"]), given))
    dropped = F.transform(attested, lambda z: tx.fold(z["t"]))

    def anchored(w: Column) -> Column:
        mine = F.filter("_ha", lambda h: h["token"] == w)
        return F.exists(mine, lambda h: F.exists("_ga", lambda g: (g["number"] == h["number"]) & (F.startswith(g["token"], w) | F.startswith(w, g["token"]))))

    hit = lambda w: F.array_contains(given, w) | tx.is_number(w) | tx.stem_held(w, given) | anchored(w)
    share = lambda held: F.when(F.size(held) > 0, F.size(F.filter(held, hit)) / F.size(held)).otherwise(F.lit(0.0))
    return tx.let(F.array_except("_aw", dropped), share)


def carried() -> Column:
    """GT-06: the share of the question's words that the answer reaches; nothing asked gives 1."""
    asked = F.col("_qw")
    hit = F.filter(asked, lambda q: tx.stem_held(q, F.col("_aw")))
    return F.when(F.size(asked) > 0, F.size(hit) / F.size(asked)).otherwise(F.lit(1.0))


def missing() -> Column:
    return F.filter(F.col("_qw"), lambda q: ~tx.stem_held(q, F.col("_aw")))


def unsupported() -> Column:
    return F.filter(F.col("_aw"), lambda w: ~tx.stem_held(w, F.col("_ew")))


def grounded_in(value: Column, message: Column) -> Column:
    """GT-11: some longer token of the value begins one of the message, or is begun by one; no token passes."""
    long = lambda c: F.filter(tx.tokens(c), lambda t: F.length(t) >= tx.CONTENT)
    met = lambda v, m: (F.size(v) == 0) | F.exists(v, lambda a: F.exists(m, lambda b: F.startswith(a, b) | F.startswith(b, a)))
    return tx.let(long(value), lambda v: tx.let(long(message), lambda m: met(v, m)))


def check(df: DataFrame, answer: str, evidence: str, question: str | None = None) -> DataFrame:
    """GT-07: the table with ``figures_ok``, ``coverage``, ``carried``, ``missing``, ``unsupported`` and ``ok``.

    ``ok`` needs the figures right and all words of the answer carried (GT-04).
    """
    ready = prepared(df, answer, evidence, question).withColumns({
        "figures_ok": digits_ok(), "figures_present": digits_present(), "coverage": coverage(answer), "carried": carried(),
        "missing": missing(), "unsupported": unsupported(),
    })
    return ready.withColumn("ok", F.col("figures_ok") & (F.col("coverage") == 1.0)).drop(*RESERVED)


def grounded_sentences(df: DataFrame, key: str, answer: str, evidence: str) -> DataFrame:
    """GT-05: (key, kept): the answer without sentences that mix carried and uncarried words."""
    parts = df.select(key, answer, evidence, F.posexplode(F.split(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", ""), r"(?<=[.!?])\s+")).alias("_pos", "_part"))
    scored = prepared(parts, "_part", evidence).withColumn("_share", coverage("_part"))
    whole = scored.groupBy(key).agg(
        F.first(answer).alias("_answer"), F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.when(F.col("_share").isin(0.0, 1.0), F.struct("_pos", "_part")))).alias("_kept"),
    )
    same = (F.col("_n") < 2) | (F.size("_kept") == 0) | (F.size("_kept") == F.col("_n"))
    return whole.select(key, F.when(same, F.col("_answer")).otherwise(F.array_join("_kept._part", " ")).alias("kept"))


def specific(records: DataFrame) -> DataFrame:
    """GT-18: records whose value is not an ancestor of another value in the same slot."""
    other = records.select(F.col("subject").alias("s2"), F.col("predicate").alias("p2"), F.col("value").alias("w"))
    step = records.select(F.col("subject").alias("w"), F.col("predicate").alias("p2"), F.col("value").alias("v2")).distinct()
    wider = other.join(step, ["w", "p2"]).select("s2", "p2", "v2").distinct()
    return records.join(wider, (F.col("subject") == F.col("s2")) & (F.col("predicate") == F.col("p2")) & (F.col("value") == F.col("v2")), "left_anti")
