"""The typed plan algebra over dated lines (PL-01 .. PL-18, AG-08 .. AG-10).

A plan is a few named steps.  It is checked for its types before anything runs; a wrong plan is None.  Values are
DataFrames of at most one row (date, days, bool, count, month, amount) or of many (lines), so a plan
is one lazy DataFrame graph.  ``lines`` hold (sid, day, sentence) and, where amounts are read, amount.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as tx

MOST_STEPS = 6
#: operator -> (kinds of its arguments, kind of its result); 'phrase' is text.
SIGNATURES = {
    "anchor": (("phrase",), "date"), "latest": (("phrase",), "date"), "now": ((), "date"), "lines": (("phrase",), "lines"),
    "span": (("date", "date"), "days"), "before": (("date", "date"), "bool"), "before_lines": (("lines", "date"), "lines"),
    "after_lines": (("lines", "date"), "lines"), "count": (("lines",), "count"), "month_tally": (("lines",), "month"),
    "amount": (("phrase",), "amount"), "minus": (("amount", "amount"), "derived"), "ratio": (("amount", "amount"), "derived"), "per": (("amount", "amount"), "derived"),
}


@dataclass(frozen=True)
class Step:
    name: str
    op: str
    args: tuple[str, ...]


def parsed(text: str) -> list[Step] | None:
    """Steps ``name = op: a, b``; None for an unknown operator, a dangling name, a wrong kind or too many steps."""
    steps: list[Step] = []
    kinds: dict[str, str] = {}
    for line in filter(None, (x.strip() for x in text.splitlines())):
        m = re.fullmatch(r"(\w+)\s*=\s*(\w+)\s*:\s*(.*)", line)
        if m is None or m[2] not in SIGNATURES:
            return None
        wants, gives = SIGNATURES[m[2]]
        args = tuple(a.strip() for a in m[3].split(",")) if wants and wants != ("phrase",) else ((m[3].strip(),) if wants else ())
        if len(args) != len(wants) or any(w != "phrase" and kinds.get(a) != w for a, w in zip(args, wants)) or m[1] in kinds:
            return None
        if wants == ("phrase",) and not args[0]:
            return None
        kinds[m[1]] = gives
        steps.append(Step(m[1], m[2], args))
    return steps if 0 < len(steps) <= MOST_STEPS else None


def holding(lines: DataFrame, phrase: str) -> DataFrame:
    """JN-06: lines that hold more than half of the information of the phrase's words that are known at all."""
    words = F.array_distinct(tx.words(F.lit(phrase)))
    held = lines.select("sid", F.explode(F.array_intersect(tx.words(F.col("sentence")), words)).alias("word")).distinct()
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    weight = held.groupBy("word").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total), F.lit(True)).select("word", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    whole = weight.agg(F.sum("w").alias("whole"))
    share = held.join(F.broadcast(weight), "word").groupBy("sid").agg(F.sum("w").alias("w"))
    kept = share.join(F.broadcast(whole), F.lit(True)).filter(F.round(2 * F.col("w"), 9) > F.round("whole", 9)).select("sid")
    return lines.join(kept, "sid", "left_semi")


def month_tally(lines: DataFrame) -> DataFrame:
    """AG-10: (month, n): the month with most dated lines, the earliest of equals."""
    month = F.date_format("day", "yyyy/MM")
    return lines.filter("day is not null").groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "month").limit(1)


def counted(lines: DataFrame) -> DataFrame:
    """PL-08: (n): how many lines; several lines of one day are no series and give no row."""
    both = lines.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"))
    return both.filter("n > 0 and (n = 1 or days >= 2)").select("n")


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


NUMBER = r"\d+(?:[.,]\d+)?"


def homes(items: DataFrame, lines: DataFrame) -> DataFrame:
    """JN-07: (item, amount_text, value, sid): the first line that holds an amount verbatim and a word of its item.

    ``items``: (item, amount_text) as read by an engine, each with exactly one number, others fall away.  The join is on the number's token, the
    verbatim test and the item's words, up to their endings, come behind it; an item without words needs the amount alone.
    """
    token = lines.select("sid", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(NUMBER), 0))).alias("number"))
    numbers = F.regexp_extract_all("amount_text", F.lit(NUMBER), 0)
    plain = F.filter(tx.words(F.coalesce("item", F.lit(""))), lambda w: ~tx.is_number(w))
    wanted = items.select("item", "amount_text", numbers.alias("n"), plain.alias("iw")).filter(F.size("n") == 1).select("item", "amount_text", "iw", F.get("n", 0).alias("number"))
    met = wanted.join(token, "number").filter(F.contains("sentence", F.col("amount_text")))
    about = tx.let(tx.words(F.col("sentence")), lambda w: F.exists("iw", lambda i: tx.stem_held(i, w)))
    held = met.filter((F.size("iw") == 0) | about)
    value = F.replace("number", F.lit(","), F.lit(".")).cast("double")
    return held.groupBy("item", "amount_text", value.alias("value")).agg(F.min("sid").alias("sid"))


def verified_sum(items: DataFrame, lines: DataFrame) -> DataFrame:
    """AG-09: (total, shown): the sum of amounts that have a home line, each value once for the words of its item.

    A whole total is shown as an integer, another with two decimals; no amount gives a null row.
    """
    words = F.array_join(F.array_sort(F.array_distinct(tx.words(F.coalesce("item", F.lit(""))))), " ")
    once = homes(items, lines).select("value", words.alias("words")).distinct()
    total = once.agg(F.round(F.sum("value"), 2).alias("total"))
    shown = F.when(F.col("total") == F.floor("total"), F.floor("total").cast("string")).otherwise(F.format_string("%.2f", "total"))
    return total.select("total", F.when(F.col("total").isNotNull(), shown).alias("shown"))


def run(plan: str, lines: DataFrame, now: Column | None = None, want: tuple[str, ...] | None = None, read: bool = True) -> DataFrame | None:
    """PL-14: the value of a plan's last step as a DataFrame, or None for a plan that does not hold.

    ``read`` says that the dates of anchors are taken as read; without it a span or an order dies, as a mere stamp
    is no reading.
    """
    steps = parsed(plan)
    if steps is None or want and SIGNATURES[steps[-1].op][1] not in want:
        return None
    values: dict[str, DataFrame] = {}
    spark = lines.sparkSession
    both = lambda a, b: values[a].toDF("a").crossJoin(values[b].toDF("b"))  # noqa: E731  one row each
    for s in steps:
        if s.op in ("anchor", "latest"):
            pick = F.min if s.op == "anchor" else F.max
            values[s.name] = holding(lines.filter("day is not null"), s.args[0]).agg(pick("day").alias("day"))
        elif s.op == "now":
            values[s.name] = spark.range(1).select((now if now is not None else F.current_date()).cast("date").alias("day"))
        elif s.op == "lines":
            values[s.name] = holding(lines, s.args[0])
        elif s.op in ("span", "before"):
            if not read:
                return None
            pair = both(*s.args).filter("a is not null and b is not null")
            values[s.name] = pair.select(days_between(F.col("a"), F.col("b")).alias("days") if s.op == "span" else (F.col("a") < F.col("b")).alias("earlier"))
        elif s.op in ("before_lines", "after_lines"):
            cut = values[s.args[1]].toDF("cut")
            test = F.col("day") < F.col("cut") if s.op == "before_lines" else F.col("day") > F.col("cut")
            values[s.name] = values[s.args[0]].join(F.broadcast(cut), test).drop("cut")
        elif s.op == "count":
            values[s.name] = counted(values[s.args[0]])
        elif s.op == "month_tally":
            values[s.name] = month_tally(values[s.args[0]])
        elif s.op == "amount":
            held = holding(lines.filter("amount is not null"), s.args[0])
            values[s.name] = held.agg(F.min_by(F.struct("amount", "sid"), F.struct("day", "sid")).alias("v")).filter("v is not null")
        else:
            pair = both(*s.args).filter("a.sid <> b.sid or a.amount <> b.amount")
            a, b = F.col("a.amount"), F.col("b.amount")
            value = {"minus": a - b, "ratio": 100 * F.try_divide(a, b), "per": F.try_divide(a, b)}[s.op]
            values[s.name] = pair.select(F.round(value, 6).alias("value")).filter("value is not null")
    return values[steps[-1].name]
