"""Text kernel: folding, tokens, sentences, stems, stamps, measures, records (TXT-01 .. TXT-30).

Column functions stay in the JVM.  The one exception is canonical composition, which only texts with combining
marks take.  An array that an expression reads at each of its own elements is bound with ``let``, so that it is made once a row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT = 3  # shortest content word
ROOT, TAIL = 5, 3  # stem: shortest common root, longest differing tail
DIGIT = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
SPACE = " \t\n\f\r"
SEAM = r"(\p{L}{2}\p{L}*?\p{Ll})(?=\p{Lu})"  # a match takes the letters since the last cut, so the next one starts to count after it
BESIDE = rf"(?<=[{DIGIT}])(?=\p{{L}})|(?<=\p{{L}})(?=[{DIGIT}])"
TOKEN = r"[\p{L}\p{N}]+"


@cache
def fold_table() -> tuple[str, str]:
    """Characters whose folding is not their lower case, by rule: the first code point of upper-then-casefold."""
    a, b = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if not 0xD800 <= code <= 0xDFFF and ch.isalpha():
            folded = ch.upper().casefold()[:1]
            low = ch.lower()
            if folded != low:
                a.append(ch)
                b.append(folded)
    return "".join(a), "".join(b)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def _folded(x: Column) -> Column:
    a, b = fold_table()
    # lower() writes a capital sigma at a word's end as the final form; plain ASCII needs no table
    return F.when(_ascii(x), F.lower(x)).otherwise(F.translate(F.lower(F.translate(x, a, b)), "ς", "σ"))


def fold(c: Column | str) -> Column:
    """TXT-01: letter folding that keeps the length; null stays null."""
    return _folded(F.col(c)) if isinstance(c, str) else let(c, _folded)


def composed(df: DataFrame, column: str) -> DataFrame:
    """Canonical composition of a column; only rows that hold combining marks leave the JVM."""
    has_marks = F.coalesce(F.col(column).rlike(r"\p{M}"), F.lit(False))
    nfc = F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize("NFC", x)), T.StringType())
    return df.filter(~has_marks).unionByName(df.filter(has_marks).withColumn(column, nfc(column)))


def bare(c: Column) -> Column:
    """TXT-02: without the punctuation it begins or ends with."""
    return F.regexp_replace(c, r"^\p{P}+|\p{P}+$", "")


def boundaries(c: Column) -> Column:
    """TXT-03: a space at each lower-to-upper seam after a whole word, and between digits and letters."""
    def cut(x: Column) -> Column:
        seam = F.when(x.rlike(r"\p{Ll}\p{Lu}"), F.regexp_replace(x, SEAM, "$1 ")).otherwise(x)
        return F.regexp_replace(seam, BESIDE, " ")

    return let(c, cut)


def tokens(c: Column) -> Column:
    """TXT-04: all tokens in order, folded; the whole text is folded at once, letter by letter as its tokens would be."""
    plain = let(c, lambda x: F.when(_ascii(x), x).otherwise(F.regexp_replace(x, r"\p{M}+", "")))
    return F.regexp_extract_all(fold(boundaries(plain)), F.lit(TOKEN), 0)


def is_number(t: Column) -> Column:
    return t.rlike(rf"^[{DIGIT}]+$")


def content(toks: Column, known: Column | None = None) -> Column:
    """TXT-05: content words of a token array: long enough, a number, beside a number, or a known unit."""
    def kept(all_: Column) -> Column:
        def keep(t: Column, i: Column) -> Column:
            beside = is_number(F.coalesce(F.get(all_, i - 1), F.lit(""))) | is_number(F.coalesce(F.get(all_, i + 1), F.lit("")))
            vouched = F.array_contains(known, t) if known is not None else F.lit(False)
            return (F.length(t) >= CONTENT) | is_number(t) | beside | vouched

        return F.filter(all_, keep)

    return let(toks, kept)


def words(c: Column, known: Column | None = None) -> Column:
    return content(tokens(c), known)


def anchors(toks: Column) -> Column:
    """TXT-07: (token, number) for each token beside a number."""
    def paired(all_: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.size(all_)), lambda i: is_number(F.coalesce(F.get(all_, i), F.lit(""))))

        def beside(i: Column) -> Column:
            places = F.filter(F.array(i - 1, i + 1), lambda j: F.get(all_, j).isNotNull())
            return F.transform(places, lambda j: F.struct(F.get(all_, j).alias("token"), F.get(all_, i).alias("number")))

        return F.array_distinct(F.flatten(F.transform(numbers, beside)))

    return let(toks, paired)


def quantity_tokens(c: Column) -> Column:
    """TXT-06: (token, beside) of letter and symbol runs; beside: a number stands next to it."""
    number = lambda x: F.coalesce(x, F.lit("")).rlike(r"^\d")

    def flagged(runs: Column) -> Column:
        each = F.transform(runs, lambda t, i: F.struct(_folded(t).alias("token"), (number(F.get(runs, i - 1)) | number(F.get(runs, i + 1))).alias("beside")))
        return F.filter(each, lambda x: ~x["token"].rlike(r"^\d"))

    return let(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?|[\p{L}]+|[^\w\s]+"), 0), flagged)


def sentences(c: Column, marks: str = ".!?") -> Column:
    """TXT-08: parts of a text, trimmed, without empty ones."""
    parts = F.split(c, rf"(?<=[{marks}])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def source_name(c: Column) -> Column:
    """TXT-09: the name in a source stamp, without its prefix and file extension."""
    name = F.when(F.contains(c, F.lit(":")), F.regexp_replace(c, r"^[^:]*:", "")).otherwise(F.regexp_replace(c, r"^#+", ""))
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def stamp_parts(c: Column) -> Column:
    """TXT-10: the first three whole numbers of a stamp, else null; no calendar is asked."""
    found = F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    return F.when(F.size(found) >= 3, F.transform(F.slice(found, 1, 3), lambda x: x.try_cast("int")))


def stamp_day(c: Column) -> Column:
    """The day of a stamp as a date where the calendar has it."""
    p = stamp_parts(c)
    text = F.format_string("%04d-%02d-%02d", p[0], p[1], p[2])
    return F.when(p.isNotNull() & (p[0] < 10000) & (p[1] < 100) & (p[2] < 100), F.try_to_date(text, "yyyy-MM-dd"))


def _rooted(a: Column, b: Column, root: int) -> Column:
    """A common root of ``root`` letters and tails of three or fewer, as one comparison of two prefixes."""
    n = F.greatest(F.lit(root), F.greatest(F.length(a), F.length(b)) - TAIL)
    return (a == b) | (F.left(a, n) == F.left(b, n))


def same_stem(a: Column, b: Column) -> Column:
    """TXT-13: equal, or a common root of five or more and tails of three or fewer."""
    return _rooted(a, b, ROOT)


def kin(a: Column, b: Column) -> Column:
    """TXT-14: equal, or a common prefix of three or more and tails of three or fewer."""
    return _rooted(a, b, CONTENT)


def stem_held(word: Column, given: Column) -> Column:
    """Some word of an array has the word's stem."""
    return F.exists(given, lambda g: same_stem(g, word))


# Fixed values, the written form of a measure: a number that no letter, digit, point or comma touches from before and
# no further decimal part follows; and up to four signs behind it as its unit, unless they are mere marks before another number.
_MARKS = r"(?:[^\p{L}\p{N}\s]{4}|[^\p{L}\p{N}\s]{1,3}(?=[\s\d]))[^\p{L}\p{N}]*\d"
MEASURED = rf"(?<![\p{{L}}\p{{N}}_.,])(-?\d+(?:[.,]\d+)?)(?![\p{{L}}\p{{N}}_.,]*[.,]\d)(?:[ \t]?(?!{_MARKS})([^\s\d]{{1,4}}))?"


def measure(c: Column) -> Column:
    """TXT-11: struct (low, high, unit): the first number with its unit, widened by later numbers of that unit; no number gives null.

    A sign counts at the first number alone.  A unit loses the marks behind its last letter.
    """
    unit = lambda u: F.nullif(_folded(F.when(u.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(u, r"[^\p{L}\p{N}]+$", "")).otherwise(u)), F.lit(""))
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")
    pieces = F.arrays_zip(
        F.transform(F.regexp_extract_all(c, F.lit(MEASURED), 1), number).alias("x"), F.transform(F.regexp_extract_all(c, F.lit(MEASURED), 2), unit).alias("u"))

    def ranged(m: Column) -> Column:
        first = F.get(m, 0)
        later = F.transform(F.filter(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda p: p["u"].eqNullSafe(first["u"])), lambda p: F.abs(p["x"]))
        # least and greatest pass over the null of an empty array
        return F.when(F.size(m) > 0, F.struct(F.least(first["x"], F.array_min(later)).alias("low"), F.greatest(first["x"], F.array_max(later)).alias("high"), first["u"].alias("unit")))

    return let(pieces, ranged)


def fold_text(text: str) -> str:
    """``fold`` of a plain string."""
    return "".join(ch.upper().casefold()[:1] or ch for ch in text)


def overlap(a: Column, b: Column) -> Column:
    """TXT-12: do two measures leave room for each other; null where units are missing or differ."""
    comparable = a["unit"].isNotNull() & b["unit"].isNotNull() & (a["unit"] == b["unit"])
    return F.when(comparable, (a["low"] <= b["high"]) & (b["low"] <= a["high"]))


def record_pairs(c: Column, most_chars: int = 200) -> Column:
    """TXT-15: (head, value) of each short 'HEAD: value' segment of a text."""
    segments = F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    short = F.filter(segments, lambda s: F.contains(s, F.lit(":")) & (F.length(s) <= most_chars))

    def pair(s: Column) -> Column:
        head = F.regexp_replace(F.regexp_replace(s, r"(?s):.*$", ""), r"(?s)^.*—", "")
        head = F.regexp_replace(head, r"^[·•*\-– \t]+|\s+$", "")
        head = F.regexp_replace(head, r"^(?:\d{1,3}\.\s*)+", "")
        value = F.regexp_replace(F.regexp_replace(s, r"(?s)^[^:]*:", ""), r"^\s+|[\s.]+$", "")
        return F.struct(F.regexp_replace(head, r"^\s+", "").alias("head"), value.alias("value"))

    pairs = F.transform(short, pair)
    return F.filter(pairs, lambda p: F.size(words(p["head"])).between(1, 3) & (p["value"] != ""))


def markup_share(c: Column) -> Column:
    """SRC-16: the share of characters inside tags; null and empty have 0."""
    gone = F.length(F.regexp_replace(c, r"<[^<>\s][^<>]*>", ""))
    return F.when(F.length(c) > 0, (F.length(c) - gone) / F.length(c)).otherwise(F.lit(0.0))


def same_region(a: Column, b: Column) -> Column:
    """TXT-25: two word sets share more than half of their union, or of the smaller one."""
    both = F.size(F.array_intersect(a, b))
    union = F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    smaller = F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))
    return (both > 0) & ((both / union > 0.5) | (both / smaller > 0.5))


def without_marks(c: Column) -> Column:
    """TXT-29: engine marks and source tags removed, spaces closed up."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\(~[^)]*\)", ""), r"#\S+", ""), r" {2,}", " ")


def spans(c: Column) -> Column:
    """TXT-26: all runs of a text's words, the longest first."""
    def runs(w: Column) -> Column:
        sizes = F.sequence(F.size(w), F.lit(1), F.lit(-1))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))

    return let(F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+"), runs)


def register(spark) -> None:
    """UD-08: fold, tokens and measure as SQL functions, over the patterns of the column functions."""
    a, b = fold_table()

    def say(name: str, gives: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {gives} RETURN {body}")

    r = "r'{}'".format
    folding = "translate(lower(translate({}, '" + a + "', '" + b + "')), 'ς', 'σ')"
    say("cairn_fold", "STRING", folding.format("t"))
    marks = r(r"\p{M}+")
    say("cairn_tokens", "ARRAY<STRING>", f"regexp_extract_all(cairn_fold(regexp_replace(regexp_replace(regexp_replace(t, {marks}, ''), {r(SEAM)}, '$1 '), {r(BESIDE)}, ' ')), {r(TOKEN)}, 0)")
    tail, letter = r(r"[^\p{L}\p{N}]+$"), r(r"[\p{L}\p{N}]")
    unit = f"transform(regexp_extract_all(t, {r(MEASURED)}, 2), u -> nullif({folding.format(f"if(regexp_like(u, {letter}), regexp_replace(u, {tail}, ''), u)")}, ''))"
    number = f"transform(regexp_extract_all(t, {r(MEASURED)}, 1), x -> CAST(replace(x, ',', '.') AS DOUBLE))"
    rest = "transform(filter(slice(m, 2, greatest(size(m) - 1, 0)), p -> p['1'] <=> m[0]['1']), p -> abs(p['0']))"
    ranged = f"if(size(m) > 0, named_struct('low', least(m[0]['0'], array_min({rest})), 'high', greatest(m[0]['0'], array_max({rest})), 'unit', m[0]['1']), NULL)"
    say("cairn_measure", "STRUCT<low: DOUBLE, high: DOUBLE, unit: STRING>", f"get(transform(array(arrays_zip({number}, {unit})), m -> {ranged}), 0)")
