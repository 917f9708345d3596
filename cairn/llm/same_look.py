"""Text that looks the same, brought to one form of characters.

A text is cut into pieces before every printable ASCII sign that follows a plain space, where nothing can join over the cut.
Each different piece that holds anything else is exploded to positioned code points, once however many texts have it;
a broadcast join with a mapping table (built by rule from the Unicode database, some 14,000 rows) replaces each
by what it shows: its canonical decomposition, the plain letter of its width, the
plain space, nothing, or the Latin letter it cannot be told from.  Combining
marks are put in the order of their classes, the pieces are rebuilt and recomposed, and the texts are put together again.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import checkpointed

# Letters of other scripts and symbols whose usual glyph is that of a Latin letter or sign.
LOOK_ALIKES = {
    "а": "a", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "с": "c",
    "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ԝ": "w", "ӏ": "l", "ѵ": "v", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G",
    "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T",
    "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U",
    "ɑ": "a", "ɡ": "g",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S",
    "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "µ": "μ", "‐": "-", "‑": "-", "ʼ": "’",
}
#: Code points that show nothing (default ignorable, without those that order or join what is shown).
UNSEEN = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200B),
    (0x200E, 0x200F), (0x202A, 0x202D), (0x2060, 0x206F), (0xFE00, 0xFE0E), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0100, 0xE01EF),
)
# Between these a joiner or selector shows: emoji sequences, and scripts whose letters join.
PICTURES = (
    r"#*0-9©®‼⁉™ℹ↔-↪⌚-⏿Ⓜ▪-➿⤴⤵⬅-⭕"
    r"〰〽㊗㊙️\x{1F000}-\x{1FAFF}"
)
JOINING = r"؀-ࣿऀ-෿"
#: (sign, what must stand before it, what must stand behind it) for the sign to show.
CONTEXT = (
    ("‍", f"{PICTURES}{JOINING}", f"(?=[{PICTURES}{JOINING}])"),
    ("‌", JOINING, f"(?=[{JOINING}])"),
    ("️", PICTURES, ""),
)
_KEPT = "﷐"  # no character; stands for a sign that shows
#: Printable ASCII with nothing to replace: such a text is its own form.
PLAIN = r"^[\x20-\x7e]*$"
_CUT = r"(?<= )(?=[\x20-\x7e])"


def _shown(ch: str) -> str:
    """What a code point shows, by rule: one step of the mapping table."""
    tagged = unicodedata.decomposition(ch)
    if unicodedata.category(ch) == "Zs":
        return " "
    if tagged.startswith("<"):
        kind, *parts = tagged.split()
        text = "".join(chr(int(p, 16)) for p in parts)
        name = unicodedata.name(ch, "")
        if kind in ("<wide>", "<narrow>", "<noBreak>"):
            return text
        if kind == "<compat>" and (len(text) > 1 and name.startswith("LATIN") or name.startswith(("ROMAN NUMERAL", "SMALL ROMAN NUMERAL"))):
            return text
    return ch


@cache
def _seconds() -> frozenset[str]:
    """Characters of class 0 that join the base before them: vowels and finals of Hangul and some vowel signs."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for code in range(0x10000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.combining(chr(int(parts[1], 16))) == 0:
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@cache
def mapping_rows() -> list[tuple[str, list[tuple[str, int, bool]]]]:
    """(char, pieces): each piece, its combining class and whether it begins a block; only where something changes."""
    unseen = {c for a, b in UNSEEN for c in range(a, b + 1)}
    out = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if code in unseen:
            out.append((ch, []))
            continue
        text = ch
        for _ in range(4):
            step = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFD", "".join(map(_shown, text))))
            if step == text:
                break
            text = step
        if text != ch or unicodedata.combining(ch) or ch in _seconds():
            out.append((ch, [(p, unicodedata.combining(p), not unicodedata.combining(p) and p not in _seconds()) for p in text]))
    return out


def mapping(spark: SparkSession) -> DataFrame:
    """The mapping table: one row for each code point that is not shown as itself."""
    return spark.createDataFrame(mapping_rows(), "ch string, pieces array<struct<piece:string,class:int,starts:boolean>>")


@F.pandas_udf(T.StringType())
def _recomposed(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: unicodedata.normalize("NFC", b))


def one_form(texts: DataFrame, column: str = "text") -> DataFrame:
    """(text, form) of each different text of a column; null has no row.

    A text of printable ASCII has nothing to replace and is its own form; any other
    goes through the code points.  The empty text's form is empty.  Long texts are
    spread as rows by position and come together in the one cell that holds their form.
    """
    different = texts.select(F.col(column).alias("text")).filter(F.col("text").isNotNull()).distinct()
    plain = different.filter(F.col("text").rlike(PLAIN)).select("text", F.col("text").alias("form"))
    odd = different.filter(~F.col("text").rlike(PLAIN))
    # 96 bits of hash stand for a text, and for a piece
    cut = odd.select("text", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.split("text", _CUT).alias("pieces"))
    each = cut.select("t1", "t2", F.posexplode("pieces").alias("at", "text")).filter(~F.col("text").rlike(PLAIN)).select(
        "t1", "t2", "at", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    formed = piece_forms(each.select("h1", "h2", "text").distinct())
    placed = each.select("t1", "t2", "at", "h1", "h2").join(formed, ["h1", "h2"], "left").groupBy("t1", "t2").agg(
        F.collect_list(F.struct("at", F.coalesce("form", F.lit("")).alias("form"))).alias("changed"))
    same = F.filter(F.transform("pieces", lambda p, i: F.struct(i.alias("at"), p.alias("form"))), lambda x: x["form"].rlike(PLAIN))
    whole = F.array_join(F.transform(F.array_sort(F.concat(same, "changed")), lambda x: x["form"]), "")
    return plain.unionByName(cut.join(placed, ["t1", "t2"]).select("text", whole.alias("form")))


def piece_forms(pieces: DataFrame) -> DataFrame:
    """(h1, h2, form) of different pieces (h1, h2, text), by their code points; a piece that shows nothing has no row."""
    spark = pieces.sparkSession
    seen = F.col("text")
    for sign, before, behind in CONTEXT:
        kept = F.regexp_replace(seen, f"([{before}]){sign}+{behind}", f"$1{_KEPT}")
        seen = F.when(F.contains(seen, F.lit(sign)), F.translate(kept, f"{_KEPT}{sign}", sign)).otherwise(seen)
    points = pieces.withColumn("points", F.split(seen, "")).select("h1", "h2", F.posexplode("points").alias("pos", "ch"))
    shown = (
        points.join(F.broadcast(mapping(spark)), "ch", "left")
        .withColumn("pieces", F.coalesce("pieces", F.array(F.struct(F.col("ch").alias("piece"), F.lit(0).alias("class"), F.lit(True).alias("starts")))))
        .select("h1", "h2", "pos", F.posexplode("pieces").alias("sub", "p"))
        .select("h1", "h2", "pos", "sub", "p.piece", "p.class")
    )
    by_place = Window.partitionBy("h1", "h2").orderBy("pos", "sub")
    # marks are put in order within a run that a character of class 0 begins
    runs = shown.withColumn("run", F.sum((F.col("class") == 0).cast("int")).over(by_place))
    rebuilt = runs.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("run", "class", "pos", "sub", "piece"))).alias("marks"))
    return rebuilt.select("h1", "h2", _recomposed(F.array_join("marks.piece", "")).alias("form"))


def same_look_pairs(rows: DataFrame, group: str, row_id: str, fields: list[str]) -> DataFrame:
    """(field, row_a, row_b): rows of a group whose field has one form but differs in characters.

    Texts of a group are first brought together to their different spellings, so rows
    of equal text meet no one and only pairs of the result are made.  Rows repeated exactly,
    null fields and null groups or ids give no pair; row_a is the smaller id.
    """
    long = _texts(rows, group, row_id, fields)
    members, mixed = _spellings(long)
    # pairs of different spellings first, then the rows of either: rows of one text never meet
    a = mixed.select("g", "field", "form", F.col("spelling").alias("sa"))
    b = mixed.select("g", "field", "form", F.col("spelling").alias("sb"))
    apart = a.join(b, ["g", "field", "form"]).filter("sa < sb").select("g", "field", "sa", "sb")
    ra = members.select("g", "field", F.col("spelling").alias("sa"), F.col("r").alias("ra"))
    rb = members.select("g", "field", F.col("spelling").alias("sb"), F.col("r").alias("rb"))
    pairs = apart.join(ra, ["g", "field", "sa"]).join(rb, ["g", "field", "sb"]).filter("ra <> rb")
    return pairs.select("field", F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b")).distinct()


def _spellings(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g, field, spelling, r) of rows, (g, field, form, spelling) of different texts) of forms with several spellings.

    The smallest row id of a text within its group stands for the spelling.
    """
    forms = one_form(long.select("text"))
    spelled = long.groupBy("g", "field", "text").agg(F.min("r").alias("spelling")).join(forms, "text")
    many = spelled.groupBy("g", "field", "form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    mixed = checkpointed(spelled.join(many, ["g", "field", "form"], "left_semi"))
    members = long.join(mixed.select("g", "field", "text", "spelling"), ["g", "field", "text"]).select("g", "field", "spelling", "r").distinct()
    return members, mixed.select("g", "field", "form", "spelling")


def _texts(rows: DataFrame, group: str, row_id: str, fields: list[str]) -> DataFrame:
    return rows.select(
        F.col(group).alias("g"), F.col(row_id).alias("r"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"),
    ).select("g", "r", "x.field", "x.text").filter("text is not null and g is not null and r is not null")


def same_look_classes(rows: DataFrame, group: str, row_id: str, fields: list[str]) -> DataFrame:
    """(field, row, class_row, rows, spellings): each row whose text has a look-alike of other characters, with its class.

    The form of ``same_look_pairs`` for groups of many rows: one row for each member instead of all pairs.
    ``class_row`` is the smallest row id of the class.
    """
    members, mixed = _spellings(_texts(rows, group, row_id, fields))
    joined = members.join(mixed, ["g", "field", "spelling"])
    classes = joined.groupBy("g", "field", "form").agg(
        F.min("r").alias("class_row"), F.count_distinct("r").alias("rows"), F.count_distinct("spelling").alias("spellings"))
    return joined.join(classes, ["g", "field", "form"]).select("field", F.col("r").alias("row"), "class_row", "rows", "spellings").distinct()


def with_forms(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The table with each field brought to its one form; other columns stay, null stays null."""
    out = rows
    for f in fields:
        forms = one_form(rows, f).select(F.col("text").alias("__text"), F.col("form").alias("__form"))
        out = out.join(forms, out[f] == F.col("__text"), "left").withColumn(f, F.col("__form")).drop("__text", "__form")
    return out
