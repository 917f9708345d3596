"""Sources: text, CSV, XLSX and DOCX files, the saved memory, and the dispatcher over them (SRC-01 .. SRC-19).

Office files are zip archives of XML and are read with the standard library, each where it lies
(``binaryFile`` and mapInPandas); PDF needs a reader that is not part of this environment and is gated.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators.records import cell_text

TEXT = {".txt", ".text", ".md", ".markdown", ".rst", ".log", ""}
KNOWN = TEXT | {".csv", ".xlsx", ".docx", ".pdf", ".json", ".parquet"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def looks_like_path(what: str) -> bool:
    """SRC-02: an existing file is a path; a directory and a missing file of a known kind are errors."""
    if "\n" in what or "\0" in what or len(what) > 4096:
        return False
    if os.path.isdir(what):
        raise ValueError(f"{what} is a directory")
    if os.path.exists(what):
        return True
    if os.path.splitext(what)[1].lower() in KNOWN - {""}:
        raise ValueError(f"{what} does not exist")
    return False


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: (source, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.concat(F.lit("#text:"), F.col("_metadata.file_name")).alias("source"), F.col("value").alias("text"))


def sniffed(sample: str) -> str:
    """SRC-04: the delimiter of a sample; a comma where none is plain."""
    try:
        return csv.Sniffer().sniff(sample[:8192], ",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """SRC-04: (source, row map<string,string>) with blank cells left out; all values stay text."""
    if sep is None:
        head = spark.read.text(path).limit(20).collect()
        sep = sniffed("\n".join(r[0] for r in head))
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, encoding="UTF-8")
    cells = F.array(*(F.struct(F.lit(c.lstrip("﻿")).alias("key"), F.trim(F.col(f"`{c}`")).alias("value")) for c in df.columns))
    return df.select(F.concat(F.lit("#csv:"), F.col("_metadata.file_name")).alias("source"), F.map_from_entries(F.filter(cells, lambda x: x["value"].isNotNull() & (x["value"] != ""))).alias("row"))


def _column(ref: str) -> int:
    at = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        at = 26 * at + ord(ch) - 64
    return at - 1


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() else repr(value)


def sheet_grids(data: bytes) -> list[tuple[str, list[list[str]], list[str]]]:
    """SRC-05: (sheet, grid of cell texts, merged ranges) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for name, file in zip(names, files):
            root = ElementTree.fromstring(z.read(file))
            grid: list[list[str]] = []
            for row in root.iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value, kind = c.find(f"{_S}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif value is None or value.text is None:
                        text = ""
                    elif kind == "s":
                        text = shared[int(value.text)]
                    else:
                        text = _number(value.text) if kind in (None, "n") else value.text
                    cells[at] = text.replace("\n", " ").strip()
                want = int(row.get("r") or len(grid) + 1) - 1
                grid += [[] for _ in range(want - len(grid))]
                grid.append(cells)
            out.append((name, grid, [m.get("ref") for m in root.iter(f"{_S}mergeCell")]))
        return out


def _is_number(text: str) -> bool:
    return re.fullmatch(r"-?\d+(?:[.,]\d+)?%?", text) is not None


def header_row(grid: list[list[str]]) -> int:
    """SRC-06: of the rows before the first mostly numeric one, the row with most short texts."""
    numeric = next((i for i, r in enumerate(grid) if (f := [c for c in r if c]) and 2 * sum(map(_is_number, f)) > len(f)), len(grid))
    lengths = sorted({len(c) for r in grid for c in r if c})
    bound = lengths[-1] if lengths else 0
    best = 0
    if len(lengths) > 1:
        all_lengths = sorted(len(c) for r in grid for c in r if c)
        n, total, run, at = len(all_lengths), sum(all_lengths), 0, {}
        for i, x in enumerate(all_lengths[:-1], 1):
            run += x
            if all_lengths[i] != x:
                at[x] = i * (n - i) * (run / i - (total - run) / (n - i)) ** 2
        bound = max(at, key=at.get)
    score = (-1, -1)
    for i, r in enumerate(grid[: max(1, numeric)]):
        texts = [c for c in r if c and not _is_number(c)]
        this = (sum(len(c) <= bound for c in texts), len(texts))
        if this > score:
            best, score = i, this
    return best


def sheet_rows(grid: list[list[str]], merges: list[str]) -> tuple[list[str], list[dict[str, str]]]:
    """SRC-06, SRC-07: (preamble lines, row dicts); merged cells from the header row down give a header of several rows."""
    if not grid:
        return [], []
    top = header_row(grid)
    spans = [tuple(re.findall(r"([A-Z]+)(\d+)", m)) for m in merges]
    deep = max((int(s[1][1]) for s in spans if len(s) == 2 and int(s[0][1]) - 1 == top), default=top + 1)
    wide = [s for s in spans if len(s) == 2 and int(s[0][1]) - 1 == top and _column(s[1][0]) > _column(s[0][0])]
    deep = max(deep, top + 2) if wide else deep
    rows = [list(r) for r in grid[top:deep]]
    for s in spans:
        if len(s) == 2 and top <= int(s[0][1]) - 1 < deep:
            a, b, i = _column(s[0][0]), _column(s[1][0]), int(s[0][1]) - 1 - top
            rows[i] += [""] * (b + 1 - len(rows[i]))
            rows[i][a : b + 1] = [rows[i][a]] * (b + 1 - a)
    width = max(map(len, grid))
    heads = [" ".join(dict.fromkeys(r[i] for r in rows if i < len(r) and r[i])) for i in range(width)]
    data = [{heads[i]: c for i, c in enumerate(r) if c and heads[i]} for r in grid[deep:]]
    return [": ".join(c for c in r if c) for r in grid[:top] if any(r)], [d for d in data if d]


def docx_parts(data: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """SRC-11: (paragraphs, tables) of a document; repeated merged cells count once."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    paragraphs = [p if p[-1] in ".!?:;" else f"{p}." for p in (text(e) for e in body.findall(f"{_W}p")) if p]
    tables = [[[text(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return paragraphs, tables


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05, SRC-11: (source, part, pos, text, row) of workbooks and documents; a file that cannot be read gives its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file, data in batch.itertuples(index=False):
                name, kind = os.path.basename(file), os.path.splitext(file)[1].lower().lstrip(".")
                source = f"#{kind}:{name}"
                try:
                    if kind == "xlsx":
                        for sheet, grid, merges in sheet_grids(bytes(data)):
                            lead, table = sheet_rows(grid, merges)
                            rows += [(source, sheet, i, t, None) for i, t in enumerate(lead)]
                            rows += [(source, sheet, len(lead) + i, None, r) for i, r in enumerate(table)]
                    elif kind == "docx":
                        prose, tables = docx_parts(bytes(data))
                        rows += [(source, "prose", i, t, None) for i, t in enumerate(prose)]
                        for n, t in enumerate(tables):
                            head = t[0] if t else []
                            rows += [(source, f"table {n}", i, None, {h: c for h, c in zip(head, r) if h and c}) for i, r in enumerate(t[1:])]
                    else:
                        rows.append((source, "error", 0, "PDF needs a reader that is not installed" if kind == "pdf" else f"unknown kind {kind}", None))
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((source, "error", 0, f"{type(e).__name__}: {str(e)[:200]}", None))
            yield pd.DataFrame(rows, columns=["source", "part", "pos", "text", "row"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "source string, part string, pos int, text string, row map<string,string>")


# Fixed value, the written form of a key: up to three words without a digit or a separator before a colon.
KEY = r"(?<![^\s:,;·|])((?:[^\s:,;·|\d]+[ \t]+){0,2}[^\s:,;·|\d]+)\s*:\s*"
_EDGE = r"^[ ,;·|]+|[ ,;·|]+$"


def key_values(text: Column) -> Column:
    """SRC-13: array of (key, value) of a cell 'A: 1 B: 2': each key with what stands before the next; pairs without a value fall away."""
    bare = lambda x: F.regexp_replace(x, _EDGE, "")
    values = F.split(text, KEY)  # what stands before the first key is no value
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(KEY), 1), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))),
                       lambda k, v: F.struct(bare(k).alias("key"), bare(F.coalesce(v, F.lit(""))).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def leading_value(text: Column) -> Column:
    """SRC-14: struct (key, value) of 'name 410 mm', parted before its first word with a digit where the words before are no more than the rest; else null."""
    def parted(w: Column) -> Column:
        before = F.array_position(F.transform(w, lambda x: x.rlike(r"\p{Nd}")), F.lit(True)).cast("int") - 1
        fits = (before >= 1) & (2 * before <= F.size(w))
        return F.when(fits, F.struct(F.array_join(F.slice(w, 1, F.greatest(before, F.lit(1))), " ").alias("key"), F.array_join(F.slice(w, before + 1, F.size(w)), " ").alias("value")))

    return tx.let(F.filter(F.split(text, r"\s+"), lambda x: x != ""), parted)


def without_sparse_first(rows: DataFrame, table: str) -> DataFrame:
    """SRC-15: (table, pos, cells) without the first column while rows have more than two and fewer than half of a table's rows fill it.

    Each column's share of filled rows is one aggregate, so the columns that go are known before any is cut.
    """
    each = rows.select(table, F.size("cells").alias("width"), F.posexplode("cells").alias("at", "cell"))
    filled = each.groupBy(table, "at").agg(F.sum((F.col("cell") != "").cast("int")).alias("filled"))
    sizes = rows.groupBy(table).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("width"))
    stays = filled.join(sizes, table).filter((2 * F.col("filled") >= F.col("n")) | (F.col("width") - F.col("at") <= 2))
    first = stays.groupBy(table).agg(F.min("at").alias("first"))
    return rows.join(first, table).select(table, "pos", F.slice("cells", F.col("first") + 1, F.greatest(F.size("cells") - F.col("first"), F.lit(0))).alias("cells"))


def table_claims(rows: DataFrame, table: str = "source") -> DataFrame:
    """SRC-11 .. SRC-15: (table, pos, key, value) of cells: two-column rows are key and value, single cells are read by their colons or their figure.

    ``rows``: (table, pos, cells); sparse label columns are dropped first.
    """
    made = without_sparse_first(rows, table).withColumn("cells", F.transform("cells", cell_text))
    held = made.withColumn("cells", F.filter("cells", lambda c: c != ""))
    two = held.filter(F.size("cells") == 2).select(table, "pos", F.get("cells", 0).alias("key"), F.get("cells", 1).alias("value"))
    single = held.filter(F.size("cells") == 1).select(table, "pos", F.get("cells", 0).alias("cell"))
    kv = single.select(table, "pos", "cell", key_values(F.col("cell")).alias("kv"))
    by_colon = kv.filter(F.size("kv") > 0).select(table, "pos", F.explode("kv").alias("p"))
    by_figure = kv.filter(F.size("kv") == 0).select(table, "pos", leading_value(F.col("cell")).alias("p")).filter("p is not null")
    return two.unionByName(by_colon.unionByName(by_figure).select(table, "pos", "p.key", "p.value"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: (sid, source, speaker, sentence) of saved evidence, a JSON list of [sentence, source, speaker]; a damaged file is empty."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("at", "r")).filter("r[0] is not null")
    return rows.select(F.concat(F.lit("saved:"), F.col("at").cast("string")).alias("sid"), F.coalesce(F.get("r", 1), F.lit("")).alias("source"),
                       F.coalesce(F.get("r", 2), F.lit("")).alias("speaker"), F.get("r", 0).alias("sentence"))


def read_aids(spark: SparkSession, path: str) -> dict:
    """SRC-19: the saved aids beside the evidence, a small JSON object; a missing or damaged file gives none."""
    known = ("derived", "bridge", "kinds", "bounds", "at", "keys")
    try:
        held = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception:
        return {}
    return {k: held[k] for k in known if k in held} if isinstance(held, dict) else {}


def summaries(titles: DataFrame, fetch: Callable[[str, str], tuple[str, str]], languages: tuple[str, ...] = ("tr", "en", "de", "fr", "es")) -> DataFrame:
    """SRC-20: (title, text, url) by a caller's ``fetch(title, language)``: the first language with a text; a failure is an empty text."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for title in batch["title"]:
                found = ("", "")
                for language in languages:
                    try:
                        found = fetch(title, language)
                    except Exception:
                        found = ("", "")
                    if found[0]:
                        break
                rows.append((title, *found))
            yield pd.DataFrame(rows, columns=["title", "text", "url"])

    return titles.select("title").filter("title is not null").distinct().mapInPandas(ask, "title string, text string, url string")


# Fixed value: the first bytes of a saved memory's framed form.
MAGIC = b"LMM1"


def read_saved_memory(data: bytes) -> dict:
    """SRC-18: a saved memory: the framed binary form or plain JSON; another version, length or checksum is refused."""
    if data[:4] != MAGIC:
        return json.loads(data) if data.strip() else {"identities": [], "records": [], "experiences": []}
    version, size, checksum = struct.unpack(">BII", data[4:13])
    if version > 4:
        raise ValueError(f"format {version} is newer than 4")
    raw = zlib.decompress(data[13:])
    if len(raw) != size or zlib.crc32(raw) != checksum:
        raise ValueError("the file is damaged")
    return json.loads(raw)


def with_preambles(parts: DataFrame) -> DataFrame:
    """SRC-12: the parts of office files, and for each line 'key: value' above a table a row of the table's name, key and value."""
    lead = parts.filter(F.col("text").isNotNull() & ~F.col("part").isin("prose", "error")).withColumn("kv", key_values(F.col("text"))).filter(F.size("kv") > 0)
    keys = F.array_distinct(F.transform("kv", lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.get(F.filter("kv", lambda p: p["key"] == k), 0)["value"])
    named = F.map_from_arrays(F.concat(F.array(F.lit("")), keys), F.concat(F.array(F.col("part")), values))
    return parts.unionByName(lead.select("source", "part", "pos", F.lit(None).cast("string").alias("text"), named.alias("row")))


def warnings(parts: DataFrame) -> DataFrame:
    """SRC-01, SRC-16, SRC-17: (source, warning) of read parts: files that could not be read, and texts that are mostly markup."""
    failed = parts.filter("part = 'error'").select("source", F.col("text").alias("warning")) if "part" in parts.columns else None
    marked = parts.filter(F.col("text").isNotNull()).filter(tx.markup_share(F.col("text")) > 0.5).select("source", F.lit("most of the text is markup").alias("warning"))
    return marked.distinct() if failed is None else failed.unionByName(marked).distinct()


def learned(spark: SparkSession, what: str, source: str | None = None) -> DataFrame:
    """SRC-01: (source, pos, text, row) of a file or a text, by the file's extension; an unknown extension is read as text."""
    shape = ["source", "pos", "text", "row"]
    none = F.lit(None).cast("map<string,string>")
    if not looks_like_path(what):
        return spark.createDataFrame([(source or "#document", 0, what)], "source string, pos int, text string").withColumn("row", none)
    kind = os.path.splitext(what)[1].lower()
    if kind == ".csv":
        out = read_csv(spark, what).withColumn("pos", F.lit(0)).withColumn("text", F.lit(None).cast("string"))
    elif kind in (".xlsx", ".docx", ".pdf"):
        out = with_preambles(read_office(spark, what))
    else:
        out = read_text(spark, what).withColumn("pos", F.lit(0)).withColumn("row", none)
    out = out.select(*shape)
    return out.withColumn("source", F.lit(source)) if source else out
