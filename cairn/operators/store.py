"""The sentence store: prose to evidence, windows, postings, learned units, fields (SNK-01, SNK-03, AG-01, AG-06, TXT-16 .. TXT-24)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as tx

SCALES = (3, 6, 12)


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", marks: str = ".!?;") -> DataFrame:
    """(key, source, pos, sentence) of every document, in order; a missing source is ``#doc:<key>``.

    Null, empty and blank texts have no rows.
    """
    named = docs.select(F.col(key), F.coalesce(F.col(source), F.concat(F.lit("#doc:"), F.col(key).cast("string"))).alias("source"), F.col(text).alias("text"))
    ready = tx.composed(named.filter("text is not null"), "text")
    return ready.select(key, "source", F.posexplode(tx.sentences(F.col("text"), marks)).alias("pos", "sentence"))


def deduplicated(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """SNK-03: one row for each (folded sentence, source): the first by key and place."""
    first = rows.groupBy(tx.fold("sentence").alias("folded"), "source").agg(F.min(F.struct(key, "pos", "sentence")).alias("at"))
    return first.select(F.col(f"at.{key}").alias(key), "source", F.col("at.pos").alias("pos"), F.col("at.sentence").alias("sentence"))


def with_sid(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """A sentence id from the document's id and the place, so that no global order is needed."""
    return rows.withColumn("sid", F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string")))


def windows(rows: DataFrame, key: str = "doc_id", scales: tuple[int, ...] = SCALES) -> DataFrame:
    """SNK-01: (key, source, size, start, window): runs of sentences with a step of max(2, size//3).

    A text shorter than the size gives one run from its beginning; a run must be longer than its first
    sentence.  A frame holds at most the largest size of neighbours.
    """
    by = Window.partitionBy(key, "source").orderBy("pos")
    out = None
    for size in scales:
        frame = by.rowsBetween(0, size - 1)
        step = max(2, size // 3)
        made = rows.select(
            key, "source", "pos", "sentence", F.array_join(F.collect_list("sentence").over(frame), " ").alias("window"),
            F.count(F.lit(1)).over(Window.partitionBy(key, "source")).alias("n"),
        ).filter(((F.col("pos") % step == 0) & (F.col("pos") <= F.col("n") - size)) | (F.col("pos") == 0))
        part = made.filter(F.length("window") > F.length("sentence")).select(key, "source", F.lit(size).alias("size"), F.col("pos").alias("start"), "window")
        out = part if out is None else out.unionByName(part)
    return out


def postings(rows: DataFrame, sid: str = "sid") -> DataFrame:
    """AG-01: (word, sid, source), each once."""
    return rows.select(sid, "source", F.explode(F.array_distinct(tx.words(F.col("sentence")))).alias("word"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def learned_quantities(texts: DataFrame, column: str, longest: int | None = 2, times: str | None = None) -> DataFrame:
    """AG-06: tokens that stand beside a number in more than half of their occurrences; units are the short ones.

    ``times`` is the column that says how often a text stands, where each different text has one row.
    """
    often = F.col(times) if times else F.lit(1)
    each = texts.select(F.explode(tx.quantity_tokens(F.col(column))).alias("q"), often.cast("long").alias("times")).select("q.token", "q.beside", "times")
    counted = each.groupBy("token").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("beside"), F.col("times")).otherwise(0)).alias("beside"))
    kept = counted.filter(2 * F.col("beside") > F.col("n"))
    return kept.filter(F.length("token") <= longest) if longest else kept


def fields(rows: DataFrame, least_sources: int = 2) -> DataFrame:
    """Heads written by at least so many sources: (head, sources, values) (JN-08)."""
    heads = rows.select("source", F.explode(tx.record_pairs(F.col("sentence"))).alias("p")).select("source", tx.fold("p.head").alias("head"), F.col("p.value").alias("value"))
    return heads.groupBy("head").agg(F.count_distinct("source").alias("sources"), F.count_distinct("value").alias("values")).filter(F.col("sources") >= least_sources)


#: TXT-16: the element n//2 of the sorted values, as an aggregate over the counts of each value.
UPPER_MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)"
WORD, BLANK = r"\p{L}\p{N}_\"'.", r"[\s\p{Z}]"  # letters of a field name's words, white space


def _last_three() -> Column:
    w = F.col("w")
    return F.filter(F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3)), lambda x: ~tx.is_number(x))


def key_words(rows: DataFrame, sid: str = "sid", bounds: DataFrame | None = None) -> DataFrame:
    """TXT-16: (word, sid, source) of the words that a line holds as a FIELD NAME, by its form alone; not always once.

    They are the last three words before a colon, or before the first digit of a short segment whose first number
    stands in the leading half of its tokens.  Short is at most the upper median of all lines' characters and tokens,
    or ``bounds`` (chars, toks) where the rows are not all lines.
    """
    made = rows if "toks" in rows.columns else rows.select(sid, "source", "sentence", tx.tokens(F.col("sentence")).alias("toks"))
    if bounds is None:
        sizes = made.select(F.length("sentence").alias("c"), F.size("toks").alias("t"))
        bounds = sizes.selectExpr(f"{UPPER_MEDIAN.format('c')} AS chars", f"{UPPER_MEDIAN.format('t')} AS toks")
    held = F.col("words") if "words" in made.columns else tx.content(F.col("toks"))
    near = made.filter(F.col("sentence").rlike(r"[:\p{Nd}]")).select(sid, "source", "sentence", held.alias("held"))
    heads = F.regexp_extract_all("sentence", F.lit(rf"(?<![{WORD}])((?:[{WORD}]++[ \t]++){{0,2}}[{WORD}]++){BLANK}*+:"), 1)
    segments = F.filter(F.transform(F.split("sentence", "[·—;|]"), lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")), lambda x: x.rlike(r"\p{Nd}"))
    parts = near.select(sid, "source", "held", F.explode(F.concat(
        F.transform(heads, lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("segment"))),
        F.transform(segments, lambda x: F.struct(F.regexp_extract(x, rf"^([^\p{{Nd}}:]+?){BLANK}*\p{{Nd}}", 1).alias("name"), x.alias("segment"))),
    )).alias("p")).filter("p.name <> ''")
    sized = parts.select(sid, "source", "held", "p.*").join(F.broadcast(bounds), F.lit(True))

    def leading(st: Column) -> Column:
        first = F.array_position(F.transform(st, tx.is_number), F.lit(True)) - 1  # -1: no number
        return (F.size(st) <= F.col("toks")) & tx.let(first, lambda n: (n > 0) & (2 * n <= F.size(st)))

    # bound, as a filter that reads a column of a plan makes it again at each place
    shaped = (F.length("segment") <= F.col("chars")) & tx.let(tx.tokens(F.col("segment")), leading)
    named = sized.filter(F.col("segment").isNull() | shaped).select(sid, "source", "held", tx.words(F.col("name")).alias("w"))
    return named.select(sid, "source", F.explode(F.array_intersect(_last_three(), "held")).alias("word"))


def otsu_bound(lengths: DataFrame, group: str, length: str) -> DataFrame:
    """TXT-17: (group, bound): the length that best parts short from long lines of a group; needs two lengths.

    Works on the counts of the different lengths, never on the lines.
    """
    counts = lengths.groupBy(group, F.col(length).cast("long").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    by, whole = Window.partitionBy(group).orderBy("l"), Window.partitionBy(group)
    cut = counts.select(
        group, "l", F.sum("n").over(by).alias("n1"), F.sum(F.col("n") * F.col("l")).over(by).alias("s1"),
        F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("l")).over(whole).alias("s"),
    ).filter("n1 < n")
    n2 = F.col("n") - F.col("n1")
    spread = F.col("n1") * n2 * F.pow(F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / n2, F.lit(2))
    return cut.withColumn("score", F.round(spread, 6)).groupBy(group).agg(F.max(F.struct("score", (-F.col("l")).alias("m"))).alias("b")).select(group, (-F.col("b.m")).alias("bound"))


def locator_runs(rows: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """TXT-23: (key, start, lines): runs of lines that end in a bare number which never falls and rises overall."""
    number = F.regexp_extract("line", r"\s(\d{1,5})\s*$", 1)
    by = Window.partitionBy(key).orderBy("pos")
    marked = rows.withColumn("n", F.when(number != "", number.cast("int"))).withColumn("before", F.lag("n").over(by))
    breaks = marked.withColumn("cut", (F.col("n").isNull() | F.col("before").isNull() | (F.col("n") < F.col("before"))).cast("int"))
    runs = breaks.withColumn("run", F.sum("cut").over(by)).filter("n is not null").groupBy(key, "run").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("lines"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    return runs.filter((F.col("lines") >= least) & (F.col("low") < F.col("high"))).select(key, "start", "lines")


def without_locators(rows: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """TXT-23: (key, pos, line): lines of a run of locators without the number at their end, all others as they are.

    A run right below a line that names its last column (text with a gap of two blanks or a tab before its last word) keeps its numbers.
    """
    gap = F.col("line").rlike(r"(?:\s{2,}|\t)\S*\p{L}\S*\s*$")
    heads = rows.filter(gap).select(key, (F.col("pos") + 1).alias("start"), F.lit(True).alias("named"))
    runs = locator_runs(rows, key, least).join(heads, [key, "start"], "left").filter("named is null")
    places = runs.select(key, F.explode(F.sequence("start", (F.col("start") + F.col("lines") - 1).cast(rows.schema["pos"].dataType))).alias("pos")).withColumn("located", F.lit(True))
    marked = rows.join(places, [key, "pos"], "left")
    return marked.select(key, "pos", F.when(F.col("located"), F.regexp_replace("line", r"\s+\d{1,5}\s*$", "")).otherwise(F.col("line")).alias("line"))


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of the non-empty lines of each text."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("pos", "line"))


def delimited_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """TXT-22: (key, run, pos, cells): lines of two bars, or two tabs, or more, in runs of at least two; of a run the rows of its commonest width."""
    count = lambda sign: F.length("line") - F.length(F.translate("line", sign, ""))
    by = Window.partitionBy(key).orderBy("pos")
    sign = F.when(count("|") >= 2, "\\|").when(count("\t") >= 2, "\t")
    inner = F.when(count("|") >= 2, F.regexp_replace("line", r"^\s*\||\|\s*$", "")).otherwise(F.col("line"))
    table = lines.filter(sign.isNotNull()).withColumn("cells", F.transform(F.split(inner, sign), lambda c: F.trim(c)))
    table = table.withColumn("run", F.col("pos") - F.row_number().over(by)).withColumn("width", F.size("cells"))
    widths = table.groupBy(key, "run", "width").agg(F.count(F.lit(1)).alias("n"))
    modal = widths.groupBy(key, "run").agg(F.max(F.struct("n", "width")).alias("m")).filter("m.n >= 2").select(key, "run", F.col("m.width").alias("width"))
    return table.join(modal, [key, "run", "width"]).select(key, "run", "pos", "cells")


def table_records(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Row tables of texts as (key, pos, name, value): a rule as second row makes the first the header."""
    rows = delimited_rows(lines, key)
    by = Window.partitionBy(key, "run").orderBy("pos")
    ranked = rows.withColumn("at", F.row_number().over(by)).withColumn(
        "rule", F.forall("cells", lambda c: c.rlike(r"^:?-{2,}:?$"))
    )
    heads = ranked.filter("at = 1").select(key, "run", F.col("cells").alias("head"))
    ruled = ranked.filter("at = 2 and rule").select(key, "run")
    named = ranked.filter("at > 2 and not rule").join(heads.join(ruled, [key, "run"]), [key, "run"])
    return named.select(key, "pos", F.explode(F.arrays_zip(F.col("head").alias("name"), F.col("cells").alias("value"))).alias("c")).select(
        key, "pos", F.col("c.name").alias("name"), F.col("c.value").alias("value")
    ).filter("name is not null and value <> ''")


def front_matter(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """TXT-24: (key, lines, masthead): opening lines up to twelve median lengths, at least two; ends at a line that ends a sentence."""
    med = lines.groupBy(key).agg(F.expr("sort_array(collect_list(length(line)))").alias("l")).select(key, F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("median"))
    by = Window.partitionBy(key).orderBy("pos")
    run = lines.join(med, key).withColumn("upto", F.sum(F.length("line")).over(by)).withColumn(
        "ended", F.max(F.col("line").rlike(r"[.!?]$").cast("int")).over(by)
    )
    top = run.filter((F.col("upto") <= 12 * F.col("median")) & (F.col("ended") == 0))
    return top.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.expr("transform(sort_array(collect_list(struct(pos, line))), x -> x.line)"), " ").alias("masthead")).filter("lines >= 2")


def row_period(lengths: list[int]) -> int | None:
    """TXT-19: the lag at which a flattened table's cells repeat their lengths."""
    n = len(lengths)
    if n < 9:
        return None
    import numpy as np

    a = np.asarray(lengths, dtype=float)
    order = np.sort(a)
    mean = 2 * float(((2 * np.arange(n) - n + 1) * order).sum()) / (n * (n - 1))
    at = {p: float(np.abs(a[p:] - a[:-p]).mean()) for p in range(2, min(12, n // 3) + 1)}
    for p, d in at.items():
        if d < 0.75 * mean and d <= at.get(p - 1, float("inf")) and d <= at.get(p + 1, float("inf")):
            return p
    return None


def anchor_level(indents: list[int], period: int) -> int | None:
    """TXT-20: the indent whose lines stand one period apart."""
    n, best = len(indents), None
    for level in sorted(set(indents)):
        at = [i for i, x in enumerate(indents) if x == level]
        gaps = [b - a for a, b in zip(at, at[1:])]
        if 3 <= len(at) <= n / 2 and 2 * gaps.count(period) >= len(gaps) and (best is None or len(at) > best[0]):
            best = (len(at), level)
    return best[1] if best else None


class _Run:
    """The cells of one flattened table, to be cut into rows of about one period."""

    def __init__(self, lengths: list[int], period: int, anchors: list[int]):
        import numpy as np

        self.np, self.size, self.period = np, np.asarray(lengths, dtype=float), period
        self.n = len(lengths)
        self.held = np.concatenate([[0], np.cumsum(np.isin(np.arange(self.n), anchors))])
        self.anchors = anchors
        self.widths = [w for w in (period - 1, period, period + 1) if w >= 2]

    def solve(self, profile) -> tuple[float, list[tuple[int, int]]]:
        """(cost, rows) of the cheapest cut: what is left from each cell on, from the last cell to the first.

        A row costs how far its cells are from the profile's lengths, a cell too many or too few a mean length, a row
        without an anchor cell another; a row holds one anchor cell at most.  Cells above the first row and behind the last one
        cost a mean length each and hold no anchor.
        """
        np = self.np
        loose = max(1.0, float(np.mean(profile)))
        left = np.full(self.n + 1, np.inf)
        left[self.n] = 0.0
        step = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            if self.held[self.n] == self.held[i]:
                left[i] = loose * (self.n - i)
            for w in self.widths:
                j = i + w
                inside = self.held[min(j, self.n)] - self.held[i]
                if j > self.n or inside > 1:
                    continue
                want = profile[np.minimum(np.arange(w), self.period - 1)]
                cost = float(np.abs(self.size[i:j] - want).sum()) + loose * (abs(w - self.period) + (inside == 0)) + left[j]
                if cost < left[i]:
                    left[i], step[i] = cost, w
        first = self.anchors[0] if self.anchors else 0
        start = min(range(first + 1), key=lambda i: (loose * i + left[i], i))
        rows, at = [], start
        while at < self.n and step[at]:
            rows.append((at, at + step[at]))
            at += step[at]
        return loose * start + float(left[start]), rows

    def profile(self, rows: list[tuple[int, int]]):
        """The upper median length of each column over the rows that are long enough."""
        columns: list[list[float]] = [[] for _ in range(self.period)]
        for a, b in rows:
            if b - a >= self.period:
                for k in range(a, b):
                    columns[min(k - a, self.period - 1)].append(self.size[k])
        return self.np.array([sorted(c)[len(c) // 2] if c else 0.0 for c in columns])

    def best(self, rounds: int = 4) -> list[tuple[int, int]]:
        """Cuts and profile in turn, from every place where a row may begin before an anchor cell; the cheapest cut wins."""
        starts = sorted({a - k for a in self.anchors or range(self.period) for k in range(self.period) if 0 <= a - k <= self.n - self.period})
        found: tuple[float, list] = (float("inf"), [])
        for s in starts:
            profile, rows = self.size[s : s + self.period], None
            for _ in range(rounds):
                _, new = self.solve(profile)
                if not new or new == rows:
                    break
                rows, profile = new, self.profile(new)
            if rows:
                found = min(found, self.solve(profile), key=lambda x: x[0])
        return found[1]


def cut_rows(cells: list[str], period: int, anchors: list[int] | None = None) -> list[list[str]]:
    """TXT-21: rows of about one period that best keep each column's length; ``anchors`` are the places of a column's cells (TXT-20)."""
    return [cells[a:b] for a, b in _Run([len(c) for c in cells], period, sorted(anchors or [])).best()]


def rows_of_run(cells: list[str], indents: list[int]) -> list[list[str]] | None:
    """TXT-18 .. TXT-21: the rows of a run of short lines, or None where its layout does not say where a row begins."""
    period = row_period([len(c) for c in cells])
    if not period:
        return None
    level = anchor_level(indents, period)
    if level is None:
        return None
    return cut_rows(cells, period, [i for i, x in enumerate(indents) if x == level])


def indented_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, indent, line) of the non-empty lines of each text, a tab being one step."""
    each = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "raw")).filter(F.col("raw").rlike(r"\S"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    return each.select(key, "pos", (F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))).alias("indent"), line.alias("line"))


def table_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, lead: int = 6) -> DataFrame:
    """TXT-18: (key, kind, at, text) of the tables of each text, row by row.

    'delimited' rows are read as ``name: cell``, where a rule says so, else as their cells.  Other runs of at least ``least`` short lines
    (TXT-17) are put back into 'row's; where their layout does not say how, every second cell gives a 'window' of its neighbours behind
    the run's first ``lead`` cells.  A group is one run of one text.
    """
    lines = indented_lines(docs, key, text)
    marked = delimited_rows(lines.select(key, "pos", "line"), key)
    named = table_records(lines.select(key, "pos", "line"), key).groupBy(key, "pos").agg(F.array_join(F.collect_list(F.concat_ws(": ", "name", "value")), " · ").alias("text"))
    bare = marked.filter(~F.forall("cells", lambda c: c.rlike(r"^:?-{2,}:?$"))).select(key, "pos", F.array_join("cells", " · ").alias("cells"))
    told = bare.join(named, [key, "pos"], "left").select(key, F.lit("delimited").alias("kind"), F.col("pos").alias("at"), F.coalesce("text", "cells").alias("text"))
    rest = lines.join(marked.select(key, "pos"), [key, "pos"], "left_anti")
    short = rest.join(otsu_bound(rest.withColumn("l", F.length("line")), key, "l"), key).filter(F.length("line") <= F.col("bound"))
    by = Window.partitionBy(key).orderBy("pos")
    order = lines.select(key, "pos", F.row_number().over(by).alias("nth"))
    runs = short.join(order, [key, "pos"]).withColumn("run", F.col("nth") - F.row_number().over(by))
    long = runs.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(key, "run")

    def rebuild(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        cells, places = part["line"].tolist(), part["pos"].tolist()
        rows = rows_of_run(cells, part["indent"].tolist())
        if rows is None:
            kind, head = "window", cells[:lead]
            rows = [list(dict.fromkeys([*head, *cells[max(0, i - 1) : i + 6]])) for i in range(0, len(cells), 2)]
        else:
            kind = "row"
        return pd.DataFrame({key: part[key].iloc[0], "kind": kind, "at": places[0] + pd.RangeIndex(len(rows)), "text": [" · ".join(r) for r in rows]})

    of = docs.schema[key].dataType.simpleString()
    shattered = runs.join(long, [key, "run"]).select(key, "run", "pos", "indent", "line").groupBy(key, "run").applyInPandas(rebuild, f"{key} {of}, kind string, at int, text string")
    return told.unionByName(shattered)
