"""Schemas that drift between the files of a series.

Lines are loaded as path-value maps with their raw types, path-type statistics are aggregated by file,
neighbouring files of a series are compared by one full outer join, renamed fields are followed back to their first name,
and the lines are projected to typed columns with a report of the casts that failed.  Bodies are no shuffle key: lines whose
place in a file is their own pass as they are, and only the few of a shared place are compared.  The distinct fields of the wide
table, its schema, are the only thing that the driver holds.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.strict_json import parse
from cairn.session import checkpointed

SEP = "\x1f"  # between the names of an inner path, as names may hold points
TYPES = {str: "text", bool: "boolean", int: "whole", float: "decimal", list: "list", dict: "object"}
SQL_TYPES = {"text": "STRING", "boolean": "BOOLEAN", "whole": "BIGINT", "decimal": "DOUBLE", "list": "STRING", "object": "STRING"}
PLACE = ["series", "file_path", "line_no"]
COUNTED = "file_path string, path string, type string, lines long"
PARSED = "series string, file_path string, written_at timestamp, line_no long, alone boolean, valid boolean, paths array<string>, types array<string>, texts array<string>"
#: (file, path, type) counts that a task holds before it gives them out.
HELD = 200_000


def fields_of(body: str | None, texts: bool = True) -> list[tuple[str, str, str | None]] | None:
    """(path, type, text) of each field other than null; None for no valid line.

    Lists are values, not walked.  A number is decimal where it is written with a point.  The text of an object is
    left out, as its fields hold it.
    """
    if body is None:
        return None
    try:
        top = parse(body)
    except ValueError:
        return None
    if not isinstance(top, dict):
        return None
    out: list[tuple[str, str, str | None]] = []
    stack = [("", top)]
    while stack:
        above, node = stack.pop()
        for name, value in node.items():
            if value is None:
                continue
            path = above + name
            kind = TYPES[type(value)]
            if kind == "object":
                out.append((path, kind, None))
                stack.append((path + SEP, value))
            else:
                out.append((path, kind, (value if kind == "text" else json.dumps(value, ensure_ascii=False)) if texts else None))
    return out


def once(lines: DataFrame) -> DataFrame:
    """Each line of a place once for each different body, with ``alone``: no other line has its series, file and number.

    A count of places without bodies tells the shared ones; only their lines are compared, by place and body.
    """
    at = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in PLACE]
    shared = lines.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*(F.col(c).alias(f"__{c}") for c in PLACE))
    on = at[0] & at[1] & at[2]
    single = lines.join(shared, on, "left_anti").withColumn("alone", F.lit(True))
    several = lines.join(shared, on, "left_semi").dropDuplicates([*PLACE, "body"]).withColumn("alone", F.lit(False))
    return single.unionByName(several)


def counted(lines: DataFrame) -> DataFrame:
    """(file_path, path, type, lines): how many lines of a file hold a path with a type; each line number counts once.

    Lines alone in their place are counted where they are read, before the shuffle; those of a shared place go by their number.
    """
    names = [c.split(" ")[0] for c in COUNTED.split(", ")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        give = lambda: pd.DataFrame([(*k, v) for k, v in n.items()], columns=names)
        for batch in batches:
            for file, body in zip(batch["file_path"], batch["body"]):
                n.update((file, path, kind) for path, kind, _ in fields_of(body, False) or ())
            if len(n) > HELD:
                yield give()
                n.clear()
        yield give()

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, no, path, kind) for file, no, body in batch.itertuples(index=False) for path, kind, _ in fields_of(body, False) or ()]
            yield pd.DataFrame(rows, columns=["file_path", "line_no", "path", "type"])

    each = once(lines.filter("file_path is not null").select("series", "file_path", F.col("line_no").cast("long").alias("line_no"), "body"))
    single = each.filter("alone").select("file_path", "body").mapInPandas(count, COUNTED)
    several = each.filter("not alone").select("file_path", "line_no", "body").mapInPandas(listed, "file_path string, line_no long, path string, type string")
    return single.unionByName(several.distinct().groupBy("file_path", "path", "type").agg(F.count(F.lit(1)).alias("lines"))).groupBy(
        "file_path", "path", "type").agg(F.sum("lines").alias("lines"))


def path_types(counts: DataFrame) -> DataFrame:
    """(file_path, path, parent, type, lines): the type that most lines of a file hold; of equals the first by name."""
    best = counts.groupBy("file_path", "path").agg(F.min(F.struct((-F.col("lines")).alias("n"), F.col("type").alias("type"))).alias("best"))
    inner = F.size(F.split("path", SEP)) > 1
    parent = F.when(inner, F.regexp_replace("path", f"{SEP}[^{SEP}]*$", "")).otherwise("")
    return best.select("file_path", "path", parent.alias("parent"), F.col("best.type").alias("type"), (-F.col("best.n")).alias("lines"))


def file_order(lines: DataFrame) -> DataFrame:
    """(series, file_path, place, previous_file): files of a series by written_at, then path.

    Rows without a series or a path belong to no file order.
    """
    files = (
        lines.filter(F.col("series").isNotNull() & F.col("file_path").isNotNull())
        .groupBy("series", "file_path").agg(F.min("written_at").alias("written_at"))
    )
    by = Window.partitionBy("series").orderBy("written_at", "file_path")
    return files.withColumn("previous_file", F.lag("file_path").over(by)).withColumn("place", F.row_number().over(by))


def _changes(order: DataFrame, types: DataFrame) -> DataFrame:
    """(file_path, change, old_path, new_path) with inner paths, of typed paths by file; ``types`` is read twice."""
    pairs = order.filter(F.col("previous_file").isNotNull()).select("file_path", "previous_file")
    now = types.join(pairs.select("file_path"), "file_path").select(
        "file_path", "path", "parent", F.col("type").alias("new_type")
    )
    before = types.withColumnRenamed("file_path", "previous_file").join(pairs, "previous_file").select(
        "file_path", "path", "parent", F.col("type").alias("old_type")
    )
    both = now.join(before, ["file_path", "path", "parent"], "full_outer").filter(
        ~F.col("new_type").eqNullSafe(F.col("old_type"))
    )
    # one group by file and parent says whether exactly one field leaves and exactly one comes
    leaves, comes = F.col("new_type").isNull(), F.col("old_type").isNull()
    there = lambda c, x: F.when(c, x)
    moves = both.filter(leaves | comes).groupBy("file_path", "parent").agg(
        F.sum(leaves.cast("int")).alias("n_left"), F.sum(comes.cast("int")).alias("n_come"),
        F.max(there(leaves, F.col("path"))).alias("left_path"), F.max(there(comes, F.col("path"))).alias("come_path"),
        F.max("old_type").alias("left_type"), F.max("new_type").alias("come_type"),
    )
    same = (F.col("n_left") == 1) & (F.col("n_come") == 1) & (F.col("left_type") == F.col("come_type"))
    renamed = moves.filter(same).select("file_path", "parent", "left_path", "come_path")
    marked = both.join(renamed, ["file_path", "parent"], "left")
    is_renamed = F.col("left_path").isNotNull() & (leaves | comes)
    change = F.when(is_renamed, "renamed").when(leaves, "removed").when(comes, "added").otherwise("retyped")
    old = F.when(is_renamed, F.col("left_path")).when(comes, "").otherwise(F.col("path"))
    new = F.when(is_renamed, F.col("come_path")).when(leaves, "").otherwise(F.col("path"))
    # a rename comes once, with the field that comes
    found = checkpointed(marked.filter(~(is_renamed & leaves)).select("file_path", change.alias("change"), old.alias("old_path"), new.alias("new_path"), "parent"))
    reported = found.select("file_path", F.explode(F.array_distinct(F.array("old_path", "new_path"))).alias("above")).filter(
        F.col("above") != ""
    ).distinct()
    hidden = (
        found.filter(F.col("parent") != "").select("file_path", "parent").distinct()
        .withColumn("names", F.split("parent", SEP))
        .withColumn("above", F.explode(F.expr(f"transform(sequence(1, size(names)), n -> array_join(slice(names, 1, n), '{SEP}'))")))
        .join(reported, ["file_path", "above"], "left_semi").select("file_path", "parent").distinct()
    )
    return found.join(hidden, ["file_path", "parent"], "left_anti").select("file_path", "change", "old_path", "new_path")


def changes(lines: DataFrame) -> DataFrame:
    """(file_path, change, old_path, new_path) of each file against the one before it.

    'renamed' where under one parent exactly one field leaves and one of the same
    type comes, else 'removed' and 'added'; 'retyped' where the type differs.  Nothing
    is reported below a field that is reported itself.  An empty table gives none.
    """
    # read twice, as the file's own and as its successor's: parse the bodies once
    types = checkpointed(path_types(counted(lines)))
    dotted = lambda c: F.translate(c, SEP, ".").alias(c)
    return _changes(file_order(lines), types).select("file_path", "change", dotted("old_path"), dotted("new_path"))


def parsed(lines: DataFrame) -> DataFrame:
    """Each line once with its paths, raw types and texts side by side (``PARSED``), written once to the shared folder."""
    names = PARSED.split(", ")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fields_of(b) for b in batch.column("body").to_pylist()]
            lists = [pa.array([None if r is None else [f[i] for f in r] for r in rows], pa.list_(pa.string())) for i in range(3)]
            keys = [batch.column(c) for c in ("series", "file_path", "written_at", "line_no", "alone")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([r is not None for r in rows]), *lists], names=[c.split(" ")[0] for c in names])

    each = once(lines.select("series", "file_path", F.col("written_at").cast("timestamp").alias("written_at"), F.col("line_no").cast("long").alias("line_no"), "body"))
    return checkpointed(each.select("series", "file_path", "written_at", "line_no", "alone", "body").mapInArrow(load, PARSED))


def counted_of(rows: DataFrame) -> DataFrame:
    """``counted`` of parsed rows."""
    each = rows.filter("file_path is not null and valid").select("file_path", "line_no", "alone", F.explode(F.arrays_zip("paths", "types")).alias("f")).select(
        "file_path", "line_no", "alone", F.col("f.paths").alias("path"), F.col("f.types").alias("type"))
    single = each.filter("alone").select("file_path", "path", "type")
    several = each.filter("not alone").distinct().select("file_path", "path", "type")
    return single.unionByName(several).groupBy("file_path", "path", "type").agg(F.count(F.lit(1)).alias("lines"))


def first_names(order: DataFrame, types: DataFrame) -> DataFrame:
    """(series, path, field): the first name of each path of a series, by the report's renames; only where it differs.

    Of several renames that give one name the earliest counts, and a chain is followed back in time only.  Parents are
    followed as well, so fields of a renamed object keep one name.  Names that ever stand side by side in a file are
    different fields and stay apart.  One task holds the distinct paths of one series, which are part of the schema.
    """
    placed = order.select("series", "file_path", "place")
    renamed = _changes(order, types).filter("change = 'renamed'").join(placed, "file_path")
    back = renamed.groupBy("series", F.col("new_path").alias("path")).agg(F.min(F.struct("place", "old_path")).alias("b"))
    held = types.join(placed.select("series", "file_path"), "file_path").select("series", "path").distinct()
    known = held.join(back, ["series", "path"], "left").select("series", "path", F.col("b.place").alias("place"), F.col("b.old_path").alias("old_path"))
    touched = known.join(back.select("series").distinct(), "series", "left_semi")

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        came = {p: (int(n), o) for p, n, o in part[["path", "place", "old_path"]].itertuples(index=False) if o is not None and o == o}

        def first(path: str) -> str:
            at = float("inf")
            while path in came and came[path][0] < at:
                at, path = came[path]
            return path

        def follow(path: str) -> str:
            names = path.split(SEP)
            for n in range(len(names), 0, -1):  # the field itself, then its parents
                names[:n] = first(SEP.join(names[:n])).split(SEP)
            return first(SEP.join(names))

        return pd.DataFrame({"series": part["series"], "path": part["path"], "field": part["path"].map(follow)})

    mapped = touched.groupBy("series").applyInPandas(resolve, "series string, path string, field string")
    folded = checkpointed(mapped)
    beside = types.join(placed.select("series", "file_path"), "file_path").select("series", "file_path", "path").join(folded, ["series", "path"]).groupBy(
        "series", "file_path", "field").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("series", "field").distinct()
    return folded.join(beside, ["series", "field"], "left_anti").filter("path <> field").select("series", "path", "field")


def unified_types(counts: DataFrame) -> DataFrame:
    """(field, type): one type for each field over all files, by the most lines.

    Whole numbers widen to decimal where any line writes the field with a point.
    """
    summed = counts.groupBy("field", "type").agg(F.sum("lines").alias("n"))
    best = summed.groupBy("field").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("best"),
        F.max((F.col("type") == "decimal").cast("int")).alias("has_point"),
    )
    kind = F.when((F.col("best.type") == "whole") & (F.col("has_point") == 1), "decimal").otherwise(F.col("best.type"))
    return best.select("field", kind.alias("type"))


def _loaded(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``fields`` beside paths, types and texts; (field, type) of the whole table)."""
    rows = parsed(lines)
    counts = checkpointed(counted_of(rows))
    order = checkpointed(file_order(rows))
    names = checkpointed(first_names(order, path_types(counts)))
    by_file = order.select("series", "file_path").join(names, "series").select("file_path", "path", "field")
    kinds = unified_types(counts.join(by_file, ["file_path", "path"], "left").select(F.coalesce("field", "path").alias("field"), "type", "lines"))
    # one row a series, with its renamed paths alone
    maps = names.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("path", "field"))).alias("names"))
    named = rows.join(maps, "series", "left").withColumn(
        "fields", F.when(F.col("names").isNull(), F.col("paths")).otherwise(F.transform("paths", lambda p: F.coalesce(F.element_at("names", p), p)))
    ).drop("names")
    return named, kinds


def consistent_table(lines: DataFrame, most_columns: int = 2_000) -> DataFrame:
    """All lines in one table: the keys, one typed column for each field, and the failed casts.

    Fields that the report finds renamed stand in one column under their first name.  Columns are named by the path joined by points; of names that
    differ in case alone the later ones end in ``~2``, ``~3``.  ``failed`` maps a field to the raw text that does not fit the column's type,
    values of fields that are objects elsewhere included.  Objects have no column of their own where their fields have, lists and mixed values stay
    JSON text.  Repeated lines (same file, line and body) appear once; lines that are no valid JSON have ``valid`` false and null
    fields.  The distinct fields are the table's schema and the only thing collected; more than ``most_columns`` raise ValueError.
    """
    rows, kinds = _loaded(lines)
    known = kinds.orderBy("field").limit(most_columns + 1).collect()
    if len(known) > most_columns:
        raise ValueError(f"more than {most_columns} distinct fields")
    wanted = [r for r in known if r["type"] != "object"]
    taken = {"series", "file_path", "written_at", "line_no", "valid", "failed"}
    names: dict[str, str] = {}
    for r in wanted:  # names that differ in case alone, or are a key's, get a number
        name, n = r["field"].replace(SEP, "."), 1
        while (unique := name if n == 1 else f"{name}~{n}").lower() in taken:
            n += 1
        taken.add(unique.lower())
        names[r["field"]] = unique
    types = {r["field"]: r["type"] for r in wanted}
    given = F.filter(F.arrays_zip(F.col("fields").alias("f"), F.col("texts").alias("t")), lambda x: x["t"].isNotNull())
    keyed = rows.withColumn("held", F.map_from_entries(F.transform(given, lambda x: F.struct(x["f"], x["t"]))))
    columns = [F.col("held")[f].try_cast(SQL_TYPES[types[f]]).alias(n) for f, n in names.items()]
    # a field fails where its text is no value of its type; any text of a field that is an object does
    misfit = [F.col("held")[f].isNotNull() & F.col("held")[f].try_cast(SQL_TYPES[types[f]]).isNull() for f in names if SQL_TYPES[types[f]] != "STRING"]
    misfit += [F.col("held")[r["field"]].isNotNull() for r in known if r["type"] == "object"]
    at = [f for f in names if SQL_TYPES[types[f]] != "STRING"] + [r["field"] for r in known if r["type"] == "object"]
    each = [F.when(bad, F.struct(F.lit(f.replace(SEP, ".")).alias("key"), F.col("held")[f].alias("value"))) for f, bad in zip(at, misfit)]
    failed = F.map_from_entries(F.array_compact(F.array(*each))) if each else F.create_map().cast("map<string,string>")
    return keyed.select("series", "file_path", "written_at", "line_no", "valid", *columns, F.coalesce(failed, F.create_map().cast("map<string,string>")).alias("failed"))


def failed_casts(lines: DataFrame) -> DataFrame:
    """(file_path, path, column_type, raw_type, lines): values that do not fit their field's unified type.

    The long form of ``consistent_table``'s report; it collects nothing.
    """
    rows, kinds = _loaded(lines)
    each = rows.filter("valid").select("file_path", F.explode(F.arrays_zip("fields", "types", "texts")).alias("f")).select(
        "file_path", F.col("f.fields").alias("field"), F.col("f.types").alias("type"), F.col("f.texts").alias("value"))
    # objects do not fail: their fields stand in columns of their own
    named = each.filter("type <> 'object'").join(kinds.withColumnRenamed("type", "wanted"), "field")
    fits = (
        F.when(F.col("wanted") == "whole", F.expr("try_cast(value AS BIGINT)").isNotNull())
        .when(F.col("wanted") == "decimal", F.expr("try_cast(value AS DOUBLE)").isNotNull())
        .when(F.col("wanted") == "boolean", F.expr("try_cast(value AS BOOLEAN)").isNotNull())
        .otherwise(F.col("wanted") != "object")
    )
    return named.filter(~fits).groupBy(
        "file_path", F.translate("field", SEP, ".").alias("path"), F.col("wanted").alias("column_type"), F.col("type").alias("raw_type")
    ).agg(F.count(F.lit(1)).alias("lines"))
