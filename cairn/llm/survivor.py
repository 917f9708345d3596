"""Best representative of each duplicate group, bundle by bundle.

Fields that depend on each other form a bundle, and a bundle's values always come
from one record.  Which record is a search: every bundle takes a candidate of
its group, functional dependencies that span bundles must hold in the result, and the
choice with the best ranks wins (branch and bound).  Before the search an exact
dominance step keeps, for each bundle and each combination of values that a dependency
looks at, only the best-ranked candidate; it is a partial aggregation, so a group of
any size is never in one task.  Every row of a result is chosen by the search; a bundle that no dependency touches
comes to it with one candidate.
"""

from __future__ import annotations

import heapq
import itertools
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Bundle:
    """Fields that are taken together, and the condition under which a record may give them."""

    name: str
    fields: tuple[str, ...]
    usable: Column


def usable_or_null(value: Column, usable: Column) -> Column:
    return F.when(F.coalesce(usable, F.lit(False)), value)


def _ranked(order: list[Column], row_id: str, gain: Column) -> Column:
    named = [(f"o{i}", o) for i, o in enumerate(order)] + [("id", F.col(row_id)), ("gain", gain)]
    return F.named_struct(*(x for name, value in named for x in (F.lit(name), value)))


def _best_of_each(known: DataFrame, group: list[str], row_id: str, rank: Column, bundles: list[Bundle]) -> DataFrame:
    """No dependency: one aggregation with one shuffle leaves one candidate of every bundle."""
    best = known.groupBy(*group).agg(
        F.min(row_id).alias("group_key"), F.max(row_id).alias("__last"),
        *(F.max(F.when(F.coalesce(b.usable, F.lit(False)), rank)).alias(f"__b{i}") for i, b in enumerate(bundles)),
    )
    each = [
        F.when(F.col(f"__b{i}").isNotNull(), F.struct(
            F.lit(b.name).alias("bundle"), (-F.col(f"__b{i}.gain")).alias("loss"), F.col(f"__b{i}.id").alias("id"), F.lit("{}").alias("seen")))
        for i, b in enumerate(bundles)
    ]
    return best.filter("group_key < __last").select(*group, "group_key", F.array_compact(F.array(*each)).alias("options"))


def _candidates(known: DataFrame, group: list[str], rank: Column, bundles: list[Bundle], allowed: dict[str, set]) -> DataFrame:
    """(group…, bundle, seen, best): the record of the greatest gain, then rank, of each bundle and watched values.

    Only values that some dependency allows are usable in a watched field, so their number is that of
    the fixed tables, whatever the group's size.
    """
    each = []
    for b in bundles:
        seen = {f: allowed[f] for f in b.fields if f in allowed}
        usable = F.coalesce(b.usable, F.lit(False))
        for f, values in seen.items():
            usable = usable & F.coalesce(F.col(f).isin(*values), F.lit(False))
        names = F.to_json(F.struct(*(F.col(f) for f in seen))) if seen else F.lit("{}")
        each.append(F.when(usable, F.struct(F.lit(b.name).alias("bundle"), names.alias("seen"))))
    long = known.select(*group, rank.alias("rank"), F.explode(F.array_compact(F.array(*each))).alias("c"))
    return long.groupBy(*group, F.col("c.bundle").alias("bundle"), F.col("c.seen").alias("seen")).agg(F.max(F.struct("rank.gain", "rank")).alias("most")).withColumn("best", F.col("most.rank")).drop("most")


def branch_and_bound(options: dict[str, list[tuple[int, dict, object]]], fits) -> dict[str, object] | None:
    """{bundle: record} of the greatest total gain under ``fits``; None where nothing fits.

    ``options`` has (gain, watched values, record) of each bundle, best first.  A node is bounded by
    its gains so far and the best gain of every bundle still open, and the node of the
    greatest bound is opened first, so the first full choice is the best one; of equals the one whose first bundles by name
    take their first options.
    """
    names = sorted(options)
    ahead = [0]
    for n in reversed(names):
        ahead.append(ahead[-1] + max((o[0] for o in options[n]), default=0))
    ahead.reverse()
    heap: list[tuple] = [(-ahead[0], (), 0, {})]
    while heap:
        _, picks, gain, values = heapq.heappop(heap)
        at = len(picks)
        if at == len(names):
            return {n: options[n][i][2] for n, i in zip(names, picks)}
        for i, (more, seen, _) in enumerate(options[names[at]]):
            both = values | seen
            if fits(both):
                heapq.heappush(heap, (-(gain + more + ahead[at + 1]), (*picks, i), gain + more, both))
    return None


def best_part(options: dict[str, list[tuple[float, dict, object]]], fits) -> dict[str, object]:
    """{bundle: record} of as many bundles as fit together, and of these the greatest total gain; ties go to the first names.

    A bundle is left empty only where no choice of more bundles fits.  The subsets are those of the declared bundles, a small
    fixed number, and only groups without a full choice see more than the first.
    """
    for size in range(len(options), 0, -1):
        found = [c for names in itertools.combinations(sorted(options), size) if (c := branch_and_bound({n: options[n] for n in names}, fits))]
        if found:
            return max(found, key=lambda c: sum(next(o[0] for o in options[n] if o[2] == record) for n, record in c.items()))
    return {}


def best_representative(
    rows: DataFrame, group: list[str], row_id: str, order: list[Column], bundles: list[Bundle],
    gain: Column | None = None, dependencies: list[tuple[str, str, set[tuple]]] | None = None,
) -> DataFrame:
    """(group…, group_key, bundle, row_id) for each group of at least two different ids.

    ``order`` ranks records, the greatest first, null behind all else; ties go to the greater ``row_id``
    unless the order says more.  ``dependencies`` are (field, field, allowed value pairs) that must
    hold across the chosen bundles; the pairs are a small fixed table, and the choice is the one of the greatest
    total ``gain`` (in millionths, so that sums are exact; of equals the greater gain, then the smaller id, bundle by bundle).  Where no choice of all bundles fits, the fewest are left empty.  A bundle that is left empty
    or has no usable record gives no row, groups with a null key do not exist, repeated rows count once, an
    empty table gives none.
    """
    known = rows.filter(" and ".join(f"`{g}` is not null" for g in [*group, row_id]))
    exact = F.lit(0) if gain is None else F.round(F.coalesce(gain, F.lit(0.0)) * 1_000_000)
    rank = _ranked(order, row_id, exact.cast("long"))
    rules = [(a, b, frozenset(pairs)) for a, b, pairs in dependencies or ()]
    if not dependencies:
        offered = _best_of_each(known, group, row_id, rank, bundles)
    else:
        offered = _offered(known, group, row_id, rank, bundles, dependencies)

    def fits(values: dict) -> bool:
        return all(a not in values or b not in values or (values[a], values[b]) in pairs for a, b, pairs in rules)

    def choose(options: pd.Series) -> pd.Series:
        out = []
        for group_options in options:
            by: dict[str, list] = {}
            for o in group_options:
                by.setdefault(o["bundle"], []).append((-o["loss"], json.loads(o["seen"]) if rules else {}, o["id"]))
            best = best_part(by, fits)
            out.append([{"bundle": k, "id": v} for k, v in sorted(best.items())])
        return pd.Series(out)

    kind = T.ArrayType(T.StructType([T.StructField("bundle", T.StringType()), T.StructField("id", rows.schema[row_id].dataType)]))
    chosen = F.pandas_udf(choose, kind)
    return offered.select(*group, "group_key", F.explode(chosen("options")).alias("c")).select(
        *group, "group_key", "c.bundle", F.col("c.id").alias(row_id)
    )


def _offered(known: DataFrame, group: list[str], row_id: str, rank: Column, bundles: list[Bundle], dependencies: list[tuple[str, str, set[tuple]]]) -> DataFrame:
    """(group…, group_key, options): each group's candidates, best first by bundle."""
    allowed: dict[str, set] = {}
    for a, b, pairs in dependencies:
        allowed.setdefault(a, set()).update(x for x, _ in pairs)
        allowed.setdefault(b, set()).update(y for _, y in pairs)
    sizes = known.groupBy(*group).agg(F.min(row_id).alias("group_key"), F.max(row_id).alias("__last"))
    picks = _candidates(known, group, rank, bundles, allowed)
    return (
        picks.groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("bundle", (-F.col("best.gain")).alias("loss"), F.col("best.id").alias("id"), "seen"))).alias("options"))
        .join(sizes.filter("group_key < __last"), group)
    )


def case_key(text: Column) -> Column:
    """A text without its case and outer spaces; the letters whose case is not one to one fall together."""
    low = F.lower(F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.regexp_replace(F.translate(F.replace(low, F.lit("i\u0307"), F.lit("i")), "ıſς", "isσ"), "ß", "ss")


def memory_records(dynamics: DataFrame) -> tuple[DataFrame, dict[str, Column], list[Column]]:
    """(rows with the group's columns, usable condition of each field, ranking order) of memory records."""
    rows = dynamics.withColumn("value_key", case_key(F.col("value_text")))
    usable = {
        "level": F.col("level").between(1, 5),
        "source": (F.regexp_replace("source", r"[\s ]+", "") != "") & (F.lower(F.trim("source")) != "unknown"),
        "stated_at": (F.col("stated_at") >= F.lit("2000-01-01").cast(dynamics.schema["stated_at"].dataType)) & (
            F.col("loaded_at").isNull() | (F.col("stated_at") <= F.col("loaded_at"))
        ),
        "trust": ~F.isnan("trust") & F.col("trust").between(0, 1),
        "unit": F.col("unit").isNotNull(),
        "witnesses": F.col("witnesses") >= 1,
    }
    ranks = ("level", "witnesses", "stated_at", "trust")
    order = [usable_or_null(F.col(c), usable[c]) for c in ranks] + [-F.col("record_key")]
    return rows, usable, order


def surviving_fields(dynamics: DataFrame) -> DataFrame:
    """(group_key, field, record_key): the record whose value of each field survives.

    Every field is a bundle of its own and no dependency joins two of them, as the statement of this
    project's problem wants them chosen field by field.
    """
    rows, usable, order = memory_records(dynamics)
    bundles = [Bundle(name, (name,), condition) for name, condition in usable.items()]
    found = best_representative(rows, ["subject", "predicate", "value_key"], "record_key", order, bundles)
    return found.select("group_key", F.col("bundle").alias("field"), "record_key")


def surviving_records(dynamics: DataFrame) -> DataFrame:
    """One record for each group: group_key, its keys, and the six fields as they survive."""
    chosen = surviving_fields(dynamics)
    names = ["level", "source", "stated_at", "trust", "unit", "witnesses"]
    values = dynamics.groupBy("record_key").agg(*(F.max(n).alias(n) for n in [*names, "subject", "predicate"]))
    picked = chosen.join(values, "record_key")
    return picked.groupBy("group_key", "subject", "predicate").agg(
        *(F.max(F.when(F.col("field") == n, F.col(n))).alias(n) for n in names)
    )


def surviving_bundles(dynamics: DataFrame) -> DataFrame:
    """(group_key, bundle, record_key) with dependent fields taken together, by the greatest total trust.

    ``level``, ``trust`` and ``source`` say where a value comes from, ``witnesses`` and ``stated_at`` who holds it since when,
    ``episodic`` and ``last_seen`` whether it is settled; ``unit`` stands alone.  Across bundles holds the store's own rule
    of settling: a record that is no longer episodic has two witnesses or more.  Raw records break it
    (a fifth of all rows of the test table), so the best evidence and the best standing of a group often do not fit together.
    """
    rows, usable, order = memory_records(dynamics)
    rows = rows.withColumn("several", F.col("witnesses") >= 2)
    bundles = [
        Bundle("evidence", ("witnesses", "stated_at", "several"), usable["stated_at"] & usable["witnesses"]),
        Bundle("provenance", ("level", "trust", "source"), usable["level"] & usable["trust"] & usable["source"]),
        Bundle("standing", ("episodic", "last_seen"), F.col("episodic").isNotNull() & F.col("last_seen").isNotNull()),
        Bundle("unit", ("unit",), usable["unit"]),
    ]
    allowed = {(True, True), (True, False), (False, True)}  # (several witnesses, episodic)
    trust = usable_or_null(F.col("trust"), usable["trust"])
    return best_representative(
        rows, ["subject", "predicate", "value_key"], "record_key", order, bundles, trust, [("several", "episodic", allowed)]
    ).select("group_key", "bundle", "record_key")
