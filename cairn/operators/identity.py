"""Identities and the write side of the graph: labels, cells, admission into what is known, contradiction fields, transitivity (GR-10 .. GR-17, GR-26, JN-01, JN-05, SRC-21)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import records
from cairn.session import checkpointed

DOCUMENT, INFERENCE, CAUSE = 4, "#inference", "causes"


def key_of(name: Column) -> Column:
    """GR-26: the key of a new identity, from its folded name; units (``#unit:``) have negative keys."""
    size = F.abs(F.xxhash64(tx.fold(name)) % F.lit(1 << 62)) + 1
    return F.when(F.startswith(name, F.lit("#unit:")), -size).otherwise(size)


def ensured(names: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-01, GR-26: ((name, key), labels with the new ones): names that no label resolves become identities of their own.

    ``names``: (name); ``labels``: (label, key, seen).  A new identity is also called by its name without outer punctuation.
    """
    asked = names.select("name").filter("trim(name) <> ''").distinct()
    found = records.resolved(asked, labels)
    keyed = found.select("name", F.coalesce("key", key_of(tx.bare(F.col("name")))).alias("key"), F.col("key").isNull().alias("new"))
    fresh = keyed.filter("new").select(F.explode(F.array_distinct(F.array("name", tx.bare(F.col("name"))))).alias("label"), "key", F.lit(0).cast("int").alias("seen")).filter("label <> ''")
    return keyed.select("name", "key"), labels.select("label", "key", F.col("seen").cast("int").alias("seen")).unionByName(fresh).distinct()


def unit_identities(units: DataFrame) -> DataFrame:
    """GR-26: (key, label) of learned units (token)."""
    label = F.concat(F.lit("#unit:"), F.col("token"))
    return units.select("token").distinct().select(key_of(label).alias("key"), label.alias("label"))


def cell_claims(cells: DataFrame, labels: DataFrame, level: int = DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """SRC-21: (claims by key, labels): cells (subject, predicate, value, source, at) with all three names resolved or created.

    A cell that points at its own subject, or lacks a name, is refused.
    """
    whole = cells.filter("trim(subject) <> '' and trim(predicate) <> '' and trim(value) <> ''")
    names = whole.select(F.explode(F.array("subject", "predicate", "value")).alias("name"))
    keys, all_labels = ensured(names, labels)
    keys = checkpointed(keys)
    out = whole
    for c in ("subject", "predicate", "value"):
        out = out.join(keys.select(F.col("name").alias(c), F.col("key").alias(f"{c}_key")), c)
    claims = out.filter("subject_key <> value_key").select(
        F.col("subject_key").alias("subject"), F.col("predicate_key").alias("predicate"), F.col("value_key").alias("value"), "source", F.lit(level).alias("level"), "at")
    return claims, all_labels


def readmitted(known: DataFrame, claims: DataFrame) -> DataFrame:
    """GR-10, GR-11: the records after new claims: known statements gain witnesses, new ones begin, and slots with rivals are arbitrated.

    ``known``: (subject, predicate, value, sources array, level, trust, at, last_seen, episodic); ``claims``: (subject, predicate, value, source, level, at).
    A source counts once for a statement however often it says it.  One full join on the statement; arbitration never
    holds a slot in one task.
    """
    on = ["subject", "predicate", "value"]
    new = claims.filter("source is not null").groupBy(*on).agg(
        F.collect_set("source").alias("n_sources"), F.max("level").cast("int").alias("n_level"), F.max("at").alias("n_at"))
    both = known.select(*on, "sources", "level", "trust", "at", "last_seen", "episodic").join(new, on, "full_outer")
    empty = F.array().cast("array<string>")
    old, told = F.coalesce("sources", empty), F.coalesce("n_sources", empty)
    all_ = F.array_sort(F.array_union(old, told))
    level = F.greatest("level", "n_level")  # null only where no side grades it
    rises = F.coalesce("n_level", F.lit(0)) > F.coalesce("level", F.lit(0))
    start = F.when(F.col("trust").isNull(), records.base_trust(F.col("n_level"))).when(rises, F.greatest("trust", records.base_trust(F.col("n_level")))).otherwise(F.col("trust"))
    added = F.size(all_) - F.when(F.col("trust").isNull(), 1).otherwise(F.size(old))
    trust = F.when(added > 0, F.greatest(start, records.reinforced_trust(start, added + 1))).otherwise(start)
    merged = both.select(
        *on, all_.alias("sources"), level.cast("int").alias("level"), F.round(trust, 9).alias("trust"), F.greatest("at", "n_at").alias("at"),
        F.greatest("last_seen", "n_at").alias("last_seen"), F.coalesce("episodic", F.lit(True)).alias("episodic"),
    ).withColumns({"witnesses": F.size("sources"), "source": F.get("sources", 0), "record_key": F.xxhash64(*on)})
    judged = records.arbitrated(merged)
    return judged.withColumn("trust", F.col("new_trust")).drop("new_trust", "lost")


def about(edges: DataFrame, key, column: str = "subject") -> DataFrame:
    """JN-05: the records of one subject, value or predicate."""
    return edges.filter(F.col(column) == key)


def touched(edges: DataFrame, key, now: Column) -> DataFrame:
    """JN-05: the records with ``last_seen`` of a subject's records moved to now."""
    return edges.withColumn("last_seen", F.when(F.col("subject") == key, now.cast("timestamp")).otherwise(F.col("last_seen")))


def neighbours(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """JN-05: (key, other, predicate, outward): edges at either end of each key, one hop, undirected."""
    asked = keys.select("key").distinct()
    out = edges.select(F.col("subject").alias("key"), F.col("value").alias("other"), "predicate", F.lit(True).alias("outward"))
    back = edges.select(F.col("value").alias("key"), F.col("subject").alias("other"), "predicate", F.lit(False).alias("outward"))
    return out.unionByName(back).join(asked, "key", "left_semi").distinct()


def causes_of(edges: DataFrame, effect) -> DataFrame:
    """GR-19, JN-05: (cause) of an effect among edges cause, 'causes', effect."""
    return edges.filter((F.col("predicate") == CAUSE) & (F.col("value") == effect)).select(F.col("subject").alias("cause")).distinct()


def effects_of(edges: DataFrame, cause) -> DataFrame:
    return edges.filter((F.col("predicate") == CAUSE) & (F.col("subject") == cause)).select(F.col("value").alias("effect")).distinct()


def contradictions(known: DataFrame) -> DataFrame:
    """GR-12, GR-13: (a, b) links of rival records: each record of a slot with the slot's first record of another value.

    Connectivity carries a field, so no clique is built: a slot of n records has at most n links.
    """
    slot = ["subject", "predicate"]
    first = known.groupBy(*slot).agg(F.min(F.struct("record_key", "value")).alias("f"))
    other = known.join(first, slot).filter(F.col("value") != F.col("f.value"))
    # records of the first value meet the first record of another value
    second = other.groupBy(*slot).agg(F.min("record_key").alias("s"))
    links = other.select(F.col("f.record_key").alias("a"), F.col("record_key").alias("b"))
    same = known.join(first, slot).filter(F.col("value") == F.col("f.value")).join(second, slot).select(F.col("record_key").alias("a"), F.col("s").alias("b"))
    return links.unionByName(same).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contradiction_fields(known: DataFrame, links: DataFrame) -> DataFrame:
    """GR-13: (record_key, field): the closure over contradiction links within one slot; a field is called by its smallest record.

    Links between different slots do not count; a record without a link is a field of its own.  The smallest label of a neighbour
    is taken, and that label's own label, until none changes; a round is two joins, cut in the checkpoint folder.
    """
    place = known.select("record_key", "subject", "predicate")
    a = place.select(F.col("record_key").alias("a"), F.col("subject").alias("sa"), F.col("predicate").alias("pa"))
    b = place.select(F.col("record_key").alias("b"), F.col("subject").alias("sb"), F.col("predicate").alias("pb"))
    inside = links.select("a", "b").join(a, "a").join(b, "b").filter("sa = sb and pa = pb").select("a", "b")
    both = checkpointed(inside.unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(place.select("record_key", F.col("record_key").alias("field")))
    for _ in itertools.count():
        near = both.join(labels.withColumnRenamed("record_key", "b"), "b").groupBy(F.col("a").alias("record_key")).agg(F.min("field").alias("near"))
        step = labels.join(near, "record_key", "left").select("record_key", "field", F.least("field", F.coalesce("near", F.col("field"))).alias("new"))
        jumped = step.join(labels.select(F.col("record_key").alias("new"), F.col("field").alias("far")), "new", "left")
        after = checkpointed(jumped.select("record_key", F.least("new", F.coalesce("far", F.col("new"))).alias("field"), (F.least("new", F.coalesce("far", F.col("new"))) != F.col("field")).alias("moved")))
        labels = after.select("record_key", "field")
        if after.filter("moved").isEmpty():
            return labels


def learned_transitive(edges: DataFrame, least: int = 2) -> DataFrame:
    """GR-17: (predicate, closed): predicates with at least two closed triangles among witnessed edges; derived edges do not count."""
    witnessed = edges.filter(F.coalesce("source", F.lit("")) != INFERENCE)
    return records.triangles(witnessed).filter(F.col("closed") >= least)


def derived(known: DataFrame) -> DataFrame:
    """GR-18: (subject, predicate, value, hops, trust, level): what transitive predicates imply and no record says.

    A derived edge is of the lowest level and no more trusted than the weakest edge of a witnessed one-predicate graph, faded once a hop.
    """
    transitive = learned_transitive(known).select("predicate")
    edges = known.join(transitive, "predicate", "left_semi")
    weakest = edges.groupBy("predicate").agg(F.min("trust").alias("least"))
    implied = records.closure(edges).filter("hops > 1")
    new = implied.join(known.select("subject", "predicate", "value"), ["subject", "predicate", "value"], "left_anti").join(weakest, "predicate")
    fade = F.pow(F.lit(1 - records.SHARE), F.col("hops") - 1)
    return new.select("subject", "predicate", "value", "hops", F.round(F.greatest(F.lit(records.FLOOR), F.col("least") * fade), 9).alias("trust"), F.lit(1).alias("level"))
