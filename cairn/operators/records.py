"""The record graph: tables to records, admission, arbitration, sleep, transitivity, closure (SNK-02, JN-01, JN-05, JN-11, GR-10 .. GR-25, AG-16 .. AG-18)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.session import checkpointed

# Source levels and the trust that each begins with.
TRUST = {5: 0.75, 4: 0.60, 3: 0.50, 2: 0.35, 1: 0.30}
SPEAK, SHARE, CAP = 0.4, 0.15, 0.98
# A step of fading, its floor, the seconds for which a record is fresh, and the trust of what is settled.
FADE, FLOOR, FRESH_S, SETTLED = 0.03, 0.1, 3600, 0.65


def unpivoted(table: DataFrame, entity: str, columns: list[str] | None = None) -> DataFrame:
    """SNK-02: (entity, field, value) of each non-empty cell of a table, values as text."""
    fields = [c for c in (columns or table.columns) if c != entity]
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c in fields))
    return table.filter(F.col(entity).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.explode(cells).alias("c")).select(
        "entity", "c.field", "c.value"
    ).filter("value is not null and value <> ''")


def cell_text(c: Column) -> Column:
    """SRC-08: a whole float prints as an integer, line breaks become spaces."""
    text = c.cast("string")
    return F.when(text.rlike(r"^-?\d{1,15}\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(F.trim(F.regexp_replace(text, r"\s*\n\s*", " ")))


def resolved(names: DataFrame, labels: DataFrame) -> DataFrame:
    """JN-01: (name, key): the identity of a name by its folded label, else by the label without up to three last letters.

    Of several identities the most seen counts, then the smallest key.  ``labels``: (label, key, seen).
    """
    known = labels.select(tx.fold("label").alias("folded"), "key", F.coalesce("seen", F.lit(0)).alias("seen"))
    best = known.groupBy("folded").agg(F.max(F.struct("seen", (-F.col("key")).alias("m"))).alias("b")).select("folded", (-F.col("b.m")).alias("key"))
    asked = names.select("name").distinct().withColumn("f", tx.fold("name"))
    cuts = asked.select("name", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.struct(n.alias("cut"), F.left(F.col("f"), F.greatest(F.length("f") - n, F.lit(0))).alias("folded"))),
                                                      lambda s: (s["cut"] == 0) | (F.length(s["folded"]) >= 5))).alias("s")).select("name", "s.cut", "s.folded")
    found = cuts.join(best, "folded").groupBy("name").agg(F.min(F.struct("cut", "key")).alias("b"))
    return asked.join(found, "name", "left").select("name", F.col("b.key").alias("key"))


def reinforced_trust(first: Column, sources: Column) -> Column:
    """GR-11: trust after so many different sources of one level, in closed form."""
    return F.least(F.lit(CAP), 1 - (1 - first) * F.pow(F.lit(1 - SHARE), sources - 1))


def base_trust(level: Column) -> Column:
    out = F.lit(0.3)
    for k, v in TRUST.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return out


def admitted(claims: DataFrame) -> DataFrame:
    """GR-10: one record for each (subject, predicate, value) of a batch of claims, witnesses counted by source.

    ``claims``: (subject, predicate, value, source, level, at).  A claim without source is refused.  The level is
    the highest; different sources of a batch count in the closed form of one level.
    """
    kept = claims.filter("source is not null")
    return kept.groupBy("subject", "predicate", "value").agg(
        F.count_distinct("source").alias("witnesses"), F.max("level").alias("level"), F.max("at").alias("at")
    ).withColumn("trust", F.round(reinforced_trust(base_trust(F.col("level")), F.col("witnesses")), 9))


def arbitrated(records: DataFrame, key: str = "record_key") -> DataFrame:
    """GR-12 .. GR-14: the slot's winner keeps its trust, every rival is capped below speaking.

    Records of a slot with one value are no rivals.  The winner is a partial aggregate, so a slot of any size is
    never in one task, and it comes back to its records by a join that may split a hot slot.
    """
    last = F.struct(
        F.coalesce("level", F.lit(-1)).alias("l"), F.coalesce("witnesses", F.lit(-1)).alias("w"), F.coalesce("at", F.lit("0001-01-01").cast("timestamp")).alias("a"),
        F.coalesce("trust", F.lit(-1.0)).alias("t"), (-F.col(key)).alias("k"),
    )
    slots = records.groupBy("subject", "predicate").agg(F.max(last).alias("win"), F.min("value").alias("__lo"), F.max("value").alias("__hi")).select(
        "subject", "predicate", (-F.col("win.k")).alias("winner"), F.col("win.t").alias("top"), (F.col("__lo") != F.col("__hi")).alias("rivalled")
    )
    joined = records.join(slots, ["subject", "predicate"])
    won = joined.join(joined.filter(F.col(key) == F.col("winner")).select("subject", "predicate", F.col("value").alias("won")), ["subject", "predicate"])
    loses = F.col("rivalled") & (F.col("value") != F.col("won"))
    return won.withColumn("new_trust", F.round(F.when(loses, F.least(F.coalesce("trust", F.lit(0.0)), F.least(F.col("top"), F.lit(SPEAK)) * 0.5)).otherwise(F.col("trust")), 9)).withColumn("lost", loses).drop("top", "rivalled", "won", "winner")


def rival_measures(records: DataFrame) -> DataFrame:
    """GR-12: values of a slot that measures exclude or leave room for: (subject, predicate, value, other, overlap).

    Distinct values of a slot only; ``records`` has low, high, unit.
    """
    distinct = records.select("subject", "predicate", "unit", "low", "high").filter("unit is not null").distinct()
    a = distinct.select("subject", "predicate", "unit", F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = distinct.select("subject", "predicate", "unit", F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    return a.join(b, ["subject", "predicate", "unit"]).filter("low_a < low_b").withColumn("overlaps", (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a")))


def pressure(records: DataFrame) -> DataFrame:
    """AG-17: (subject, predicate, value, pressure): min of the own trust and the strongest rival's.

    The two best values of each slot decide, so no pair of rivals is made.
    """
    values = records.filter("trust is not null and not isnan(trust)").groupBy("subject", "predicate", "value").agg(F.max("trust").alias("trust"))
    best = values.groupBy("subject", "predicate").agg(F.max(F.struct("trust", "value")).alias("first"))
    rest = values.join(best, ["subject", "predicate"])
    second = rest.filter(F.col("value") != F.col("first.value")).groupBy("subject", "predicate").agg(F.max("trust").alias("second"))
    with_both = rest.join(second, ["subject", "predicate"])
    rival = F.when(F.col("value") == F.col("first.value"), F.col("second")).otherwise(F.col("first.trust"))
    return with_both.select("subject", "predicate", "value", F.round(F.least("trust", rival), 6).alias("pressure"))


def slept(records: DataFrame, now: Column) -> DataFrame:
    """GR-16: settle what two witnesses hold, fade what is old, single and episodic; one pass without a shuffle."""
    settles = F.col("episodic") & (F.col("witnesses") >= 2)
    idle = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    fades = ~F.coalesce(settles, F.lit(False)) & F.col("episodic") & (F.coalesce("witnesses", F.lit(1)) <= 1) & (F.coalesce("level", F.lit(1)) < 5) & (idle >= FRESH_S)
    trust = F.when(settles, F.greatest(F.col("trust"), F.lit(SETTLED))).when(F.coalesce(fades, F.lit(False)), F.greatest(F.col("trust") - FADE, F.lit(FLOOR))).otherwise(F.col("trust"))
    return records.withColumn("new_trust", F.round(trust, 9)).withColumn("now_episodic", F.col("episodic") & ~F.coalesce(settles, F.lit(False)))


def triangles(edges: DataFrame) -> DataFrame:
    """GR-17: (predicate, closed): closed triangles a to b to c with a to c among witnessed edges."""
    e = edges.select("subject", "predicate", "value").distinct()
    two = e.select("predicate", "subject", F.col("value").alias("mid")).join(e.select("predicate", F.col("subject").alias("mid"), F.col("value")), ["predicate", "mid"])
    closed = two.filter("subject <> value and subject <> mid and mid <> value").join(e, ["predicate", "subject", "value"], "left_semi")
    return closed.groupBy("predicate").agg(F.count(F.lit(1)).alias("closed"))


def closure(edges: DataFrame) -> DataFrame:
    """GR-18: (predicate, subject, value, hops): all derived edges, by semi-naive rounds until nothing new comes.

    Each round joins only the newest edges with the given ones; the lineage is cut in the checkpoint folder.  A finite graph
    ends, however long its chains are.
    """
    base = checkpointed(edges.select("predicate", "subject", "value").filter("subject <> value").distinct())
    known = base.withColumn("hops", F.lit(1))
    fresh = known
    step = base.select("predicate", F.col("subject").alias("mid"), F.col("value").alias("far"))
    for hop in itertools.count(2):
        new = (
            fresh.select("predicate", "subject", F.col("value").alias("mid")).join(step, ["predicate", "mid"])
            .select("predicate", "subject", F.col("far").alias("value")).filter("subject <> value").distinct()
            .join(known, ["predicate", "subject", "value"], "left_anti").withColumn("hops", F.lit(hop))
        )
        fresh = checkpointed(new)
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
        if hop % 8 == 0:
            known = checkpointed(known)
    return known


def root_causes(causes: DataFrame, effects: DataFrame, depth: int = 4) -> DataFrame:
    """GR-19: (effect, cause, target, depth): edges met walking backwards from each target, each edge at its first depth.

    ``causes``: (cause, effect); ``effects``: (target).
    """
    edges = causes.select("cause", "effect").distinct()
    fresh = effects.select("target", F.col("target").alias("effect")).distinct()
    seen = fresh
    out = None
    for d in range(1, depth + 1):
        met = checkpointed(fresh.join(edges, "effect").select("target", "effect", "cause").distinct().withColumn("depth", F.lit(d)))
        out = met if out is None else out.unionByName(met)
        fresh = met.select("target", F.col("cause").alias("effect")).distinct().join(seen, ["target", "effect"], "left_anti")
        seen = seen.unionByName(fresh)
    return out


def gaps(identities: DataFrame, records: DataFrame) -> DataFrame:
    """AG-16: (identity_key, gap): 1+seen for an identity without records, 0.5+seen where all are episodic."""
    held = records.groupBy(F.col("subject").alias("identity_key")).agg(F.min(F.col("episodic").cast("int")).alias("all_episodic"))
    seen = F.coalesce("seen", F.lit(0)).cast("double")
    joined = identities.join(held, "identity_key", "left")
    return joined.select("identity_key", F.when(F.col("all_episodic").isNull(), 1.0 + seen).when(F.col("all_episodic") == 1, 0.5 + seen).alias("gap")).filter("gap is not null")


def wonder(identities: DataFrame, records: DataFrame) -> DataFrame:
    """AG-16: (identity_key, references): how often an identity without a spoken record is referred to."""
    spoken = records.filter(F.col("trust") >= SPEAK).select(F.col("subject").alias("identity_key")).distinct()
    used = records.groupBy(F.col("predicate").alias("identity_key")).agg(F.count(F.lit(1)).alias("references"))
    return identities.select("identity_key").join(spoken, "identity_key", "left_anti").join(used, "identity_key")


def gathered(records: DataFrame, most: int = 4) -> DataFrame:
    """GT-19: the best spoken records of each subject by trust, then key."""
    by = Window.partitionBy("subject").orderBy(F.col("trust").desc(), "record_key")
    spoken = records.filter((F.col("trust") >= SPEAK) & ~F.isnan("trust") | (F.col("source") == "#inference"))
    return spoken.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)


def associated(records: DataFrame, subjects: DataFrame, most: int = 4) -> DataFrame:
    """GT-19: (subject, record_key, hop, place): the spoken records of a subject and, one hop on, of its values; by trust, then key."""
    spoken = records.filter((F.col("trust") >= SPEAK) & ~F.isnan("trust") | (F.col("source") == "#inference"))
    own = subjects.select("subject").distinct().join(spoken, "subject").select("subject", "record_key", "value", "trust", F.lit(0).alias("hop"))
    text = spoken.select(F.col("subject").cast("string").alias("value"), F.col("record_key").alias("far"), F.col("trust").alias("far_trust")).filter(F.col("far_trust") >= SPEAK)
    hop = own.join(text, "value").select("subject", F.col("far").alias("record_key"), F.col("far_trust").alias("trust"), F.lit(1).alias("hop"))
    both = own.select("subject", "record_key", "trust", "hop").unionByName(hop).groupBy("subject", "record_key").agg(F.max("trust").alias("trust"), F.min("hop").alias("hop"))
    by = Window.partitionBy("subject").orderBy(F.col("trust").desc(), "record_key")
    return both.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).select("subject", "record_key", "hop", "place")


def recalled(experiences: DataFrame, about: list, most: int = 8) -> DataFrame:
    """GR-24: the experiences about any of the identities, the most surprising first, then the latest; a top-k."""
    return experiences.filter(F.arrays_overlap("about", F.array(*(F.lit(x) for x in about)))).orderBy(F.col("surprise").desc(), F.col("at").desc(), "experience_key").limit(most)


def weighed(expected: Column, actual: Column) -> Column:
    """GR-24: the surprise of an outcome, at most 1."""
    return F.least(F.lit(1.0), F.abs(expected - actual))


def lookup(records: DataFrame, labels: DataFrame, questions: DataFrame) -> DataFrame:
    """JN-11: (question_id, value): questions that name exactly one subject and field and meet one value.

    ``questions``: (question_id, question); ``records``: (entity, field, value).  Runs of the question's words join the folded names.
    """
    runs = questions.select("question_id", F.explode(F.array_distinct(tx.spans(F.array_join(tx.tokens(F.col("question")), " ")))).alias("run"))
    name = lambda c: F.array_join(tx.tokens(F.col(c)), " ")
    # a plan that goes by the compressed size of the files would build a table of all names, or of all records, in the driver
    named = labels.select(name("entity").alias("run"), "entity").distinct().hint("merge")
    subjects = runs.join(named, "run").select("question_id", "entity", F.length("run").alias("width"))
    widest = subjects.withColumn("r", F.rank().over(Window.partitionBy("question_id").orderBy(F.col("width").desc()))).filter("r = 1").select("question_id", "entity").distinct()
    fields = runs.hint("merge").join(records.select("field").distinct().select(name("field").alias("run"), "field"), "run").select("question_id", "field").distinct()
    hits = widest.hint("merge").join(fields, "question_id").hint("merge").join(records.hint("merge"), ["entity", "field"]).select("question_id", "value").distinct()
    return hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value")).filter("n = 1").drop("n")


def pruned_experiences(experiences: DataFrame, most: int = 2000) -> DataFrame:
    """GR-16, GR-24: the strongest experiences by |outcome| + surprise, then the latest; a top-k."""
    strength = F.abs("outcome") + F.col("surprise")
    return experiences.withColumn("strength", F.round(strength, 6)).orderBy(F.col("strength").desc(), F.col("at").desc(), "experience_key").limit(most)


def status(records: DataFrame, identities: DataFrame) -> DataFrame:
    """AG-18: one row: facts, concepts, derived, and the sum of trust that fingerprints a state."""
    facts = records.agg(F.count(F.lit(1)).alias("facts"), F.sum(F.when(F.col("source") == "#inference", 1).otherwise(0)).alias("derived"),
                        F.round(F.sum(F.when(~F.isnan("trust"), F.col("trust"))), 4).alias("trust"))
    return facts.join(F.broadcast(identities.agg(F.count(F.lit(1)).alias("concepts"))), F.lit(True))


def extremes(measured: DataFrame, least_sources: int = 3) -> DataFrame:
    """AG-11: (head, unit, high, high_source, low, low_source) of each head that enough sources write, in its most used unit.

    ``measured``: (head, source, low, unit).  Heads whose values are all equal have no row.
    """
    known = measured.filter("unit is not null and low is not null")
    wide = known.groupBy("head").agg(F.count_distinct("source").alias("sources")).filter(F.col("sources") >= least_sources).select("head")
    used = known.groupBy("head", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("low", "source")).alias("hi"), F.min(F.struct("low", "source")).alias("lo")
    )
    best = used.groupBy("head").agg(F.min(F.struct((-F.col("n")).alias("m"), "unit", "hi", "lo")).alias("b")).join(wide, "head")
    return best.filter("b.m <= -3 and b.hi.low <> b.lo.low").select(
        "head", F.col("b.unit").alias("unit"), F.col("b.hi.low").alias("high"), F.col("b.hi.source").alias("high_source"),
        F.col("b.lo.low").alias("low"), F.col("b.lo.source").alias("low_source"),
    )


def self_clashes(values: DataFrame) -> DataFrame:
    """AG-12: (source, head, clash): heads under which one source writes several values whose numbers differ.

    ``values``: (source, head, value).
    """
    digits = F.array_join(F.regexp_extract_all("value", F.lit(r"\d+"), 0), " ")
    each = values.filter("source is not null").select("source", "head", "value", digits.alias("d")).filter("d <> ''")
    found = each.groupBy("source", "head").agg(F.count_distinct("d").alias("n"), F.array_join(F.sort_array(F.collect_set("value")), " ≠ ").alias("clash"))
    return found.filter("n > 1").select("source", "head", "clash")


def compared(values: DataFrame, first: str, second: str) -> DataFrame:
    """AG-12: (head, sign, first_values, second_values) for two sources that share a head.

    ' = ' where their numbers are equal, ' ≠ ' where both have numbers and differ, ' · ' otherwise.
    ``values``: (head, source, value).
    """
    digits = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda v: F.regexp_extract_all(v, F.lit(r"\d+"), 0)))))
    part = lambda s, a: values.filter(F.col("source") == s).groupBy("head").agg(F.array_sort(F.collect_set("value")).alias(a))
    both = part(first, "a").join(part(second, "b"), "head").withColumns({"da": digits(F.col("a")), "db": digits(F.col("b"))})
    sign = F.when((F.size("da") > 0) & (F.col("da") == F.col("db")), " = ").when((F.size("da") > 0) & (F.size("db") > 0), " ≠ ").otherwise(" · ")
    return both.select("head", sign.alias("sign"), F.array_join("a", "; ").alias("first_values"), F.array_join("b", "; ").alias("second_values"))
