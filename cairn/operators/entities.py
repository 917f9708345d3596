"""Collocations and the entity graph (AG-13, AG-14, GR-20 .. GR-23)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.session import checkpointed

MIN_PAIR, MIN_PMI, LONGEST = 3, 1.0, 5
DAMPING, ROUNDS = 0.85, 20


def line_tokens(rows: DataFrame, sid: str = "sid") -> DataFrame:
    """TXT-28: (sid, source, toks) with all content words of a line; the reference stops at 400."""
    # the tokens are a column of their own, so that they are made once a line and not once a word
    return rows.select(sid, "source", tx.tokens(F.col("sentence")).alias("t")).select(sid, "source", tx.content(F.col("t")).alias("toks"))


def ngram_counts(lines: DataFrame, longest: int = LONGEST, least: int = MIN_PAIR) -> DataFrame:
    """(gram, size, n): runs of 1 to ``longest`` words that occur often enough; summed before the shuffle."""
    def runs(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.size("toks") - n + 1), lambda i: F.struct(F.array_join(F.slice("toks", i, F.lit(n)), " ").alias("gram"), F.lit(n).alias("size")))
        return F.when(F.size("toks") >= n, at).otherwise(F.array().cast("array<struct<gram:string,size:int>>"))

    sized = [runs(n) for n in range(1, longest + 1)]
    each = lines.select(F.explode(F.concat(*sized)).alias("g")).select("g.gram", "g.size")
    return each.groupBy("gram", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def collocations(lines: DataFrame, longest: int = LONGEST, least: int = MIN_PAIR, pmi: float = MIN_PMI) -> DataFrame:
    """AG-13: (gram, size, n, cohesion) of the phrases of 2 to ``longest`` words of a corpus, all from one table of counts.

    A phrase is cohesive (over every split ln(p(run) / (p(left) p(right))) is at least ``pmi``), sticky (every split
    makes up more than half of one of its sides), free (no word stands beside it in more than half of its places) and
    maximal (no longer phrase holds it).
    """
    counts = checkpointed(ngram_counts(lines, longest + 1, min(2, least)))
    total = lines.agg(F.sum(F.size("toks")).cast("double").alias("total"))
    words = F.split("gram", " ")
    cut = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    splits = counts.filter((F.col("size") > 1) & (F.col("size") <= longest) & (F.col("n") >= least)).select(
        "gram", "size", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    ).select("gram", "size", "n", cut(F.lit(1), F.col("cut")).alias("left"), cut(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    l = counts.select(F.col("gram").alias("left"), F.col("n").alias("nl"))
    r = counts.select(F.col("gram").alias("right"), F.col("n").alias("nr"))
    scored = splits.join(l, "left").join(r, "right").join(F.broadcast(total), F.lit(True))
    value = F.log(F.col("n") * F.col("total") / (F.col("nl") * F.col("nr")))
    share = F.greatest(F.col("n") / F.col("nl"), F.col("n") / F.col("nr"))
    best = scored.groupBy("gram", "size", "n").agg(F.round(F.min(value), 6).alias("cohesion"), F.min(share).alias("share")).filter(
        (F.col("cohesion") >= pmi) & (F.col("share") > 0.5)
    )
    longer = counts.filter("size > 2").select(F.explode(F.array(cut(F.lit(1), F.col("size") - 1), cut(F.lit(2), F.col("size") - 1))).alias("gram"), F.col("n").alias("beside"))
    crowded = longer.groupBy("gram").agg(F.max("beside").alias("beside"))
    free = checkpointed(best.join(crowded, "gram", "left").filter(2 * F.coalesce("beside", F.lit(0)) <= F.col("n")).select("gram", "size", "n", "cohesion"))
    inner = free.filter("size > 2").select(F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))).alias("gram")).distinct()
    return free.join(inner, "gram", "left_anti")


def mentions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(sid, source, entity): lines that hold a phrase of the name table, matched through their runs of words."""
    sized = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("toks"), F.lit(1))), lambda i: i + n - 1 <= F.size("toks")), lambda i: F.array_join(F.slice("toks", i, n), " "))))
    return lines.select("sid", "source", F.explode(F.array_distinct(sized)).alias("entity")).join(names.select("entity").distinct(), "entity").select("sid", "source", "entity")


def g2(k11: Column, k12: Column, k21: Column, total: Column) -> Column:
    """Log-likelihood of two entities' common lines; 0 where they have none."""
    k22 = F.greatest(total - k11 - k12 - k21, F.lit(0.0))
    def part(k: Column, row: Column, col: Column) -> Column:
        expected = row * col / total
        return F.when((k > 0) & (expected > 0), k * F.log(k / expected)).otherwise(F.lit(0.0))

    r1, r2, c1, c2 = k11 + k12, k21 + k22, k11 + k21, k12 + k22
    value = 2 * (part(k11, r1, c1) + part(k12, r1, c2) + part(k21, r2, c1) + part(k22, r2, c2))
    return F.when(k11 > 0, F.round(value, 6)).otherwise(F.lit(0.0))


def edges(found: DataFrame, total_lines: DataFrame, widest: int = 64) -> DataFrame:
    """AG-14: (a, b, k11, g2) with a < b: entities that share lines.

    The pairs of a line of up to ``widest`` entities are made in its row, those of wider lines by a join, so that no row grows
    with the square of a long line.
    """
    once = found.select("sid", "entity").distinct()
    per = once.groupBy("sid").agg(F.sort_array(F.collect_set("entity")).alias("e")).filter(F.size("e") > 1)
    close = per.filter(F.size("e") <= widest).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda i: F.transform(
        F.slice("e", i + 2, F.size("e")), lambda b: F.struct(F.get("e", i).alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    wide = per.filter(F.size("e") > widest).select("sid", F.explode("e").alias("a"))
    pairs = close.unionByName(wide.join(wide.withColumnRenamed("a", "b"), "sid").filter("a < b").select("a", "b"))
    shared = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("k11"))
    counts = once.groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = shared.join(counts.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b")
    sized = both.join(F.broadcast(total_lines.select(F.col("total").cast("double").alias("total"))), F.lit(True))
    return sized.select("a", "b", F.col("k11").cast("long").alias("k11"), g2(F.col("k11"), F.col("na") - F.col("k11"), F.col("nb") - F.col("k11"), F.col("total")).alias("g2"))


def both_ways(links: DataFrame) -> DataFrame:
    kept = links.filter("g2 > 0")
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), "g2").unionByName(kept.select(F.col("b").alias("src"), F.col("a").alias("dst"), "g2"))


def pagerank(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """GR-20: (walk, entity, score) of walks that return to their seeds; edges weigh their G².

    ``seeds``: (walk, entity); all walks go together.  A round is one join with the edges and one sum, partly made
    before its shuffle; every fifth round cuts the lineage in the checkpoint folder.  Seeds without an edge are dropped.
    """
    walk = both_ways(links)
    out = walk.groupBy("src").agg(F.sum("g2").alias("all"))
    step = checkpointed(walk.join(out, "src").select(F.col("src").alias("entity"), "dst", (DAMPING * F.col("g2") / F.col("all")).alias("share")))
    start = seeds.select("walk", "entity").distinct().join(step.select("entity").distinct(), "entity", "left_semi")
    m = start.groupBy("walk").agg(F.count(F.lit(1)).alias("m"))
    score = rest = checkpointed(start.join(m, "walk").select("walk", "entity", (1 / F.col("m")).alias("score")))
    back = rest.select("walk", "entity", ((1 - DAMPING) * F.col("score")).alias("score"))
    for i in range(rounds):
        moved = score.join(step, "entity").select("walk", F.col("dst").alias("entity"), (F.col("score") * F.col("share")).alias("score"))
        score = moved.unionByName(back).groupBy("walk", "entity").agg(F.sum("score").alias("score"))
        if i % 5 == 4:
            score = checkpointed(score)
    return score.select("walk", "entity", F.round("score", 6).alias("score"))


def bridges(links: DataFrame, first: str, second: str, most: int = 4) -> DataFrame:
    """GR-21: entities linked to both ends, by the product of two walks."""
    seeds = links.sparkSession.createDataFrame([("a", first), ("b", second)], "walk string, entity string")
    scores = pagerank(links, seeds).groupBy("entity").agg(
        F.max(F.when(F.col("walk") == "a", F.col("score"))).alias("sa"), F.max(F.when(F.col("walk") == "b", F.col("score"))).alias("sb")
    )
    walk = both_ways(links)
    linked = lambda name: walk.filter(F.col("src") == name).select(F.col("dst").alias("entity"))
    both = scores.join(linked(first), "entity", "left_semi").join(linked(second), "entity", "left_semi")
    return both.select("entity", F.round(F.col("sa") * F.col("sb"), 9).alias("score")).filter("score is not null").orderBy(F.col("score").desc(), "entity").limit(most)


def everywhere(found: DataFrame, lines: DataFrame) -> DataFrame:
    """GR-22: (entity) held by more than half of the sources, where there are more than two; lines without a source do not count."""
    named = (F.col("source").isNotNull()) & (F.col("source") != "")
    total = lines.filter(named).agg(F.count_distinct("source").alias("total"))
    held = found.filter(named).select("entity", "source").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("held"))
    return held.join(F.broadcast(total), F.lit(True)).filter((F.col("total") > 2) & (2 * F.col("held") > F.col("total"))).select("entity")


def communities(links: DataFrame, rounds: int = ROUNDS, least: int = 3, common: DataFrame | None = None) -> DataFrame:
    """GR-22: (entity, label) by synchronous label propagation; groups of at least three.

    ``common`` are the entities that ``everywhere`` finds in most sources: they separate nothing and take no part.
    The reference walk is asynchronous and order dependent; this distributed variant updates all labels at once and keeps
    an entity's own label on a tie, so it ends or is stopped after ``rounds``.
    """
    if common is not None:
        links = links.join(common.select(F.col("entity").alias("a")), "a", "left_anti").join(common.select(F.col("entity").alias("b")), "b", "left_anti")
    walk = checkpointed(both_ways(links))
    labels = checkpointed(walk.select(F.col("src").alias("entity")).distinct().withColumn("label", F.col("entity")))
    for _ in range(rounds):
        votes = walk.join(labels.select(F.col("entity").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("g2").alias("w"))
        ranked = votes.groupBy("src").agg(F.min(F.struct((-F.round("w", 6)).alias("m"), "label")).alias("best"))
        new = checkpointed(labels.join(ranked, labels["entity"] == ranked["src"], "left").select(
            "entity", F.least(F.coalesce("best.label", F.col("label")), F.coalesce("best.label", F.col("label"))).alias("label"), F.col("label").alias("old")
        ))
        moved = new.filter("label <> old").count()
        labels = new.select("entity", "label")
        if not moved:
            break
    big = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return labels.join(big, "label").select("entity", "label")


def linked(links: DataFrame, entity: str, most: int = 12) -> DataFrame:
    """GR-23: the strongest neighbours of an entity."""
    return both_ways(links).filter(F.col("src") == entity).select(F.col("dst").alias("entity"), "g2").orderBy(F.col("g2").desc(), F.col("entity").desc()).limit(most)


def witnesses(found: DataFrame, first: str, second: str, most: int = 4) -> DataFrame:
    """GR-23: (sid): the lines that carry both ends of an edge, the first by name."""
    return found.filter(F.col("entity").isin(first, second)).groupBy("sid").agg(F.count_distinct("entity").alias("n")).filter("n = 2").select("sid").orderBy("sid").limit(most)


def named_in(lines: DataFrame, names: DataFrame) -> DataFrame:
    """GR-23: (sid, entity): the longest phrases of the name table in each line; a phrase inside a longer one that the line has is left out."""
    found = mentions(lines, names).select("sid", "entity").distinct()
    longer = found.select("sid", F.col("entity").alias("whole"))
    inside = found.join(longer, "sid").filter((F.col("entity") != F.col("whole")) & F.contains(F.concat(F.lit(" "), "whole", F.lit(" ")), F.concat(F.lit(" "), "entity", F.lit(" "))))
    return found.join(inside.select("sid", "entity").distinct(), ["sid", "entity"], "left_anti")


def meeting_or_bridge(found: DataFrame, chars: DataFrame, entities: list[str]) -> DataFrame:
    """JN-03: (sid) of the lines that carry all of up to three entities; where none does, of lines that carry one of them and an entity that
    each of the others shares a line with.  Longest lines first; ``chars``: (sid, chars)."""
    wanted = sorted(set(entities))[:3]
    own = found.filter(F.col("entity").isin(*wanted)).select("sid", "entity").distinct()
    all_ = own.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("sid")
    near = own.select("sid", F.col("entity").alias("end")).join(found.select("sid", "entity").distinct(), "sid").filter(~F.col("entity").isin(*wanted))
    middle = near.groupBy("entity").agg(F.count_distinct("end").alias("n")).filter(F.col("n") == len(wanted)).select("entity")
    bridge = near.join(middle, "entity", "left_semi").select("sid").distinct()
    none = all_.agg(F.count(F.lit(1)).alias("met")).filter("met = 0")
    chosen = all_.unionByName(bridge.join(F.broadcast(none), F.lit(True)).select("sid"))
    return chosen.join(chars, "sid").orderBy(F.col("chars").desc(), "sid").select("sid")


def spread(walk: DataFrame, seeds: DataFrame, steps: int = 3, decay: float = 0.6, most: int = 40) -> DataFrame:
    """RK-14: (entity, weight): the best decayed path from a seed in up to three steps; ``walk``: (src, dst)."""
    reached = seeds.select("entity", F.lit(1.0).alias("weight"))
    front = reached
    for _ in range(steps):
        front = front.join(walk, front["entity"] == walk["src"]).groupBy(F.col("dst").alias("entity")).agg(F.max(F.col("weight") * decay).alias("weight"))
        reached = checkpointed(reached.unionByName(front).groupBy("entity").agg(F.max("weight").alias("weight")))
    return reached.select("entity", F.round("weight", 6).alias("weight")).orderBy(F.col("weight").desc(), "entity").limit(most)
