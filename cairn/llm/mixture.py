"""Mixing sources to target weights.

Tokens are summed for each source, the repetition rate of a source follows from its target
share, and each document comes out floor(rate) times plus once more with the probability of the rate's
fraction, decided by a hash of its id: the same documents on any cluster, in any order.  Documents of wanted sources are
tokenised once; the rates, one row a target, go to the documents, so no text is shuffled or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.tokens import RANK_FILE, token_counter
from cairn.session import checkpointed

SEED = 20240229


def wanted_sources(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row a source: null or negative shares count as 0, a null cap as 1."""
    return targets.filter("source is not null").select(
        "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"),
    ).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def sized(docs: DataFrame, targets: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """(doc_id, source, text, n_tokens) of the documents of wanted sources, counted once and written to the shared folder.

    The list of targets is a setting, a row a source, and is what is broadcast.
    """
    count = token_counter(docs.sparkSession, rank_file)
    used = docs.select("doc_id", "source", "text").join(F.broadcast(wanted_sources(targets).select("source")), "source", "left_semi")
    return checkpointed(used.withColumn("n_tokens", count("text")))


def source_tokens(counted: DataFrame) -> DataFrame:
    """(source, docs, tokens) of counted documents; summed where they are read."""
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """One row for each target: its share, what is there, its cap, the repetition rate and the tokens it lacks.

    The total size is ``total_tokens``, without it that of all documents of the targets' sources.  A source's rate stops at its cap:
    what its share then lacks is ``shortfall``.  With ``exact`` the total is the largest in which every source that has documents
    holds its share and none exceeds its cap.  Shares of targets without documents go to the others in proportion.
    """
    known = wanted_sources(targets).join(sizes, "source", "left").fillna({"docs": 0, "tokens": 0})
    there = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    # one row: how much of the shares is reachable, all tokens, and the largest total that the caps allow
    whole = known.filter(there).agg(
        F.sum("target_share").alias("reachable"), F.sum("tokens").cast("double").alias("all_tokens"),
        F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("most"),
    )
    whole = known.join(F.broadcast(whole), F.lit(True), "left")
    share = F.when(there, F.col("target_share") / F.col("reachable")).otherwise(0.0)
    total = F.col("most") * F.col("reachable") if exact else F.lit(float(total_tokens)) if total_tokens is not None else F.col("all_tokens")
    rate = F.when(there, F.least(F.col("max_repeats").cast("double"), share * total / F.col("tokens"))).otherwise(0.0)
    lacks = F.when(there, F.greatest(share * total - F.col("max_repeats") * F.col("tokens"), F.lit(0.0))).otherwise(0.0)
    return whole.select("source", "target_share", share.alias("reachable_share"), "max_repeats", "docs", "tokens", rate.alias("rate"), F.round(lacks, 1).alias("shortfall"))


def copies(key: F.Column, rate: F.Column, seed: int = SEED) -> F.Column:
    """How many times a document comes out: floor(rate), and once more by its hash."""
    chance = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return (whole + (chance < rate - whole).cast("long")).cast("int")


def drawn(counted: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copies, n_tokens, text) of each counted document that the mixture uses at all."""
    rated = plan.filter("rate > 0").select("source", "rate")
    return (
        counted.join(F.broadcast(rated), "source")
        .withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed)).filter("copies > 0").drop("rate")
    )


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, rank_file: str = RANK_FILE, exact: bool = False) -> DataFrame:
    """The mixture itself: (doc_id, source, copy, n_tokens, text), one row for each use of a document.

    Documents of no source, of a source without target, or without tokens' worth of share are not used.
    """
    counted = sized(docs, targets, rank_file)
    used = drawn(counted, rates(source_tokens(counted), targets, total_tokens, exact))
    return used.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "source", "copy", "n_tokens", "text")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, rank_file: str = RANK_FILE, exact: bool = False) -> DataFrame:
    """The report: for each target its share asked for and reached, its rate, documents and tokens used, and its shortfall.

    Targets without documents are reported with an actual share of 0.
    """
    counted = sized(docs, targets, rank_file)
    plan = rates(source_tokens(counted), targets, total_tokens, exact)
    used = (
        drawn(counted, plan).groupBy("source").agg(
            F.count(F.lit(1)).alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"),
            F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"),
        )
    )
    joined = plan.join(used, "source", "left").fillna({"docs_used": 0, "copies": 0, "most_copies": 0, "tokens_used": 0})
    total = joined.agg(F.sum("tokens_used").alias("mixed"))
    actual = F.when(F.col("mixed") > 0, F.col("tokens_used") / F.col("mixed")).otherwise(0.0)
    return joined.join(F.broadcast(total), F.lit(True)).select(
        "source", "target_share", "reachable_share", actual.alias("actual_share"), "max_repeats", "rate", "docs", "tokens",
        "docs_used", "copies", "most_copies", "tokens_used", "shortfall",
    )


def limits(report: DataFrame) -> DataFrame:
    """What a report must keep: no document beyond its cap, and shares that make a whole."""
    total = report.agg((F.abs(F.sum("actual_share") - 1) < 1e-9).alias("whole"))
    return report.join(F.broadcast(total), F.lit(True)).select(
        "source", "target_share", "max_repeats", "docs", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), "whole", (F.col("rate") > 0).alias("used"))
