"""Incremental learning over streams (ST-02, ST-03, and the event-time extension ST-01)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.records import CAP, FADE, FLOOR, SHARE, TRUST


def deduplicated_stream(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """ST-02: each key once, within the watermark, so that state stays bounded."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def sliding(events: DataFrame, at: str, by: str, size: str = "1 day", step: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """ST-01 extension: counts by sliding event-time windows."""
    out = events.withWatermark(at, delay).groupBy(F.window(at, size, step), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """ST-01 extension: runs of a key's events that no gap parts: (by, start, end, n)."""
    out = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed(events: DataFrame, at: str, by: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """ST-01 extension: counts and sums by event-time window, late data up to the watermark."""
    out = events.withWatermark(at, delay).groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def reinforced(claims: DataFrame) -> DataFrame:
    """ST-03: trust and witnesses of each (subject, value) as keyed state: a new source reinforces, a known one does not.

    The state of a key holds its sources and stays.  A key that is idle for a day of processing time fades by one step, down to the floor, and
    is given out again; a source that is known before is known after.
    """
    idle = 24 * 3600 * 1000

    def row(key: tuple, known: list, trust: float) -> pd.DataFrame:
        return pd.DataFrame({"subject": [key[0]], "value": [key[1]], "witnesses": [len(known)], "trust": [round(trust, 9)]})

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sources, level, trust = state.get if state.exists else ([], 0, 0.0)
        if state.hasTimedOut:
            faded = trust if len(sources) >= 2 or level >= 5 else max(min(trust, FLOOR), trust - FADE)
            state.update((list(sources), level, faded))
            if faded > FLOOR:
                state.setTimeoutDuration(idle)
            if faded < trust:
                yield row(key, sources, faded)
            return
        known = set(sources)
        for batch in batches:
            for source, grade in batch[["source", "level"]].itertuples(index=False):
                if grade > level:
                    level, trust = int(grade), max(trust, TRUST.get(int(grade), 0.3))
                if source not in known:
                    if known:
                        trust = min(CAP, trust + (1 - trust) * SHARE)
                    known.add(source)
        state.update((sorted(known), level, trust))
        state.setTimeoutDuration(idle)
        yield row(key, sorted(known), trust)

    return claims.groupBy("subject", "value").applyInPandasWithState(
        advance, "subject string, value string, witnesses int, trust double", "sources array<string>, level int, trust double", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def learn_into(stream: DataFrame, path: str, checkpoint: str):
    """ST-02: append a stream's sentences to the evidence table, batch by batch, each row once for a batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
