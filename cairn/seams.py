"""Callable seams: encoder, judge, engine, extraction, batch map (UD-01 .. UD-07, EN-01, CV-08).

No model is part of the package; every seam is a plain Python callable that is run in Arrow batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EngineMissing(RuntimeError):
    """Asked for an engine where none is attached."""


def null_engine(prompt: str) -> str:
    raise EngineMissing("no engine is attached")


def encoded(texts: Column, encode: Callable[[list[str]], list[list[float]]]) -> Column:
    """UD-01: vectors of a text column; null texts have none."""
    def run(batch: pd.Series) -> pd.Series:
        known = batch.dropna()
        made = dict(zip(known.index, encode(known.tolist()))) if len(known) else {}
        return pd.Series([made.get(i) for i in batch.index])

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(texts)


def judged(kind: str, question: Column, answer: Column, evidence: Column, judge: Callable[..., float | None]) -> Column:
    """UD-03, GT-16: the probability a judge gives, or null; an exception is null too."""
    def run(q: pd.Series, a: pd.Series, e: pd.Series) -> pd.Series:
        out = []
        for row in zip(q, a, e):
            try:
                out.append(judge(kind, *row))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(question, answer, evidence)


def asked(prompts: Column, engine: Callable[[str], str] = null_engine, remembered: int = 256) -> Column:
    """UD-06: an engine's reply; equal prompts of a batch are asked once."""
    def run(batch: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        for p in batch.dropna():
            if p not in memo:
                if len(memo) >= remembered:
                    memo.pop(next(iter(memo)))
                memo[p] = engine(p)
        return batch.map(lambda p: None if p is None else memo[p] if p in memo else engine(p))

    return F.pandas_udf(run, T.StringType())(prompts)


def extracted(rows: DataFrame, key: str, text: str, extract: Callable[[str], list[tuple[str, str, str]]]) -> DataFrame:
    """UD-07: (key, subject, predicate, value): none to many triples of a text; kept where the value is grounded in it (GT-11)."""
    from cairn.operators.check import grounded_in

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, t, *triple) for k, t in batch.itertuples(index=False) if t for triple in extract(t)]
            yield pd.DataFrame(out, columns=["key", "text", "subject", "predicate", "value"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key), F.col(text)).mapInPandas(run, f"key {kind}, text string, subject string, predicate string, value string")
    return found.filter(grounded_in(F.col("value"), F.col("text"))).select(F.col("key").alias(key), "subject", "predicate", "value")


def prompt(facts: Column, question: Column) -> Column:
    """EN-01: the frame of a question with its facts."""
    return F.concat(F.lit("FACTS:\n"), F.coalesce(facts, F.lit("")), F.lit("\n\nQUESTION: "), F.coalesce(question, F.lit("")))
