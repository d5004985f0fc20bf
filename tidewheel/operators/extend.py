"""Extension points: user functions per frame, per series, per candidate, and row generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_signal(frames: DataFrame, name: str, value: Column | Callable[..., pd.Series], inputs: Sequence[str] = (),
                kind: str = "double") -> DataFrame:
    """Add a per-frame signal: a column expression, or a vectorised function of the input columns."""
    if isinstance(value, Column):
        return frames.withColumn(name, value)
    return frames.withColumn(name, F.pandas_udf(value, kind)(*inputs))


def run_program(frames: DataFrame, keys: Sequence[str], order: str, start: Callable[[], object],
                step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A stateful program per series: `step(state, batch)` sees the series in order, in batches, and
    keeps its state between them. The series streams through its task; it is never held whole."""
    def walk(batches):
        state = start()
        for pdf in batches:
            yield step(state, pdf)

    walk.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    ordered = frames.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, order)
    return ordered.groupBy(*keys).applyInPandas(walk, schema)


def score_candidates(rows: DataFrame, score: Callable[..., pd.Series], inputs: Sequence[str], out: str = "score") -> DataFrame:
    """A score per (series, candidate) row; rows are independent, so they spread over the cluster."""
    return rows.withColumn(out, F.pandas_udf(score, "double")(*inputs))


def register_bars(spark: SparkSession, name: str = "bars") -> None:
    """`bars(downbeat, bar_seconds, duration)` for SQL: one row per bar line inside the song."""
    from pyspark.sql.functions import udtf

    class Bars:
        def eval(self, downbeat: float, bar_seconds: float, duration: float):
            bar = 1 - int(downbeat // bar_seconds)
            t = downbeat + (bar - 1) * bar_seconds
            while t < duration:
                yield bar, t
                bar, t = bar + 1, downbeat + bar * bar_seconds

    spark.udtf.register(name, udtf(Bars, returnType="bar: int, t: double"))
