"""The row-local operators on streams, windowed summaries, keyed dedup and early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftcorpus.functions import text as T
from weftcorpus.operators.buckets import ErrorBucketing
from weftcorpus.operators.quality import QualityFilter
from weftcorpus.operators.scorers import FactualityEvaluator, SafetyEvaluator, TaskCompletionEvaluator
from weftcorpus.operators.training import after, effect_of


def scored(stream: DataFrame) -> DataFrame:
    """Responses with the scores of all dimensions and their error buckets; no state."""
    for part in (FactualityEvaluator(), TaskCompletionEvaluator(), SafetyEvaluator()):
        stream = part.score(stream)
    return ErrorBucketing().bucket(stream)


def kept(stream: DataFrame, rules: QualityFilter | None = None) -> DataFrame:
    return (rules or QualityFilter()).filter(stream)


def without_copies(stream: DataFrame, text: str = "text", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream without texts that it had within the watermark's delay; state is a digest a text."""
    return stream.withWatermark(time, delay).withColumn("_d", F.sha2(T.text(text), 256)).dropDuplicatesWithinWatermark(["_d"]).drop("_d")


def windowed_safety(stream: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Mean safety score and unsafe count of each window; late rows beyond the delay are left out."""
    rows = SafetyEvaluator().score(stream.withWatermark(time, delay))
    return rows.groupBy(F.window(time, window).alias("window")).agg(F.avg("safety_score").alias("mean_safety_score"), F.count_if(~F.col("is_safe")).alias("unsafe_count"), F.count("*").alias("total"))


def early_stops(stream: DataFrame, run: str = "run", step: str = "step", metric: str = "metric", patience: int = 3, min_delta: float = 1e-4, mode: str = "min", idle_ms: int = 3_600_000) -> DataFrame:
    """run, best, stopped, stop_step and steps, as they change (output mode update): early stopping of runs while their steps
    come in. A run's state is a best value and a few counts; it goes when the run has been silent for idle_ms.
    The steps of a run must come in order over micro-batches; within one they are put in order. A query that is to end by
    itself (trigger availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off: timeouts ask for batches without data."""
    sign = 1.0 if mode == "min" else -1.0

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, bad, stop, n = state.get if state.exists else (None, 0, None, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values([step, metric])
        values = (rows[metric].astype("float64") * sign).fillna(float("inf")).tolist()
        best, bad, stop = after((best, bad, stop), effect_of(values, rows[step].astype("int64").tolist(), patience, min_delta), patience, min_delta)
        state.update((best, bad, stop, n + len(rows)))
        state.setTimeoutDuration(idle_ms)
        shown = None if best is None or best == float("inf") else best * sign
        yield pd.DataFrame({run: [key[0]], "best": pd.Series([shown], dtype="float64"), "stopped": [stop is not None], "stop_step": pd.Series([stop], dtype="Int64"), "steps": [n + len(rows)]})

    kind = dict(stream.dtypes)[run]
    return stream.groupBy(run).applyInPandasWithState(update, f"`{run}` {kind}, best double, stopped boolean, stop_step long, steps long", "best double, bad long, stop long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
