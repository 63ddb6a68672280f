"""Data operators around training: rewards, batches, early stopping and checkpoints."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_advantage(df: DataFrame, *group: str, reward: str = "reward") -> DataFrame:
    """df with advantage: rewards normalised within a group by mean and sample deviation; null for a group of one."""
    w = Window.partitionBy(*group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + F.lit(1e-8)))


def mean_reward(df: DataFrame, step: str = "step", group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """The mean of the group means of each step."""
    return df.groupBy(step, group).agg(F.avg(reward).alias("m")).groupBy(step).agg(F.avg("m").alias("mean_reward"))


def scored_rewards(df: DataFrame, reward=None, seed: int = 42) -> DataFrame:
    """df with reward: reward(prompt, response), a column function, or seeded normal noise where none is given."""
    return df.withColumn("reward", reward(F.col("prompt"), F.col("response")) if reward else F.randn(seed))


def prompt_batches(df: DataFrame, batch_size: int, order: str = "row_id", prompt: str = "prompt") -> DataFrame:
    """prompt with batch, the number of its contiguous chunk. Offsets of ranges are
    counted first, so the order is never built in one task."""
    ranged = df.select(order, prompt).repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("lo")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    place = F.col("before") + F.col("_i") - F.col("lo")
    return ranged.join(F.broadcast(parts), "_p").select(order, prompt, F.floor(place / batch_size).alias("batch"))


def effect_of(values: list[float], steps: list[int], patience: int, min_delta: float) -> dict:
    """What consecutive steps do to early stopping, whatever came before; less is better.

    With `bad` steps without a gain behind it, a run stops in the first patience - bad steps of a stretch unless one of them
    is a gain. The first gain over an incoming best value is a new minimum of the stretch, and what follows hangs on which
    one it is. So the effect is the first steps and, of these, the minima, each with the state at the stretch's end."""
    n = len(values)
    # the state at the end, or the stop, when step i is the best: the next gain is at most patience steps ahead
    ends: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        ahead = next((j for j in range(i + 1, min(n, i + patience + 1)) if values[j] < values[i] - min_delta), None)
        ends[i] = ends[ahead] if ahead is not None else (values[i], patience, steps[i + patience]) if i + patience < n else (values[i], n - 1 - i, None)
    places = [i for i in range(min(n, patience)) if i == 0 or values[i] < min(values[:i])]
    best, bad, stop = zip(*(ends[i] for i in places)) if places else ((), (), ())
    return {"n": n, "heads": steps[:patience], "places": places, "values": [values[i] for i in places], "bests": list(best), "bads": list(bad), "stops": list(stop)}


def after(state: tuple, effect: dict, patience: int, min_delta: float) -> tuple:
    """(best, bad, stop) behind a stretch; best None: nothing came before."""
    best, bad, stop = state
    if stop is not None or not effect["n"]:
        return state
    for i, v, *end in zip(effect["places"], effect["values"], effect["bests"], effect["bads"], effect["stops"]):
        if bad + i < patience and (best is None or v < best - min_delta):
            return tuple(end)
    wait = bad + effect["n"]
    return (best, patience, effect["heads"][patience - bad - 1]) if wait >= patience else (best, wait, None)


_EFFECT = "first long, last long, n long, heads array<long>, places array<long>, values array<double>, bests array<double>, bads array<long>, stops array<long>"


def early_stop(steps: DataFrame, *run: str, patience: int = 3, min_delta: float = 1e-4, mode: str = "min", step: str = "step", metric: str = "metric", stretch: int = 10_000) -> DataFrame:
    """For each run: best, stopped and stop_step. The best value moves only by more than min_delta; a null metric is no gain.

    Runs are dealt in order over all tasks, so that a run of any length is many stretches. Each task turns its stretches
    into their effects, which are as small as patience; one pass over a run's effects gives the answer."""
    sign = 1.0 if mode == "min" else -1.0
    kinds = dict(steps.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in run)
    value = F.coalesce(F.col(metric).cast("double") * sign, F.lit(float("inf")))
    rows = steps.select(*run, F.col(step).cast("long").alias("_s"), value.alias("_v"))
    at = len(run)

    def effects(batches):
        own, names, values = None, [], []

        def close():
            e = effect_of(values, names, patience, min_delta)
            return [*own, names[0], names[-1], *e.values()]

        kind = None
        for batch in batches:
            out, kind = [], [batch.schema.field(i).type for i in range(at)]
            for *key, s, v in zip(*(c.to_pylist() for c in batch.columns)):
                if names and (key != own or len(names) >= stretch):
                    out.append(close())
                    names, values = [], []
                own = key
                names.append(s)
                values.append(v)
            if out:
                yield _effects(out, kind)
        if names:
            yield _effects([close()], kind)

    def _effects(out, kind):
        types = [*kind, pa.int64(), pa.int64(), pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*run, "first", "last", "n", "heads", "places", "values", "bests", "bads", "stops"])

    def fold(batches):
        own, state = None, (None, 0, None)

        def result(kind):
            best, _, stop = state
            best = None if best is None or best == float("inf") else best * sign
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(own, kind)), pa.array([best], pa.float64()), pa.array([stop is not None]), pa.array([stop], pa.int64())], [*run, "best", "stopped", "stop_step"])

        kind = None
        for batch in batches:
            kind = [batch.schema.field(i).type for i in range(at)]
            for row in batch.to_pylist():
                key = [row[c] for c in run]
                if own is not None and key != own:
                    yield result(kind)
                    state = (None, 0, None)
                own = key
                state = after(state, row, patience, min_delta)
        if own is not None:
            yield result(kind)

    dealt = rows.repartitionByRange(*run, "_s", "_v").sortWithinPartitions(*run, "_s", "_v")
    parts = dealt.mapInArrow(effects, ", ".join([*filter(None, [keys]), _EFFECT]))
    gathered = parts.repartition(*run) if run else parts.repartition(1)
    return gathered.sortWithinPartitions(*run, "first", F.get("values", F.lit(0)), "last").mapInArrow(fold, ", ".join([*filter(None, [keys]), "best double, stopped boolean, stop_step long"]))


def best_checkpoints(steps: DataFrame, *run: str, keep: int = 3, mode: str = "min", step: str = "step", metric: str = "metric") -> DataFrame:
    """The steps whose checkpoints stay, best first (place 1); ties keep the earlier step."""
    value = F.col(metric).asc() if mode == "min" else F.col(metric).desc()
    w = Window.partitionBy(*run).orderBy(value, step)
    return steps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
