"""Leaderboards, baselines, statistics and costs of experiments."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcorpus.functions import distributions as D

#: The columns of a leaderboard and where a benchmark document has them.
SUMMARY = {
    "overall_score": "metrics.overall_score", "factuality": "metrics.factuality", "task_completion": "metrics.task_completion", "safety": "metrics.safety", "template_rate": "metrics.template_rate", "gpu_hours": "training_cost.gpu_hours",
    "peak_vram_gb": "training_cost.peak_vram_gb", "latency_ms_p95": "inference.latency_ms_p95", "throughput_tok_per_s": "inference.throughput_tok_per_s",
}


def leaderboard(benchmark: DataFrame) -> DataFrame:
    """A row for each entry of the models map, best overall score first."""
    rows = benchmark.select(F.explode("models").alias("model", "m"))
    return rows.select("model", F.coalesce("m.display_name", "model").alias("display_name"), *[F.col(f"m.{p}").alias(c) for c, p in SUMMARY.items()]).orderBy(F.desc(F.coalesce("overall_score", F.lit(0.0))), "model")


def error_shares(df: DataFrame, model: str = "model", count: str = "n") -> DataFrame:
    """df with share: a count's part of its model's total."""
    total = F.sum(count).over(Window.partitionBy(model))
    return df.withColumn("share", F.col(count) / total)


def transposed(df: DataFrame, key: str, values: list[str], names: list[str]) -> DataFrame:
    """metric and a column for each of names: rows and columns of a small table changed over."""
    long = df.unpivot(key, values, "metric", "value")
    return long.groupBy("metric").pivot(key, names).agg(F.first("value"))


def diversity_score(rate_percent: Column) -> Column:
    """A template rate in per cent on the scale from 0 to 5, more is more diverse."""
    return (F.lit(100) - rate_percent) / 20


def best_flags(df: DataFrame, columns: list[str], least: tuple[str, ...] = ("template_rate",), by: tuple[str, ...] = (), most_groups: int = 100_000) -> DataFrame:
    """df with {column}_best: whether a value is the best of its column. For leaderboards: by empty compares all rows.
    The best of a group travel to its rows; the groups are broadcast only while they are few. Null groups are one group."""
    best = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(*[(F.min if c in least else F.max)(c).alias(f"_{c}") for c in columns])
    if by:
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        both = df.join(F.broadcast(best) if best.count() <= most_groups else best, same)
    else:
        both = df.crossJoin(F.broadcast(best))  # one row
    return both.withColumns({f"{c}_best": F.col(c) == F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns], *[f"_by_{c}" for c in by])


def against_baseline(df: DataFrame, baseline: str, columns: list[str], model: str = "model") -> DataFrame:
    """A row for each other model and metric: value, baseline, absolute and relative change in per cent."""
    long = df.select(model, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(model, columns, "metric", "value")
    base = long.where(F.col(model) == baseline).select("metric", F.col("value").alias("baseline"))
    change = F.col("value") - F.col("baseline")
    return long.where(F.col(model) != baseline).join(base, "metric").withColumns({"absolute": change, "relative_percent": F.when(F.col("baseline") != 0, change / F.col("baseline") * 100)})


def efficiency(df: DataFrame, score: str = "overall_score", cost: str = "gpu_hours") -> DataFrame:
    """df with efficiency, the score a unit of cost, best first."""
    return df.withColumn("efficiency", F.when(F.col(cost) != 0, F.col(score) / F.col(cost))).orderBy(F.desc("efficiency"))


def convergence_step(steps: DataFrame, threshold: float = 1.8, by: str = "experiment_id", value: str = "eval_loss") -> DataFrame:
    """The first step of each run whose value is under the threshold; null if there is none."""
    return steps.groupBy(by).agg(F.min(F.when(F.col(value) < threshold, F.col("step"))).alias("convergence_step"))


def paired_effect(pairs: DataFrame, a: str, b: str, *by: str, level: float = 0.95) -> DataFrame:
    """paired_t() with p_value (two-sided), effect_size (the mean difference in its standard deviations) and the
    confidence interval of the mean difference (ci_low, ci_high)."""
    sums = _paired(pairs, a, b, *by)
    reach = D.t_quantile(level, F.col("dof")) * F.col("_s") / F.sqrt("n")
    return sums.withColumns({"p_value": D.t_p_value(F.col("t"), F.col("dof")), "effect_size": F.col("t") / F.sqrt("n"), "ci_low": F.col("mean_difference") - reach, "ci_high": F.col("mean_difference") + reach}).drop("_s")


def anova_effect(df: DataFrame, group: str, value: str) -> DataFrame:
    """anova_f() with p_value and eta_squared, the share of the variance that lies between the groups."""
    out = anova_f(df, group, value)
    between = F.col("f") * F.col("dof_between")
    return out.withColumns({"p_value": D.f_p_value(F.col("f"), F.col("dof_between"), F.col("dof_within")), "eta_squared": between / (between + F.col("dof_within"))})


def _paired(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    sums = pairs.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"))
    return sums.withColumns({"t": F.when(F.col("_s") > 0, F.col("mean_difference") / (F.col("_s") / F.sqrt("n"))), "dof": F.col("n") - 1})


def paired_t(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """n, mean_difference, t and degrees of freedom of the paired t-test of a against b; null with fewer than two pairs."""
    return _paired(pairs, a, b, *by).drop("_s")


def anova_f(df: DataFrame, group: str, value: str) -> DataFrame:
    """F statistic and degrees of freedom of a one-way analysis of variance, from sums of each group."""
    x = F.col(value).cast("double")
    g = df.where(x.isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("v"))
    n, k = F.sum("n"), F.count("*")
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    within = F.sum(F.col("n") * F.col("v"))
    one = g.agg(k.alias("groups"), n.alias("n"), between.alias("between"), within.alias("within"))
    return one.select((F.col("groups") - 1).alias("dof_between"), (F.col("n") - F.col("groups")).alias("dof_within"), F.when((F.col("groups") > 1) & (F.col("n") > F.col("groups")) & (F.col("within") > 0), (F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))).alias("f"))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic."""
    return _incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def f_p_value(f: float, between: float, within: float) -> float:
    return _incomplete_beta(within / 2, between / 2, within / (within + between * f))
