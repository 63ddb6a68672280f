"""Evaluation of models in all dimensions, their overall score, comparison and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcorpus.operators.buckets import ErrorBucketing
from weftcorpus.operators.diversity import TemplateRateEvaluator
from weftcorpus.operators.scorers import FactualityEvaluator, SafetyEvaluator, TaskCompletionEvaluator
from weftcorpus.sources.shared import write_text

# What each dimension counts, and the score without any.
WEIGHTS = {"factuality": 0.30, "task_completion": 0.30, "safety": 0.25, "template_rate": 0.15}
NOTHING_SCORED = 3.0


def overall_score(factuality: Column | None = None, task_completion: Column | None = None, safety: Column | None = None, template_percentage: Column | None = None) -> Column:
    """The weighted mean of the dimensions that are there (given and not null); 3.0 if none is."""
    template = None if template_percentage is None else F.lit(5.0) * (F.lit(1.0) - template_percentage / 100)
    given = [(c, w) for c, w in zip((factuality, task_completion, safety, template), WEIGHTS.values()) if c is not None]
    if not given:
        return F.lit(NOTHING_SCORED)
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in given[1:]), F.coalesce(given[0][0] * given[0][1], F.lit(0.0)))
    weight = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in given[1:]), F.when(given[0][0].isNotNull(), F.lit(given[0][1])).otherwise(0.0))
    return F.when(weight > 0, total / F.greatest(weight, F.lit(1e-8))).otherwise(F.lit(NOTHING_SCORED))


@dataclass(frozen=True)
class EvalRunner:
    """Row-local scores of all dimensions share one scan and one aggregate; only the template metrics shuffle on their own."""

    factuality: FactualityEvaluator | None = field(default_factory=FactualityEvaluator)
    task: TaskCompletionEvaluator | None = field(default_factory=TaskCompletionEvaluator)
    template: TemplateRateEvaluator | None = field(default_factory=TemplateRateEvaluator)
    safety: SafetyEvaluator | None = field(default_factory=SafetyEvaluator)
    buckets: ErrorBucketing | None = field(default_factory=ErrorBucketing)
    output_dir: str = "reports"

    #: So many copies of a row are made at once.
    COPIES = 10_000

    def _distinct(self, df: DataFrame, model_field: str) -> DataFrame | None:
        """The distinct rows of what the built-in parts read, with _copies; None if a judge or a part of another kind reads more."""
        parts = [p for p in (self.factuality, self.task, self.safety, self.buckets) if p is not None]
        if any(type(p) not in (FactualityEvaluator, TaskCompletionEvaluator, SafetyEvaluator, ErrorBucketing) or getattr(p, "judge", None) for p in parts):
            return None
        fields = {v for p in parts for k, v in vars(p).items() if k.endswith("_field") and k != "id_field"} | {"question", "prompt", "response", "reference"}
        return df.groupBy(model_field, *sorted(c for c in fields if c in df.columns and c != model_field)).agg(F.count("*").alias("_copies"))

    def models(self, df: DataFrame, model_field: str = "model") -> DataFrame:
        """A row for each model with every summary and overall_score. Rows that read alike are scored once and counted as often as they are there."""
        distinct = self._distinct(df, model_field)
        rows, summaries = df if distinct is None else distinct, [F.count("*").alias("total")]
        for part in (self.factuality, self.task, self.safety):
            if part is not None:
                rows = part.score(rows)
                summaries += part.summary_columns()
        if self.buckets is not None:
            rows = self.buckets.bucket(rows)
            summaries += self.buckets.summary_columns()
        if distinct is not None:
            rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / self.COPIES))))
            rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(self.COPIES).cast("long"), F.col("_copies") - F.col("_block") * self.COPIES))))
        out = rows.groupBy(model_field).agg(*summaries)
        if self.template is not None:
            out = out.join(self.template.evaluate(df, model_field), model_field, "left")
        return out.withColumn(
            "overall_score",
            overall_score(
                F.col("mean_factuality_score") if self.factuality else None,
                F.col("mean_task_completion_score") if self.task else None,
                F.col("mean_safety_score") if self.safety else None,
                F.coalesce("template_rate_percentage", F.lit(0.0)) if self.template else None,
            ),
        )

    def run_single_model(self, df: DataFrame, model_name: str) -> DataFrame:
        return self.models(df.withColumn("model", F.lit(model_name)))

    def comparison(self, results: DataFrame, order: list[str] | None = None, model_field: str = "model") -> DataFrame:
        """model, overall_score and the four scores (null where not scored), best first; ties in the given order, then by name."""
        place = F.coalesce(*[F.when(F.col(model_field) == m, F.lit(i)) for i, m in enumerate(order or [])], F.lit(len(order or [])))
        has = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("double")
        return results.select(
            F.col(model_field).alias("model"), "overall_score", has("mean_factuality_score").alias("factuality_score"), has("mean_task_completion_score").alias("task_completion_score"),
            has("mean_safety_score").alias("safety_score"), has("template_rate_percentage").alias("template_rate_percent"), place.alias("place"),
        ).orderBy(F.desc("overall_score"), "place", "model").drop("place")

    def best_model(self, results: DataFrame, model_field: str = "model") -> DataFrame:
        return results.agg(F.max_by(model_field, F.struct("overall_score", F.col(model_field))).alias("best_model"), F.max("overall_score").alias("overall_score"))

    def compare_models(self, datasets: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(results, comparison) of several models' records."""
        parts = [d.withColumn("model", F.lit(m)) for m, d in datasets.items()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        results = self.models(rows)
        return results, self.comparison(results, list(datasets))

    def run(self, df: DataFrame, model_name: str, save_report: bool = True) -> dict:
        result = self.run_single_model(df, model_name).first()
        out = result.asDict(recursive=True) if result else {"model": model_name, "overall_score": NOTHING_SCORED}
        if save_report:
            out["report"] = self.report(out, f"eval_{model_name}")
        return out

    def report(self, result: dict, name: str = "eval_report") -> dict[str, str]:
        """Writes a JSON and a Markdown report of a model's row, or of {'comparison_table': rows, 'best_model': name}."""
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        paths = {kind: f"{self.output_dir}/{name}_{stamp}.{suffix}" for kind, suffix in (("json", "json"), ("markdown", "md"))}
        write_text(paths["json"], json.dumps(result, ensure_ascii=False, indent=2, default=str))
        write_text(paths["markdown"], markdown(result))
        return paths


#: Titles of the report's rows and the columns that they show.
_DIMENSIONS = {"事实": "mean_factuality_score", "任务": "mean_task_completion_score", "安全": "mean_safety_score"}


def _table(head: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in (head, ("---",) * len(head), *rows))


def markdown(result: dict) -> str:
    """The report of one model or of a comparison."""
    show = lambda v, f="{:.2f}": "N/A" if v is None else f.format(v)
    head = f"# 导购回答评分\n\n生成于 {datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S} UTC\n\n"
    if "comparison_table" in result:
        columns = ("overall_score", "factuality_score", "task_completion_score", "safety_score", "template_rate_percent")
        table = _table(("名称", "总分", *_DIMENSIONS, "套话 %"), [(r["model"], *(show(r.get(c)) for c in columns)) for r in result["comparison_table"]])
        return f"{head}## 各模型\n\n{table}\n\n最好的是 {result.get('best_model', 'N/A')}"
    rows = [(title, show(result[c])) for title, c in _DIMENSIONS.items() if c in result]
    if "template_rate_percentage" in result:
        rows.append(("套话", show(result["template_rate_percentage"], "{:.1f}%")))
    return f"{head}## {result.get('model')}\n\n总分 {show(result.get('overall_score'))}，满分 5.00\n\n{_table(('方面', '得分'), rows)}"
