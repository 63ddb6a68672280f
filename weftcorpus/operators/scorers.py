"""Scores of single responses: factuality, task completion and safety.

Rule scores are column expressions. A judge is a function from a prompt column to
a column with its answer (a pandas_udf around a model); its scores are parsed natively.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T
from weftcorpus.operators.models import parse_status

Judge = Callable[[Column], Column]


def question(df: DataFrame) -> Column:
    """question, or prompt where the question column is missing."""
    return T.text("question") if "question" in df.columns else T.text("prompt") if "prompt" in df.columns else F.lit("")


def _field(df: DataFrame, name: str) -> Column:
    return T.text(name) if name in df.columns else F.lit("")


def with_id(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """df whose id falls back to the row's own number."""
    if "id" in df.columns:
        return df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.col(row_id).cast("string")))
    return df.withColumn("id", F.col(row_id).cast("string"))


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


# Factuality


def factuality_rule(r: Column) -> Column:
    """3.0, less for every uncertain word, more for a price; the order of operations is that of the words."""
    score = F.lit(3.0)
    for w in rules.UNCERTAIN_WORDS:
        score = score - F.when(r.contains(w), F.lit(0.3)).otherwise(F.lit(0.0))
    score = score + F.when(r.rlike(T.rx(rules.PRICE_MENTION)), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.least(F.greatest(score, F.lit(1.0)), F.lit(5.0))


def entities(c: Column) -> Column:
    """Prices and bare numbers of a text, distinct."""
    return F.array_distinct(F.concat(T.found_all(c, rules.ENTITY_PRICE), T.found_all(c, rules.ENTITY_NUMBER)))


def entity_accuracy(response: Column, reference: Column) -> Column:
    r, s = entities(reference), entities(response)
    return F.when((reference == "") | (F.size(r) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(r, s)) / F.size(r))


def factuality_prompt(q: Column, response: Column, reference: Column) -> Column:
    return _filled(rules.FACTUALITY_PROMPT, question=q, response=response, reference=F.when(reference == "", rules.NO_REFERENCE).otherwise(reference))


def parsed_score(answer: Column, pattern: str = rules.JUDGE_SCORE, default: float = 3.0) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(T.text(answer), T.rx(pattern), 1), F.lit("")).cast("double"), F.lit(default))


@dataclass(frozen=True)
class FactualityEvaluator:
    """With a judge there is a column more, judge_status: how its answer could be read."""

    judge: Judge | None = None

    def score(self, df: DataFrame) -> DataFrame:
        r, ref = _field(df, "response"), _field(df, "reference")
        if self.judge:
            df = df.withColumn("_answer", self.judge(factuality_prompt(question(df), r, ref)))
            score = parsed_score(F.col("_answer"))
            return df.withColumns({"factuality_score": score, "entity_accuracy": entity_accuracy(r, ref), "judge_status": parse_status(F.col("_answer"))}).drop("_answer")
        score = factuality_rule(r)
        return df.withColumns({"factuality_score": score, "entity_accuracy": entity_accuracy(r, ref)})

    @staticmethod
    def summary_columns() -> list[Column]:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        s = F.col("factuality_score")
        distribution = F.create_map(*[x for k in range(1, 6) for x in (F.lit(str(k)), F.count_if(s == float(k)))])
        return [zero(F.avg(s)).alias("mean_factuality_score"), zero(F.stddev_pop(s)).alias("std_factuality_score"), zero(F.avg("entity_accuracy")).alias("mean_entity_accuracy"), distribution.alias("score_distribution")]

    def evaluate(self, df: DataFrame, *by: str) -> DataFrame:
        return self.score(df).groupBy(*by).agg(*self.summary_columns(), F.count("*").alias("total"))


# Task completion


def need_understanding(q: Column, r: Column) -> Column:
    words = F.array_distinct(T.found_all(q, rules.KEYWORD_RUN))
    common = F.size(F.array_intersect(words, T.found_all(r, rules.KEYWORD_RUN)))
    return F.when(F.size(words) == 0, F.lit(3.0)).otherwise(F.lit(1.0) + F.lit(4.0) * (common / F.size(words)))


def recommendation_relevance(r: Column) -> Column:
    return F.when(T.contains_any(r, rules.RECOMMEND_WORDS), F.lit(4.0)).otherwise(F.lit(3.0))


def information_completeness(r: Column) -> Column:
    n = sum((r.rlike(T.rx(p)).cast("int") for p in rules.INFORMATION_SIGNALS), F.lit(0))
    return F.least(F.lit(5.0), F.lit(2.0) + n)


def task_prompt(q: Column, r: Column) -> Column:
    return _filled(rules.TASK_PROMPT, question=q, response=r)


TASK_SCORES = ("need_understanding", "recommendation_relevance", "information_completeness")


@dataclass(frozen=True)
class TaskCompletionEvaluator:
    judge: Judge | None = None

    def score(self, df: DataFrame) -> DataFrame:
        q, r = question(df), _field(df, "response")
        mean = (F.col(TASK_SCORES[0]) + F.col(TASK_SCORES[1]) + F.col(TASK_SCORES[2])) / 3
        if self.judge:
            df = df.withColumn("_answer", self.judge(task_prompt(q, r)))
            # the overall score's mark stands for the answer
            out = df.withColumns({k: parsed_score(F.col("_answer"), p) for k, p in rules.TASK_JUDGE_SCORES.items()} | {"task_judge_status": parse_status(F.col("_answer"), rules.TASK_JUDGE_SCORES["overall"])}).drop("_answer")
            # an overall of exactly 3.0 can't be told from a missing one
            return out.withColumn("task_completion_score", F.when(F.col("overall") == 3.0, mean).otherwise(F.col("overall"))).drop("overall")
        scores = dict(zip(TASK_SCORES, (need_understanding(q, r), recommendation_relevance(r), information_completeness(r))))
        return df.withColumns(scores).withColumn("task_completion_score", mean)

    @staticmethod
    def summary_columns() -> list[Column]:
        return [F.avg(c).alias(f"mean_{c}") for c in (*TASK_SCORES, "task_completion_score")]

    def evaluate(self, df: DataFrame, *by: str) -> DataFrame:
        return self.score(df).groupBy(*by).agg(*self.summary_columns(), F.count("*").alias("total"))


# Safety


@dataclass(frozen=True)
class SafetyEvaluator:
    """custom_rules replace built-in groups of the same name and add others."""

    response_field: str = "response"
    custom_rules: dict = field(default_factory=dict, hash=False)

    @property
    def rules(self) -> dict:
        return {**rules.SAFETY, **self.custom_rules}

    def score(self, df: DataFrame) -> DataFrame:
        """df with violations (rule -> matches, description, severity), safety_score, is_safe and max_severity."""
        r = _field(df, self.response_field)
        found = {k: F.when(T.matches_any(r, v["patterns"]), F.concat(*[T.found_all(r, p) for p in v["patterns"]])).otherwise(F.expr("cast(array() as array<string>)")) for k, v in self.rules.items()}
        out = df.withColumns({f"_m_{k}": c for k, c in found.items()})
        entries = F.array(*[F.struct(F.lit(k).alias("key"), F.struct(F.col(f"_m_{k}").alias("matches"), F.lit(v.get("description", "")).alias("description"), F.lit(v["severity"]).alias("severity")).alias("value")) for k, v in self.rules.items()])
        hit = F.filter(entries, lambda e: F.size(e["value"]["matches"]) > 0)
        ranks = list(rules.SEVERITY_SCORES)
        worst = F.array_min(F.transform(F.col("_hit"), lambda e: F.array_position(F.array(*map(F.lit, ranks)), e["value"]["severity"])))
        scores = F.array(*[F.lit(x) for x in rules.SEVERITY_SCORES.values()])
        place = worst.cast("int")
        out = out.withColumn("_hit", hit).withColumns(
            {
                "violations": F.map_from_entries("_hit"),
                "is_safe": F.size("_hit") == 0,
                "max_severity": F.when(F.size("_hit") > 0, F.get(F.array(*map(F.lit, ranks)), place - 1)).otherwise(F.lit("safe")),
                "safety_score": F.when(F.size("_hit") > 0, F.get(scores, place - 1)).otherwise(F.lit(rules.SAFE_SCORE)),
            }
        )
        return out.drop("_hit", *[f"_m_{k}" for k in self.rules])

    def summary_columns(self) -> list[Column]:
        counts = F.create_map(*[x for k in self.rules for x in (F.lit(k), F.count_if(F.map_contains_key("violations", k)))])
        safe = F.count_if("is_safe")
        return [F.coalesce(F.avg("safety_score"), F.lit(rules.SAFE_SCORE)).alias("mean_safety_score"), safe.alias("safe_count"), F.count_if(~F.col("is_safe")).alias("unsafe_count"), T.safe_ratio(safe, F.count("*")).alias("safety_rate"), counts.alias("violation_counts")]

    def evaluate(self, df: DataFrame, *by: str) -> DataFrame:
        return self.score(df).groupBy(*by).agg(*self.summary_columns(), F.count("*").alias("total"))
