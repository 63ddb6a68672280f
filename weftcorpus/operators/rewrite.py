"""Style rewriting with a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T


def prompt(t: Column, style: Column) -> Column:
    """The style's prompt for a text; an unknown style counts as rules.FALLBACK_STYLE."""
    templates = F.create_map(*[F.lit(x) for kv in rules.REWRITE_STYLES.items() for x in kv])
    chosen = F.coalesce(F.element_at(templates, style), F.lit(rules.REWRITE_STYLES[rules.FALLBACK_STYLE]))
    return F.replace(chosen, F.lit("{text}"), t)


@dataclass(frozen=True)
class TemplateRewriter:
    """generate maps a prompt column to a text column (a pandas_udf around a model,
    for instance). Without it what follows the prompt's last mark is taken, which is
    empty, fails the check and leaves the response as it is."""

    generate: Callable[[Column], Column] | None = None
    styles: tuple[str, ...] = ("colloquial", "professional", "concise")
    response_field: str = "response"
    id_field: str = "row_id"
    seed: int = 42

    def rewrite(self, df: DataFrame) -> DataFrame:
        """df with rewritten responses and rewrite_style (null for empty responses)."""
        old = T.text(self.response_field)
        place = F.pmod(F.xxhash64(F.col(self.id_field), F.lit(self.seed)), F.lit(len(self.styles))) + 1
        style = F.element_at(F.array(*map(F.lit, self.styles)), place.cast("int"))
        asked = prompt(old, F.col("rewrite_style"))
        made = self.generate(asked) if self.generate else F.substring_index(asked, rules.REWRITE_MARK, -1)
        length, before = T.stripped_length(F.col("_new")), T.stripped_length(old)
        good = (length >= 10) & (T.safe_ratio(length, before) >= 0.3) & (T.safe_ratio(length, before) <= 3.0)
        out = df.withColumn("rewrite_style", F.when(old != "", style)).withColumn("_new", F.when(old != "", T.strip(T.text(made))))
        return out.withColumn(self.response_field, F.when(good, F.col("_new")).otherwise(F.col(self.response_field))).drop("_new")

    def observed(self, df: DataFrame, observation: Observation) -> DataFrame:
        """rewrite() whose statistics the observation gets when the result is computed."""
        old, new = T.text("_old"), T.text(self.response_field)
        out = self.rewrite(df.withColumn("_old", F.col(self.response_field)))
        counts = [F.count_if((old != new) & (F.col("rewrite_style") == s)).alias(s) for s in self.styles]
        return out.observe(observation, F.count(F.lit(1)).alias("total"), *counts).drop("_old")

    def summary(self, got: dict) -> dict:
        styles = {s: got[s] for s in self.styles}
        done = sum(styles.values())
        return {"total": got["total"], "success_count": done, "fail_count": got["total"] - done, "style_distribution": styles}

    def stats(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """One row: total, success_count (rewrites that changed the text), fail_count and style_distribution, the successes of each style, zeros too."""
        pair = before.select(F.col(self.id_field).alias("i"), T.text(self.response_field).alias("a")).join(after.select(F.col(self.id_field).alias("j"), T.text(self.response_field).alias("b"), "rewrite_style"), F.col("i") == F.col("j"))
        changed = F.col("a") != F.col("b")
        counts = [F.count_if(changed & (F.col("rewrite_style") == s)).alias(s) for s in self.styles]
        one = pair.agg(F.count("*").alias("total"), F.count_if(changed).alias("success_count"), *counts)
        return one.select("total", "success_count", (F.col("total") - F.col("success_count")).alias("fail_count"), F.create_map(*[x for s in self.styles for x in (F.lit(s), F.col(s))]).alias("style_distribution"))
