"""Rule filters: the first failing rule gives a row's reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftcorpus.functions import text as T


@dataclass(frozen=True)
class QualityFilter:
    """Bounds are inclusive for lengths (of the stripped text) and ratios (of the whole text)."""

    min_length: int = 20
    max_length: int = 8192
    max_repetition_ratio: float = 0.3
    max_special_char_ratio: float = 0.2
    require_qa_pair: bool = False
    prompt_field: str = "prompt"
    response_field: str = "response"
    text_field: str = "text"
    ngram_size: int = 4

    def text(self) -> Column:
        if self.require_qa_pair:
            return F.concat(T.text(self.prompt_field), F.lit(" "), T.text(self.response_field))
        return T.text(self.text_field)

    def flagged(self, df: DataFrame) -> DataFrame:
        """df with n_chars (stripped), repetition, special and reason_code (null: kept)."""
        t = self.text()
        out = df.withColumns({"n_chars": T.stripped_length(t), "repetition": T.repetition_ratio(t, self.ngram_size), "special": T.special_ratio(t)})
        reason = F.when(F.lit(False), F.lit(""))
        if self.require_qa_pair:
            reason = reason.when(T.stripped_length(T.text(self.prompt_field)) == 0, "empty_prompt").when(T.stripped_length(T.text(self.response_field)) == 0, "empty_response")
        reason = (
            reason.when(F.col("n_chars") == 0, "empty_text")
            .when(F.col("n_chars") < self.min_length, "too_short")
            .when(F.col("n_chars") > self.max_length, "too_long")
            .when(F.col("repetition") > self.max_repetition_ratio, "repetition")
            .when(F.col("special") > self.max_special_char_ratio, "special_chars")
        )
        return out.withColumn("reason_code", reason)

    def filter(self, df: DataFrame) -> DataFrame:
        return self.flagged(df).where("reason_code IS NULL").select(*df.columns)

    #: In the order in which they are tried.
    REASONS = ("empty_prompt", "empty_response", "empty_text", "too_short", "too_long", "repetition", "special_chars")

    def observed(self, df: DataFrame, observation: Observation) -> DataFrame:
        """filter() whose statistics the observation gets when the result is computed; no pass of their own."""
        counts = [F.count_if(F.col("reason_code") == r).alias(r) for r in self.REASONS]
        return self.flagged(df).observe(observation, F.count(F.lit(1)).alias("original_count"), *counts).where("reason_code IS NULL").select(*df.columns)

    def summary(self, got: dict) -> dict:
        """What stats() gives, from an observation's values."""
        n, reasons = got["original_count"], {r: got[r] for r in self.REASONS if got[r]}
        removed = sum(reasons.values())
        return {"original_count": n, "filtered_count": n - removed, "removed_count": removed, "filter_ratio": removed / max(n, 1), "filter_reasons": reasons}

    def stats(self, df: DataFrame) -> DataFrame:
        """One row: original_count, filtered_count (kept), removed_count, filter_ratio, filter_reasons."""
        counts = self.flagged(df).groupBy("reason_code").agg(F.count("*").alias("n"))
        total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("reason_code").isNull(), F.col("n"))), F.lit(0))
        reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason_code").isNotNull(), F.struct("reason_code", "n")))))
        return counts.agg(total.alias("original_count"), kept.alias("filtered_count"), (total - kept).alias("removed_count"), T.safe_ratio(total - kept, total).alias("filter_ratio"), reasons.alias("filter_reasons"))

    def message(self) -> Column:
        """The reason with its value, as text, for a row of flagged()."""
        return (
            F.when(F.col("reason_code") == "too_short", F.format_string(f"文本过短: %d < {self.min_length}", F.col("n_chars")))
            .when(F.col("reason_code") == "too_long", F.format_string(f"文本过长: %d > {self.max_length}", F.col("n_chars")))
            .when(F.col("reason_code") == "repetition", F.format_string(f"重复率过高: %.2f > {self.max_repetition_ratio}", F.col("repetition")))
            .when(F.col("reason_code") == "special_chars", F.format_string(f"特殊字符比例过高: %.2f > {self.max_special_char_ratio}", F.col("special")))
            .when(F.col("reason_code") == "empty_prompt", "问题字段为空")
            .when(F.col("reason_code") == "empty_response", "回答字段为空")
            .when(F.col("reason_code") == "empty_text", "文本为空")
        )
