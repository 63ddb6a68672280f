"""Preference pairs from scored candidates, rules or human annotation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftcorpus.functions import rules
from weftcorpus.functions import text as T

STRATEGIES = ("score_diff", "rule_based", "human", "mixed")


def hallucinates(c: Column) -> Column:
    return T.matches_any(c, rules.PAIR_HALLUCINATIONS) | T.contains_any(c, rules.PAIR_NEGATIVE_WORDS)


@dataclass(frozen=True)
class PreferencePairBuilder:
    """Candidates are an array of (text, score); a missing column counts as empty."""

    strategy: str = "mixed"
    min_score_diff: float = 1.0
    prompt_field: str = "prompt"
    responses_field: str = "responses"
    id_field: str = "row_id"
    seed: int = 42

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")

    def _candidates(self) -> Column:
        """(negative score, place, text) of the candidates with text, best first, ties in their order."""
        with_place = F.transform(F.col(self.responses_field), lambda r, i: F.struct((-F.coalesce(r["score"].cast("double"), F.lit(0.0))).alias("neg"), i.alias("place"), T.text(r["text"]).alias("text")))
        return F.array_sort(F.filter(with_place, lambda r: r["text"] != ""))

    @staticmethod
    def _pair(prompt, chosen, rejected, name, diff=None) -> Column:
        return F.struct(prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"), F.lit(name).alias("build_strategy"), (diff if diff is not None else F.lit(None).cast("double")).alias("score_diff"))

    def score(self) -> Column:
        c = self._candidates()
        best, worst = F.get(c, F.lit(0)), F.get(c, F.size(c) - 1)
        diff = worst["neg"] - best["neg"]
        return F.when((F.size(c) >= 2) & (diff >= self.min_score_diff), self._pair(T.text(self.prompt_field), best["text"], worst["text"], "score_diff", diff))

    def rule(self) -> Column:
        # in candidate order, not by score
        c = F.filter(F.transform(F.col(self.responses_field), lambda r: T.text(r["text"])), lambda t: t != "")
        good, bad = F.filter(c, lambda t: ~hallucinates(t)), F.filter(c, hallucinates)
        pick = lambda a, salt: F.get(a, F.pmod(F.xxhash64(F.col(self.id_field), F.lit(self.seed + salt)), F.size(a)).cast("int"))
        return F.when((F.size(F.col(self.responses_field)) >= 2) & (F.size(good) > 0) & (F.size(bad) > 0), self._pair(T.text(self.prompt_field), pick(good, 0), pick(bad, 1), "rule_based"))

    def human(self) -> Column:
        p, c, r = (T.text(x) for x in (self.prompt_field, "chosen", "rejected"))
        return F.when((p != "") & (c != "") & (r != ""), self._pair(p, c, r, "human"))

    def candidates(self, df: DataFrame) -> DataFrame:
        """df with the pair of each row, null where none can be built."""
        for name in ("prompt", "chosen", "rejected"):
            field = self.prompt_field if name == "prompt" else name
            if field not in df.columns:
                df = df.withColumn(field, F.lit(None).cast("string"))
        if self.responses_field not in df.columns:
            df = df.withColumn(self.responses_field, F.lit(None).cast("array<struct<text:string,score:double>>"))
        parts = {"score_diff": [self.score], "rule_based": [self.rule], "human": [self.human], "mixed": [self.human, self.score, self.rule]}
        return df.withColumn("pair", F.coalesce(*[p() for p in parts[self.strategy]]))

    def build(self, df: DataFrame) -> DataFrame:
        """prompt, chosen, rejected, build_strategy, score_diff of the rows that give a pair."""
        return self.candidates(df).where("pair IS NOT NULL").select("pair.*")

    def observed(self, df: DataFrame, observation: Observation) -> DataFrame:
        """build() whose statistics the observation gets when the result is computed."""
        counts = [F.count_if(F.col("pair.build_strategy") == s).alias(s) for s in STRATEGIES[:3]]
        return self.candidates(df).observe(observation, F.count(F.lit(1)).alias("input_count"), *counts).where("pair IS NOT NULL").select("pair.*")

    def summary(self, got: dict) -> dict:
        by = {s: got[s] for s in STRATEGIES[:3] if got[s]}
        pairs = sum(by.values())
        return {"input_count": got["input_count"], "pairs_count": pairs, "skip_count": got["input_count"] - pairs, "strategy_distribution": by}

    def stats(self, df: DataFrame) -> DataFrame:
        """One row: input_count, pairs_count, skip_count, strategy_distribution."""
        by = self.candidates(df).groupBy(F.col("pair.build_strategy").alias("s")).agg(F.count("*").alias("n"))
        n, pairs = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.col("n"))), F.lit(0))
        return by.agg(n.alias("input_count"), pairs.alias("pairs_count"), (n - pairs).alias("skip_count"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("s", "n"))))).alias("strategy_distribution"))
