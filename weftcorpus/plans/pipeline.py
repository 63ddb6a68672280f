"""The data pipeline: near-duplicates, rule filter, rewriting, slot tagging, preference pairs."""

from __future__ import annotations

import copy
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftcorpus.operators.dedup import MinHashDeduplicator
from weftcorpus.operators.pairs import PreferencePairBuilder
from weftcorpus.operators.quality import QualityFilter
from weftcorpus.operators.rewrite import TemplateRewriter
from weftcorpus.operators.slots import SlotAnnotator
from weftcorpus.sources import records
from weftcorpus.sources.shared import written

# The steps' parameters. A step that isn't enabled isn't in the plan.
DEFAULTS: dict = {
    "dedup": {"enabled": True, "num_perm": 128, "threshold": 0.85, "ngram_size": 3},
    "quality_filter": {"enabled": True, "min_length": 20, "max_length": 8192, "max_repetition_ratio": 0.3, "max_special_char_ratio": 0.2, "require_qa_pair": False},
    "template_rewrite": {"enabled": False, "styles": ["colloquial", "professional", "concise"]},
    "slot_annotate": {"enabled": True, "slot_types": ["price", "date", "stock", "promotion", "brand"]},
    "preference_pairs": {"enabled": False, "strategy": "mixed", "min_score_diff": 1.0},
}


def merged(config: dict | None) -> dict:
    """DEFAULTS with config's values, section by section."""
    out = copy.deepcopy(DEFAULTS)
    for section, values in (config or {}).items():
        if section not in out:
            raise ValueError(f"unknown section {section!r}")
        out[section].update(values)
    return out


class DataPipeline:
    def __init__(self, config: dict | None = None, generate=None):
        self.config = merged(config)
        part = lambda name: {k: v for k, v in self.config[name].items() if k not in ("enabled", "batch_size", "quality_threshold")} if self.config[name]["enabled"] else None
        make = lambda kind, args, **more: None if args is None else kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in args.items()}, **more)
        self.dedup = make(MinHashDeduplicator, part("dedup"))
        self.filter = make(QualityFilter, part("quality_filter"))
        self.rewriter = make(TemplateRewriter, part("template_rewrite"), **({"generate": generate} if generate else {}))
        self.annotator = make(SlotAnnotator, part("slot_annotate"))
        self.pairs = make(PreferencePairBuilder, part("preference_pairs"))

    def transform(self, df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        """(result, the statistics of each step). Only the output of dedup is written
        in between; the steps after it are one plan."""
        df, stats = records.with_row_id(df), {}
        for field in ("text", "prompt", "response"):
            if field not in df.columns:
                df = df.withColumn(field, F.lit(None).cast("string"))
        if self.dedup:
            df_in, df = df, written(self.dedup.dedup(df), "deduplicated")
            stats["dedup"] = self.dedup.stats(df_in, df)
        if self.filter:
            stats["quality_filter"] = self.filter.stats(df)
            df = self.filter.filter(df)
        if self.rewriter:
            df_in, df = df, self.rewriter.rewrite(df)
            stats["template_rewrite"] = self.rewriter.stats(df_in, df)
        if self.annotator:
            df = self.annotator.annotate(df)
            stats["slot_annotate"] = self.annotator.stats(df)
        if self.pairs:
            stats["preference_pairs"] = self.pairs.stats(df)
            df = self.pairs.build(df)
        return df, stats

    def observed(self, df: DataFrame) -> tuple[DataFrame, dict[str, Observation]]:
        """(result, an observation for each step): what transform() gives, with the counts taken as the rows pass by.
        They are there once the result has been written or collected as a whole; no step is run again for them."""
        df, seen = records.with_row_id(df), {}
        for field in ("text", "prompt", "response"):
            if field not in df.columns:
                df = df.withColumn(field, F.lit(None).cast("string"))

        def watched(name):
            return seen.setdefault(name, Observation(f"{name}-{uuid.uuid4().hex}"))

        if self.dedup:
            df = written(self.dedup.dedup(df.observe(watched("dedup_input"), F.count(F.lit(1)).alias("n"))), "deduplicated")
            df = df.observe(watched("dedup"), F.count(F.lit(1)).alias("n"))
        for name, step in (("quality_filter", self.filter), ("template_rewrite", self.rewriter), ("slot_annotate", self.annotator), ("preference_pairs", self.pairs)):
            if step:
                df = step.observed(df, watched(name))
        return df.observe(watched("output"), F.count(F.lit(1)).alias("n")), seen

    def summary(self, seen: dict[str, Observation]) -> dict[str, dict]:
        """The statistics of each step, from the observations of a result that has been written."""
        out = {}
        if self.dedup:
            n, kept = seen["dedup_input"].get["n"], seen["dedup"].get["n"]
            out["dedup"] = {"original_count": n, "deduplicated_count": kept, "removed_count": n - kept, "dedup_ratio": (n - kept) / max(n, 1)}
        for name, step in (("quality_filter", self.filter), ("template_rewrite", self.rewriter), ("slot_annotate", self.annotator), ("preference_pairs", self.pairs)):
            if step:
                out[name] = step.summary(seen[name].get)
        return out

    def statistics(self, df: DataFrame) -> DataFrame:
        """(step, metric, value) of a run over df whose rows nobody keeps; values that a map holds are named metric.key."""
        out, seen = self.observed(df)
        out.write.format("noop").mode("overwrite").save()
        rows = []
        for step, values in self.summary(seen).items():
            for metric, value in values.items():
                rows += [(step, f"{metric}.{k}", float(v)) for k, v in value.items()] if isinstance(value, dict) else [(step, metric, float(value))]
        return df.sparkSession.createDataFrame(rows, "step string, metric string, value double")

    def run(self, spark: SparkSession, input_path: str, output_path: str, schema=None) -> dict:
        """Reads, transforms, saves and writes the statistics next to the output, in one pass over each step."""
        began = time.time()
        data = records.load(spark, input_path, schema)
        arrived = Observation(f"input-{uuid.uuid4().hex}")
        out, seen = self.observed(data.observe(arrived, F.count(F.lit(1)).alias("n")))
        records.save(out, output_path)
        report = {"input_path": input_path, "output_path": output_path, "input_count": arrived.get["n"], "steps": {k: [v] for k, v in self.summary(seen).items()}, "output_count": seen["output"].get["n"]}
        report["elapsed_seconds"] = round(time.time() - began, 2)
        records.save_stats(report, output_path)
        return report
