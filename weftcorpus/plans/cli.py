"""Command lines: python -m weftcorpus.plans.cli pipeline|evaluate|tracker ..."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftcorpus.operators import tracking
from weftcorpus.operators.evalrun import EvalRunner
from weftcorpus.plans.pipeline import DataPipeline
from weftcorpus.sources import records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftcorpus", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("pipeline", help="curate a file of records")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--config", help="YAML or JSON with sections of parameters")
    a.add_argument("--qa", action="store_true", help="records are question and answer")
    a.add_argument("--rewrite", action="store_true")
    a.add_argument("--pairs", action="store_true")
    a = sub.add_parser("evaluate", help="score the responses of one model or more")
    a.add_argument("--input", required=True, nargs="+", help="a file for each model")
    a.add_argument("--model-name", required=True, nargs="+")
    a.add_argument("--output-dir", default="reports")
    a = sub.add_parser("tracker", help="leaderboard of a benchmark document and a log record")
    a.add_argument("--benchmark", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--log", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftcorpus").getOrCreate()
    if args.command == "pipeline":
        config = records.load_config(args.config) if args.config else {}
        for flag, section, value in ((args.qa, "quality_filter", {"require_qa_pair": True}), (args.rewrite, "template_rewrite", {"enabled": True}), (args.pairs, "preference_pairs", {"enabled": True})):
            if flag:
                config.setdefault(section, {}).update(value)
        report = DataPipeline(config).run(spark, args.input, args.output)
        print(f"{report['input_count']} -> {report['output_count']} records in {report['elapsed_seconds']} s")
    elif args.command == "evaluate":
        if len(args.input) != len(args.model_name):
            raise SystemExit("--input and --model-name must have the same number of values")
        runner = EvalRunner(output_dir=args.output_dir)
        sets = {m: records.with_row_id(records.load(spark, p)) for m, p in zip(args.model_name, args.input)}
        if len(sets) == 1:
            (name, df), = sets.items()
            print(runner.run(df, name)["report"])
        else:
            results, table = runner.compare_models(sets)
            rows = [r.asDict(recursive=True) for r in table.collect()]
            print(runner.report({"comparison_table": rows, "best_model": rows[0]["model"]}, "model_comparison"))
    else:
        snapshot(spark, args.benchmark, args.output, args.log)
    return 0


def snapshot(spark: SparkSession, benchmark: str, output: str, log: str) -> str:
    """Writes the leaderboard of a benchmark document and adds a record of that to the log."""
    doc = records.benchmark(spark, benchmark)
    meta = doc.select(F.col("meta")).first()
    rows = [r.asDict() for r in tracking.leaderboard(doc).collect()]
    meta = meta.meta.asDict(recursive=True) if meta and meta.meta else {}
    records.save_json({"meta": meta, "generated_at": datetime.now(timezone.utc).isoformat(), "leaderboard": rows}, output)
    records.append_experiment(spark, log, "summary_refresh", "benchmark_summary", 42, str(meta.get("dataset_version", "unknown")), "experiment_tracker", {"source": benchmark})
    return output


if __name__ == "__main__":
    raise SystemExit(main())
