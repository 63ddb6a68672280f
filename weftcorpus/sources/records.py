"""Records, statistics, metrics and configuration in and out of Spark.

JSON lines, whole JSON documents (an array or a lone object) and Parquet are read
by suffix; a missing path or another suffix is an error at once.
"""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from weftcorpus.sources.shared import read_text, write_text

CANDIDATES = "array<struct<text:string,score:double>>"
STEPS = "experiment_id string, method string, seed long, dataset_version string, steps array<struct<step:long,epoch:double,loss:double,accuracy:double,eval_loss:double,reward_accuracy:double,reward:double>>"
BENCHMARK = (
    "meta struct<benchmark_name:string,dataset_name:string,dataset_version:string,test_set_size:long,evaluation_window:struct<started_at:string,finished_at:string>,judge_model:string,notes:string>, "
    "models map<string,struct<display_name:string,metrics:struct<factuality:double,task_completion:double,safety:double,template_rate:double,overall_score:double>,"
    "training_cost:struct<gpu_hours:double,peak_vram_gb:double,epochs:long,tokens_seen_million:double>,inference:struct<latency_ms_p50:long,latency_ms_p95:long,throughput_tok_per_s:double>,error_buckets:map<string,long>>>, "
    "significance_tests struct<overall_score:array<struct<comparison:string,test:string,p_value:double,effect_size:double,confidence_interval_95:array<double>>>,method_family:struct<test:string,groups:array<string>,f_statistic:double,p_value:double>>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load(spark: SparkSession, path: str, schema: str | S.StructType | None = None) -> DataFrame:
    suffix = Path(path).suffix.lower()
    if suffix not in (".jsonl", ".json", ".parquet"):
        raise ValueError(f"unsupported format {suffix!r}: .jsonl, .json or .parquet")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=suffix == ".json")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: small files come as one
    task each, too few for expressions that cost more than a shuffle of their columns."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with a number that grows in the order of the input, where it has none."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def save(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines (or Parquet by suffix) in a folder; one part only on request."""
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    out.parquet(path) if path.endswith(".parquet") else out.option("ignoreNullFields", "true").json(path)


def save_arrays(df: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """JSON documents, each an array of at most about rows_per_file rows, in a folder whose name ends in .json."""
    parts = max(1, -(-df.count() // rows_per_file))
    rows = df.select(F.to_json(F.struct("*")).alias("r")).repartition(parts)

    def run(batches):
        # a line for each row, between brackets: no task holds more than a batch of its document
        begin = "["
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([begin + lines[0], *("," + r for r in lines[1:])])], ["value"])
                begin = ","
        if begin == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def load_splits(spark: SparkSession, splits: dict[str, str], schema=None) -> DataFrame:
    """The rows of several files with their split's name."""
    out = None
    for name, path in splits.items():
        part = load(spark, path, schema).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def prompts(df: DataFrame, field: str = "prompt") -> DataFrame:
    return df.select(F.col(field).alias("prompt"))


def save_json(value, path: str) -> None:
    """A small document, written by the driver."""
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def load_json(path: str):
    return json.loads(read_text(path))


def save_stats(stats: dict, output_path: str) -> str:
    """Statistics next to an output: <output without suffix>_stats.json."""
    folder, _, name = output_path.rstrip("/").rpartition("/")
    path = f"{folder}{'/' if folder else ''}{Path(name).stem}_stats.json"
    save_json(stats, path)
    return path


def load_config(path: str) -> dict:
    """YAML where the library for it is there, JSON always."""
    text = read_text(path)
    if Path(path).suffix.lower() == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML files need PyYAML; JSON files don't") from e
    return yaml.safe_load(text)


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds rows to a metrics table (a Parquet folder)."""
    df.write.mode("append").parquet(path)


def recent_runs(spark: SparkSession, path: str, most: int = 10, order: str = "recorded_at") -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc(order)).limit(most)


def append_experiment(spark: SparkSession, path: str, experiment_id: str, method: str, seed: int, dataset_version: str, evaluator: str, hyperparameters: dict, notes: str | None = None) -> None:
    """Adds a run's record, with the time in UTC, to a folder of JSON lines."""
    row = spark.createDataFrame([(experiment_id, method, seed, dataset_version, evaluator, {k: str(v) for k, v in hyperparameters.items()}, notes or "")], "experiment_id string, method string, seed long, dataset_version string, evaluator string, hyperparameters map<string,string>, notes string")
    row.withColumn("recorded_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).coalesce(1).write.mode("append").json(path)


def metric_steps(spark: SparkSession, path: str) -> DataFrame:
    """A row for each step of a metric log."""
    log = spark.read.schema(STEPS).json(path, multiLine=True)
    return log.select("experiment_id", "method", "seed", "dataset_version", F.explode("steps").alias("s")).select("experiment_id", "method", "seed", "dataset_version", "s.*")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).json(path, multiLine=True)
