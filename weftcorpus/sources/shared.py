"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session without it gets
    a temporary folder of its own, which goes with the process."""
    small_batches(spark)
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Arrow batches of at most 4 MB, unless the session says otherwise: a worker holds a
    batch of texts several times over, as bytes, strings and arrays, and so does its executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most_bytes))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_weft_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The paths in a folder; none if there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in store.listStatus(where)] if store.exists(where) else []


def _open(path: str):
    """(file system, path) of a path with a scheme; None for one on this machine."""
    if ":" not in path.split("/", 1)[0]:
        return None
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(path: str, text: str) -> None:
    """A small document, written by the driver: to a store where the path names one (file:, hdfs:, ...), else to a file."""
    if store := _open(path):
        out = store[0].create(store[1], True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def read_text(path: str) -> str:
    if store := _open(path):
        stream = store[0].open(store[1])
        try:
            return SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    return Path(path).read_text(encoding="utf-8")
