import random

import pytest
from pyspark.sql import functions as F

from weftcorpus.operators.dedup import MinHashDeduplicator
from weftcorpus.streaming.near_dedup import NearDuplicateStream


def rows(n=60):
    random.seed(6)
    base = ["".join(random.choice("甲乙丙丁戊己庚辛壬癸天地玄黄") for _ in range(80)) for _ in range(12)]
    out = []
    for i in range(n):
        t = random.choice(base)
        k = random.randrange(80)
        out.append((i, t if i % 3 else t[:k] + "新" + t[k + 1 :], f"2024-05-01 00:{i % 60:02d}:00"))
    return out


def test_a_stream_keeps_what_the_table_keeps(spark, tmp_path):
    schema = "row_id long, text string, ts string"
    every = spark.createDataFrame(rows(), schema)
    stream = NearDuplicateStream(f"{tmp_path}/state", delay=3600)
    for k in range(3):
        every.where(F.col("row_id").between(20 * k, 20 * k + 19)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withColumn("ts", F.to_timestamp("ts"))
        query = stream.start(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert query.awaitTermination(240)
    want = {r.row_id for r in MinHashDeduplicator().dedup(every).collect()}
    assert {r.row_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and len(want) < 60


def test_state_expires_and_replays_agree(spark, tmp_path):
    stream = NearDuplicateStream(f"{tmp_path}/state", delay=60)
    text = "".join(random.Random(1).choice("甲乙丙丁戊己庚辛壬癸") for _ in range(90))
    batch = lambda i, minute: spark.createDataFrame([(i, text, f"2024-05-01 00:{minute:02d}:00")], "row_id long, text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert stream.kept(batch(1, 0), 0).count() == 1
    assert stream.kept(batch(2, 1), 1).count() == 0
    assert stream.kept(batch(2, 1), 1).count() == 0 and stream.kept(batch(1, 0), 0).count() == 1  # replayed
    other = batch(3, 30).withColumn("text", F.lit("另外 一段 完全 不同 的 文字，讲 别的 事情。"))
    assert stream.kept(other, 2).count() == 1
    # a copy after the delay is new
    assert stream.kept(batch(4, 31), 3).count() == 1
    with pytest.raises(ValueError):
        NearDuplicateStream("x", dedup=MinHashDeduplicator(verify=True))
