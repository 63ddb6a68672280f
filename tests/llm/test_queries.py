import re

import public_tokenizers

import __spark_entry__
import corpus_pipeline
from weftcorpus.llm import bpe, queries


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert [k for k in names if re.match(r"op\d+_", k)] == [k for k in queries.QUERIES if k.startswith("op")] and {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES if k.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, at, tables), "stage")
        assert after.columns == docs.columns and 0 < after.count(), name
        if name != "source mixing":
            assert after.count() <= at.count() and after.exceptAll(at).count() == 0
        else:
            assert after.distinct().exceptAll(at.distinct()).count() == 0
        at = after
    last = corpus_pipeline.STAGES[-1][1](spark, at, tables)
    assert last.count() == at.count() and last.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert last.select(docs.columns).exceptAll(at).count() == 0 and last.where("n_tokens <> size(ids)").count() == 0
    assert {r.text or "" for r in last.collect()} == {r.text for r in bpe.decode(last, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert corpus_pipeline.run(spark, tables).count() == at.count()


def test_pipeline_of_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
