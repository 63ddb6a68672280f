"""A corpus from raw documents: toxic documents go, copies and near copies go,
sources are mixed to their weights, and the rest is encoded.

Each stage works on all that its predecessor kept. Mixing repeats the rows that
it takes more than once. The last stage gives the digests of each row's tokens.

Edge cases: null and empty texts are no toxic ones; of all that are equal without
white space one stays, which is a row like any other to the stages behind. Of equal
texts the longest original stays, then the least id, null ids last. Rows that share
an id are one document to the near-copies stage and rows of their own to the others;
rows with a null id are never near copies. Columns beyond those of documents pass
through all stages, but one of the last stage's names is replaced by it. Very long texts
go through whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm import bpe, jaccard, lsm_dedup, mixing, toxicity
from weftcorpus.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsm_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: No SQL: trained scores and the tokenizer can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
