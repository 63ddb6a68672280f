"""Labelled rows for the classifiers: all of them, or bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcorpus.llm.common import held_out


def _known(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(~held_out() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, few: int = 1_000_000) -> DataFrame:
    """(doc_id, text, label) of every training document: not held out, with a label and an id; of rows
    that share an id the least text counts. Labels travel to the documents while they are few."""
    known = _known(labels, label).where("doc_id IS NOT NULL")
    rows = docs.select("doc_id", "text").join(F.broadcast(known) if known.count() <= few else known, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most per_class training documents of each class,
    the first by hash of their id, so that reruns agree. Held-out rows, null
    labels and null ids never enter. Ids are bounded by 2 * per_class, which makes their
    broadcast safe, and so are rows: of rows that share an id the least text counts."""
    known = _known(labels, label)
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
