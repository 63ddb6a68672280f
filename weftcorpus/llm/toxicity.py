"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words' weights; a document's is the noisy-or of its sentences,
trained from document labels alone. The sentences that carry the probability
are the offending ones.

Edge cases: null and empty texts have no sentence and score 0; without labelled
rows of both classes every document scores 0; repeated rows are scored alike; a score on the
threshold is predicted 1; very long texts are scored whole, sentence by sentence; an empty
table gives an empty result; other columns are not read, or pass through without_toxic().
Of features that tell the classes apart the strongest 65,536 get weights (`most` of telling()).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.bagging import BUCKETS, features, of_texts, sentences
from weftcorpus.llm.common import as_long, drop, held_out, table, text_bytes, trim, written
from weftcorpus.llm.samples import labelled, labelled_sample

__all__ = ["features", "op8", "score", "sentences", "toxicity", "train", "without_toxic"]


def telling(sample: DataFrame, least_gap: float = 4.0, most: int = 1 << 16) -> np.ndarray:
    """The features that bags of label 1 hold more often than chance explains (a
    two-proportion z over least_gap); only these can add to a sentence. The
    strongest `most` at most."""

    def counted(batches):
        n, mark = np.zeros((2, BUCKETS + 1), np.int32), np.zeros(BUCKETS + 1, bool)
        for batch in batches:
            y, open_row = batch.column(2).to_pylist(), -1
            for piece in of_texts(batch.column(1).to_pylist()):
                row = piece.sentence_row[piece.of]
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(row)]):
                    held = piece.features[a:b].ravel()
                    # a feature counts once a text: repeated places are added to once, and those of the text's piece before are marked
                    n[y[row[a]], held[~mark[held]] if row[a] == open_row else held] += 1
                if len(row):
                    if row[-1] != open_row:
                        open_row, mark[:] = row[-1], False
                    mark[held] = True
        n = n[:, :BUCKETS]
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0][at], pa.int64()), pa.array(n[1][at], pa.int64())], ["feature", "d0", "d1"])
        trim()

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.int32)
    pooled = (F.col("d0") + F.col("d1")) / (n0 + n1)
    gap = (F.col("d1") / n1 - F.col("d0") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    found = (
        sample.mapInArrow(counted, "feature int, d0 long, d1 long")
        .groupBy("feature")
        .agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
        .withColumn("gap", gap)
        .where((F.col("d1") >= 2) & (F.col("gap") > least_gap))
        .orderBy(F.desc("gap"), "feature")
        .limit(most)
    )
    return np.array(sorted(r.feature for r in found.select("feature").collect()), np.int32)


def bags(sample: DataFrame, kinds: np.ndarray) -> DataFrame:
    """The sample's rows as their telling features (places in kinds), the
    sentence that each belongs to and the number of sentences."""
    shared = sample.sparkSession.sparkContext.broadcast(kinds)

    def hashed(batches):
        place = np.full(BUCKETS + 1, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for batch in batches:
            n = np.zeros(len(batch), np.int32)
            f, s = ([[] for _ in range(len(batch))] for _ in "fs")
            for piece in of_texts(batch.column(1).to_pylist()):
                first = np.searchsorted(piece.sentence_row, piece.sentence_row)
                within = np.arange(len(first)) - first + n[piece.sentence_row]
                word, which = np.nonzero(place[piece.features] >= 0)
                kept = np.isin(word, piece.distinct(np.unique(word)))
                word, which = word[kept], which[kept]
                row = piece.sentence_row[piece.of[word]]
                own, at = place[piece.features[word, which]], within[piece.of[word]].astype(np.int32)
                begin = np.flatnonzero(np.diff(row, prepend=-1)).tolist()
                for a, b in zip(begin, [*begin[1:], len(row)]):
                    f[row[a]].append(own[a:b].tobytes())
                    s[row[a]].append(at[a:b].tobytes())
                n += np.bincount(piece.sentence_row, minlength=len(batch)).astype(np.int32)
            f, s = (pa.array([b"".join(x) for x in c], pa.binary()) for c in (f, s))
            yield pa.RecordBatch.from_arrays([batch.column(0), f, s, pa.array(n, pa.int32()), batch.column(2)], ["doc_id", "f", "s", "n", "y"])
        trim()

    return sample.mapInArrow(hashed, "doc_id long, f binary, s binary, n int, y int")


#: Columns of a block: labels of its bags; bag, kind of sentence and how often it is there; place and kind of sentence of each feature.
BLOCK = {"y": np.int8, "bag": np.int32, "kind": np.int32, "times": np.int32, "f": np.int32, "of": np.int32}


def block(y, counts, f, s, lengths) -> tuple:
    """Bags as a BLOCK, from their labels, numbers of sentences and features with the sentence of each. Sentences with the
    same features are of one kind, whichever bag they are in; kind 0 has none."""
    bag = np.repeat(np.arange(len(y)), lengths)
    order = np.lexsort((f, s, bag))
    f, s, bag = np.ascontiguousarray(f[order], np.int32), s[order], bag[order]
    begin = np.flatnonzero((np.diff(bag, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0))
    raw, cut = f.tobytes(), (4 * np.append(begin, len(f))).tolist()
    kinds = {b"": 0}
    kind = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(cut, cut[1:])], np.int64)
    blank = np.asarray(counts) - np.bincount(bag[begin], minlength=len(y))
    at = np.concatenate([np.arange(len(y)) * len(kinds), bag[begin] * len(kinds) + kind])
    at, where = np.unique(at, return_inverse=True)
    times = np.bincount(where, np.concatenate([blank, np.ones(len(begin))]), len(at)).astype(np.int64)
    at, times = at[times > 0], times[times > 0]
    own = np.frombuffer(b"".join(kinds), np.int32)
    return np.asarray(y), at // len(kinds), at % len(kinds), times, own, np.repeat(np.arange(len(kinds)), [len(x) // 4 for x in kinds])


def descend(sums, kinds: np.ndarray, rounds: int = 160, rate: float = 0.15, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights of the hashed features and the intercept, by Adam on the noisy-or likelihood of all bags: sums(g) adds up g(block) over them."""
    weights = np.zeros(BUCKETS, np.float32)
    first = sums(lambda y, bag, kind, times, f, of: np.array([len(y), y.sum(), times.sum()], float))
    if first is None or not 0 < first[1] < first[0]:
        return weights, -40.0
    n = int(first[0])
    share = first[1] / first[0]
    w, b = np.zeros(len(kinds)), -math.log(first[2] / n * 2 + 1)
    m, v = np.zeros(len(kinds) + 1), np.zeros(len(kinds) + 1)
    for step in range(1, rounds + 1):

        def slopes(y, bag, kind, times, f, of):
            class_weight = np.where(y, 0.5 / share, 0.5 / (1 - share)) / n
            n_kinds = max(kind.max(initial=0), of.max(initial=0)) + 1
            z = np.clip(np.bincount(of, w[f], n_kinds) + b, -40, 40)
            total = np.bincount(bag, times * np.logaddexp(0, z)[kind], len(y))
            # minus the likelihood's slope: sentences of clean bags go down, those of
            # toxic bags share what the noisy-or still lacks
            outer = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) * class_weight
            slope = np.bincount(kind, times * outer[bag], n_kinds) / (1 + np.exp(-z))
            return np.append(np.bincount(f, slope[of], len(kinds)), slope.sum())

        grad = sums(slopes) + np.append(ridge * w / n, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[kinds] = w
    return weights, float(b)


def fit(rows: list, kinds: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """descend() over rows of bags() in the driver."""
    rows = [r for r in rows if r.n]
    f, s = ([np.frombuffer(getattr(r, c), np.int32) for r in rows] for c in "fs")
    one = block(np.array([r.y for r in rows], bool), np.array([r.n for r in rows], np.int64), np.concatenate([np.zeros(0, np.int32), *f]), np.concatenate([np.zeros(0, np.int32), *s]), [len(x) for x in f]) if rows else None
    return descend(lambda g: g(*one) if one else None, kinds, **options)


def packed(rows: DataFrame, most: int = 1 << 14, most_bytes: int = 32 << 20) -> DataFrame:
    """The table of bags() as blocks, a row each, of about `most` bags or most_bytes of features: what the rounds of descend() go over."""

    def made(batches):
        def one():
            y, counts, f, s, lengths = (np.concatenate(x) for x in zip(*held))
            arrays = block(y, counts, f, s, lengths)
            return pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(arrays, BLOCK.values())], list(BLOCK))

        held, bags, size = [], 0, 0
        for batch in batches:
            (f, at), (s, _) = text_bytes(batch.column(0)), text_bytes(batch.column(1))
            held.append((as_long(batch.column(3)) == 1, as_long(batch.column(2)), f.view(np.int32).copy(), s.view(np.int32).copy(), np.diff(at) // 4))
            bags, size = bags + len(batch), size + len(f)
            if bags >= most or size >= most_bytes:
                yield one()
                held, bags, size = [], 0, 0
        if bags:
            yield one()
        trim()

    return rows.where("n > 0").select("f", "s", "n", "y").mapInArrow(made, ", ".join(f"{c} binary" for c in BLOCK))


def added(blocks: RDD):
    """The sums of descend() over blocks, made by the tasks that hold them; the driver gets one result of each."""

    def sums(g):
        def run(held):
            total = None
            for one in held:
                part = g(*one)
                total = part if total is None else total + part
            if total is not None:
                yield total

        parts = blocks.mapPartitions(run).collect()
        return sum(parts) if parts else None

    return sums


def descend_far(rows: DataFrame, kinds: np.ndarray, each: int = 1 << 15, **options) -> tuple[np.ndarray, float]:
    """descend() over the table of bags() by jobs. Its blocks are written, then held by the executors (beyond their memory on
    their disks) in a task for about `each` bags: a round is short, so many tasks would cost more than their sums."""
    stored = written(packed(rows), "toxic-blocks")
    arrays = lambda r: tuple(np.frombuffer(x, t) for x, t in zip(r, BLOCK.values()))
    blocks = stored.coalesce(rows.count() // each + 1).rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    model = descend(added(blocks), kinds, **options)
    blocks.unpersist()
    drop(stored)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int | None = None, few: int = 6000) -> tuple[np.ndarray, float]:
    """The model of all training rows, or of per_class of each label. Up to `few` bags are fitted in the driver, more by jobs over their table."""
    chosen = labelled(docs, labels, "toxic") if per_class is None else labelled_sample(docs, labels, "toxic", per_class)
    sample = written(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label"), "toxic-rows")
    kinds = telling(sample)
    rows = written(bags(sample, kinds), "toxic-bags")
    model = descend_far(rows, kinds) if rows.count() > few else fit(sorted(rows.collect()), kinds)
    drop(sample, rows)
    return model


class Scorer:
    """Scores the texts of a batch, sentence by sentence."""

    def __init__(self, model: tuple[np.ndarray, float], threshold: float):
        self.weights, self.bias = np.append(model[0], np.float32(0)), model[1]
        self.counts, self.threshold = self.weights != 0, threshold

    def __call__(self, texts: list) -> tuple[np.ndarray, tuple]:
        """The noisy-or of each text's sentences; row, start, end and probability of the sentences over the threshold."""
        parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for piece in of_texts(texts):
            words = piece.distinct(np.flatnonzero(self.counts[piece.features].any(axis=1)))
            weight = self.weights[piece.features[words]].sum(axis=1)
            parts.append((piece.sentence_row, piece.sentence_start, piece.sentence_end, np.bincount(piece.of[words], weight, len(piece.sentence_row)) + self.bias))
        row, start, end, z = (np.concatenate(x) for x in zip(*parts))
        total = np.bincount(row, np.where(z > -28, np.where(z < 30, np.log1p(np.exp(np.minimum(z, 30))), z), 0), len(texts))
        p = 1 / (1 + np.exp(-np.maximum(z, -28)))
        over = (z > -28) & (p >= self.threshold)
        return -np.expm1(-total), (row[over], start[over], end[over], p[over])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """doc_id, score and the offending sentences (start and end in code points, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        scorer = Scorer(shared.value, threshold)
        for batch in batches:
            scores, (row, start, end, p) = scorer(batch.column(1).to_pylist())
            spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(p, pa.float64())], ["start", "end", "score"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["doc_id", "score", "offending"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold; a pure filter, no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def kept(batches):
        scorer = Scorer(shared.value, threshold)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text").to_pylist())[0] < threshold))
        trim()

    return docs.mapInArrow(kept, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int | None = None, threshold: float = 0.5, model=None) -> DataFrame:
    """doc_id, held_out, score, predicted, offending. Trains on all labelled rows that are not held out, or on per_class of each label."""
    model = model or train(docs, labels, per_class)
    return score(docs, model, threshold).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
