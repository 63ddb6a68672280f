"""Quality by Bradley-Terry ranking.

Every pair of a good and a bad training document is a preference; the model
learns a linear score whose difference explains the preferences by logistic
loss, over all pairs of all training rows (by counts of scores on a grid, so that
the work grows with rows). Its features are the shape of a whole text (character classes, repetition,
word and line statistics) and the frequencies of all its three-byte strings, in
hashed cells whose weights are learned. The share of bad training documents gives the score quantile that
becomes the threshold; the reported score is shifted so that this quantile
falls on 0.3.

Edge cases: null and empty texts have a feature vector of their own and so a
score; without both labels every score is 0.5; repeated rows score alike; of training
rows that share an id one counts; a score on the threshold is predicted 1; very long texts
are read whole, a megabyte at a time; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import as_long, drop, held_out, table, text_bytes, written
from weftcorpus.llm.samples import labelled

#: Hashed cells of three-byte strings, a power of two.
CELLS = 512
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\/=+_|", np.uint8)


def features(text: str | None) -> list[float]:
    """Shape of a whole text: character classes, repetition, word and line statistics."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(int(hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()), 1)
    symbols, shout, digits = hist[_SYMBOLS].sum() / k, hist[33] / k, hist[48:58].sum() / n
    upper = hist[65:91].sum() / letters
    sentences = hist[46] + hist[33] + hist[63]
    top = max(counts.values(), default=0) / k
    expected = min(1.0, 1.15 - 0.06 * math.log1p(k))
    distinct = len(counts) / k
    echoed = sum(a == b for a, b in zip(words, words[1:])) / k
    packed = len(zlib.compress(raw, 1)) / (n + 20)
    clip = lambda x, top: min(float(x) / top, 1.0)
    return [
        clip(symbols, 0.2), clip(symbols, 2), clip(shout, 0.1), clip(shout, 1), clip(hist[124] / k, 0.1), clip(upper, 0.15), clip(upper, 0.6),
        clip(digits, 0.05), clip(digits, 0.4), distinct, clip(max(0.0, expected - distinct), 0.3), clip(top, 0.1), clip(top, 0.6), clip(echoed, 0.05), clip(echoed, 0.5),
        packed, clip(max(0.0, 0.3 - packed), 0.15), len(set(lines)) / max(len(lines), 1), clip(sentences / k, 0.05), clip(sentences / k, 0.3), clip(hist[44] / k, 0.1),
        clip(len(raw) / k, 6), clip(len(raw) / k, 14), clip(math.log1p(k), 6), clip(math.log1p(k), 12), clip(len(lines) / k, 0.1), float(k < 20), float(not words), clip(hist[128:].sum() / n, 0.3),
    ]


def grams(raw: bytes, part: int = 1 << 20) -> np.ndarray:
    """Roots of the frequencies of three-byte strings in CELLS hashed cells, of length 1 (0 for shorter texts)."""
    data, n = np.frombuffer(raw, np.uint8), np.zeros(CELLS)
    for at in range(0, max(len(data) - 2, 0), part):
        x = data[at : at + part + 2].astype(np.uint32)
        h = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)
        n += np.bincount(h >> np.uint32(32 - CELLS.bit_length() + 1), minlength=CELLS)
    return np.sqrt(n / max(n.sum(), 1))


def vector(text: str | None) -> np.ndarray:
    return np.concatenate([features(text), grams((text or "").encode())])


def matrix(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, x (numbers as bytes) and the extra integer columns of each row."""

    def extracted(batches):
        for batch in batches:
            x = [vector(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), *[batch.column(2 + i) for i in range(len(extra))]], ["doc_id", "x", *extra])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(extracted, ", ".join(["doc_id long, x binary", *[f"{c} int" for c in extra]]))


def pair_loss(w: np.ndarray, z: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the pairs' score differences with a ridge, and its slope. Rows of z are scored once, not once a pair."""
    # plain sums: threads of a linear algebra library would spin on products this small
    s = np.einsum("ij,j->i", z, w)
    gap = s[good] - s[bad]
    miss = 1 / (1 + np.exp(np.clip(gap, -40, 40))) / len(good)
    pull = np.bincount(bad, miss, len(z)) - np.bincount(good, miss, len(z))
    return float(np.logaddexp(0, -gap).mean() + (ridge * w * w).sum() / 2), np.einsum("ij,i->j", z, pull) + ridge * w


#: Scores are laid on a grid of this step up to this size, by the four nodes about each.
STEP, REACH = 1 / 16, 256


def nodes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four grid nodes about each score and their weights (Lagrange's, of third order)."""
    at = (np.clip(s, -REACH, REACH) + REACH) / STEP
    k = np.floor(at).astype(np.int64)
    f = at - k
    weights = np.stack([-f * (f - 1) * (f - 2) / 6, (f + 1) * (f - 1) * (f - 2) / 2, -(f + 1) * f * (f - 2) / 2, (f + 1) * f * (f - 1) / 6])
    return k + np.arange(4)[:, None], weights


def laid(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of bad and of good scores at each node."""
    at, weights = nodes(s)
    size = int(2 * REACH / STEP) + 4
    return np.stack([np.bincount(at[:, y == c].ravel(), weights[:, y == c].ravel(), size) for c in (False, True)])


def all_pairs(n: np.ndarray) -> tuple[float, np.ndarray]:
    """From laid(): the mean logistic loss of all pairs of a good and a bad score, and its slope for a bad and
    a good score at each node. Work grows with nodes, not with pairs; the step leaves an error of about 1e-7."""
    used = np.flatnonzero(n.any(axis=0))
    a, b = used[0], used[-1] + 1
    bad, good = n[:, a:b]
    pairs = bad.sum() * good.sum()
    gap = np.arange(-(b - a) + 1, b - a) * STEP
    meet = lambda h, kernel: np.convolve(h, kernel)[b - a - 1 : 2 * (b - a) - 1] / pairs
    slope = np.zeros_like(n)
    slope[0, a:b] = meet(good, 1 / (1 + np.exp(np.clip(-gap, -500, 500))))
    slope[1, a:b] = -meet(bad, 1 / (1 + np.exp(np.clip(gap, -500, 500))))
    return float(good @ meet(bad, np.logaddexp(0, -gap))), slope


def minimum(loss, slope, w: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Where a smooth convex loss is least, by limited-memory quasi-Newton steps."""
    past, value, grad = [], loss(w), slope(w)
    for _ in range(rounds):
        if np.abs(grad).max() < 1e-7:
            break
        d, kept = -grad, []
        for move, bend in reversed(past):
            kept.append((move @ d) / (move @ bend))
            d = d - kept[-1] * bend
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        else:
            d = d / max(np.linalg.norm(d), 1e-12)
        for move, bend in past:
            d = d + (kept.pop() - (bend @ d) / (move @ bend)) * move
        length = 1.0
        while (after := loss(w + length * d)) > value + 1e-4 * length * (grad @ d):
            length /= 2
            if length < 1e-6:
                return w
        old, w, value = grad, w + length * d, after
        grad = slope(w)
        if (length * d) @ (grad - old) > 1e-12:
            past = [*past[1 - memory :], (length * d, grad - old)]
    return w


def reached(counts, enough) -> tuple[float, np.ndarray]:
    """The least score up to which there are enough rows, and the numbers of bad and good ones below it, by counts in ever smaller bins."""
    low, width = -float(REACH), 2.0 * REACH / 4096
    for _ in range(4):
        up_to = np.cumsum(counts(low, width), axis=1)
        ok = enough(*up_to)
        k = min(max(int(np.argmax(ok)) if ok.any() else 4096, 1), 4096)
        low, width, below = low + (k - 1) * width, width / 4096, up_to[:, k - 1]
    return low + 2048 * width, below


def fitted(sums, rounds: int = 40, ridge: float = 1e-4, at: float = 0.3, bad_share: float | None = None) -> tuple[np.ndarray, float]:
    """(weights, shift) of all pairs of good and bad rows: sums(f) adds up f(x, y) over blocks of all rows. None without both labels."""
    first = sums(lambda x, y: np.concatenate([[len(y) - y.sum(), y.sum()], x.sum(axis=0)]))
    if first is None or not first[:2].all():
        return None
    n_bad, n_good = first[:2]
    mean = first[2:] / (n_bad + n_good)
    width = len(mean)
    deviation = np.sqrt(sums(lambda x, y: ((x - mean) ** 2).sum(axis=0)) / (n_bad + n_good))
    # shape features by their own deviation, cells by the whole block's, so that rare cells don't weigh more
    live, scale = deviation > 1e-9, deviation + 1e-6
    if width > CELLS:
        scale[-CELLS:] = np.sqrt((scale[-CELLS:] ** 2).mean()) * 4
    penalty = np.full(width, ridge)
    penalty[-CELLS:] = 10 * ridge
    # plain sums: threads of a linear algebra library would spin on products this small
    scores = lambda x, u: np.einsum("ij,j->i", x, u) - (mean * u).sum()
    flat = lambda w: np.where(live, w / scale, 0.0)
    last = {}

    def loss(w):
        u = flat(w)
        value, last["slope"] = all_pairs(sums(lambda x, y: laid(scores(x, u), y)))
        return value + (penalty * w * w).sum() / 2

    def slope(w):
        u, table = flat(w), last["slope"]

        def pulled(x, y):
            k, weights = nodes(scores(x, u))
            pull = (np.where(y, table[1][k], table[0][k]) * weights).sum(axis=0)
            return np.append(np.einsum("ij,i->j", x, pull), pull.sum())

        total = sums(pulled)
        return np.where(live, (total[:-1] - mean * total[-1]) / scale, 0.0) + penalty * w

    u = flat(minimum(loss, slope, np.zeros(width), rounds))

    def counts(low, width):
        def binned(x, y):
            k = np.clip(np.floor((scores(x, u) - low) / width), -1, 4096).astype(np.int64) + 1
            return np.stack([np.bincount(k[y == c], minlength=4098).astype(float) for c in (False, True)])

        return sums(binned)

    # the quantile of the label's own mix: each class weighs what it weighs among all labels
    share = n_bad / (n_bad + n_good) if bad_share is None else bad_share
    mass = lambda bad, good: bad * share / n_bad + good * (1 - share) / n_good
    high, below = reached(counts, lambda bad, good: mass(bad, good) > share + 1e-9)
    low = reached(counts, lambda bad, good: bad + good >= below.sum())[0] if below.any() else high
    return u, math.log(at / (1 - at)) - (low + high) / 2 - (mean * u).sum()


def fit_rows(x: np.ndarray, y: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """(weights, shift): a text's score is 1 / (1 + exp(-(weights . x + shift)))."""
    return fitted(lambda f: f(x, y), **options)


def added(rows: DataFrame):
    """The sums of fitted() over a table (doc_id, x, label), made by its tasks; the driver gets one result of each."""

    def sums(f):
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = text_bytes(batch.column(1))[0].view(np.float64).reshape(batch.num_rows, -1)
                    part = f(x, as_long(batch.column(2)) == 1)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["n", "shape"])

        parts = [np.frombuffer(r.n).reshape(r.shape) for r in rows.mapInArrow(run, "n binary, shape array<int>").collect()]
        return sum(parts) if parts else None

    return sums


def fit(training: DataFrame, few: int = 8000, **options) -> tuple[np.ndarray, float]:
    """The model of all training rows; without rows of both labels every score is 0.5. Up to `few` rows are fitted in the driver, more by jobs over their table."""
    rows = written(matrix(training, ("label",)), "quality-rows")
    if rows.count() > few:
        model = fitted(added(rows), **options)
    else:
        here = sorted(rows.collect())
        model = fit_rows(np.frombuffer(b"".join(r.x for r in here)).reshape(len(here), -1), np.array([r.label for r in here], bool), **options) if here else None
    drop(rows)
    return model or (np.zeros(len(vector(""))), 0.0)


def quality(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. Trains on all labelled rows that are not held out."""
    shares = labels.where(~held_out() & F.col("quality").isin(0, 1)).agg(F.avg(1 - F.col("quality"))).first()[0]
    weights, shift = fit(labelled(docs, labels, "quality"), at=at, bad_share=shares)

    def scored(batches):
        for batch in batches:
            # one text at a time, so that a text's score doesn't hang on its batch
            s = [1 / (1 + math.exp(-min(max(float((vector(t) * weights).sum()) + shift, -40.0), 40.0))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scores = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
