import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcorpus.llm import quality, toxicity
from weftcorpus.llm.samples import labelled_sample


def held_out_accuracy(spark, tables, out, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if r[label] is not None}
    rows = [r for r in out.collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    return sum(r.predicted == labels[r.doc_id] for r in held) / len(held)


def test_toxic_sentences_are_learnt_from_documents(spark, tables):
    out = toxicity.op8(spark, tables).cache()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert out.count() == 250 and all(0 <= r.score <= 1 for r in out.collect())
    assert held_out_accuracy(spark, tables, out, "toxic") >= 0.9
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[300].score == rows[301].score == 0.0 and rows[300].predicted == 0
    found = [docs[i].text[s.start : s.end] for i, r in rows.items() for s in r.offending]
    assert found and sum("blasted" in t or "wretched" in t for t in found) / len(found) > 0.9
    again = {r.doc_id: r.score for r in toxicity.op8(spark, tables).collect()}
    assert again == {i: r.score for i, r in rows.items()}


def test_rows_without_toxic_ones(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.without_toxic(docs, labels)
    assert out.columns == docs.columns
    gone = docs.exceptAll(out)
    assert gone.where("text RLIKE 'blasted|wretched'").count() / max(gone.count(), 1) > 0.9


def test_quality_is_ranked(spark, tables):
    out = quality.op2(spark, tables).cache()
    assert out.count() == 250 and out.where("score BETWEEN 0 AND 1").count() == 250
    assert held_out_accuracy(spark, tables, out, "quality") >= 0.95
    assert out.where("predicted <> CAST(score >= 0.3 AS INT)").count() == 0


@pytest.mark.parametrize("op", [toxicity.op8, quality.op2])
def test_no_documents_and_no_labels(spark, tables, empty, op, tmp_path):
    assert op(spark, empty).count() == 0
    spark.read.parquet(f"{tables}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{empty}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = op(spark, str(tmp_path))
    assert out.select(F.countDistinct("score")).first()[0] == 1


def test_ranking_loss_and_slope():
    """As sums over pairs state them, and the slope as differences of the loss."""
    rng = np.random.default_rng(2)
    z, w, ridge = rng.normal(size=(12, 5)), rng.normal(size=5), np.full(5, 0.1)
    good, bad = rng.integers(0, 6, 40), rng.integers(6, 12, 40)
    loss, slope = quality.pair_loss(w, z, good, bad, ridge)
    plain = lambda w: sum(math.log(1 + math.exp(-(z[g] - z[b]) @ w)) for g, b in zip(good, bad)) / 40 + 0.05 * w @ w
    assert loss == pytest.approx(plain(w))
    assert slope == pytest.approx([(plain(w + d) - plain(w - d)) / 2e-6 for d in np.eye(5) * 1e-6], abs=1e-6)


def test_cells_count_every_three_bytes():
    assert quality.grams(b"") @ quality.grams(b"ab") == 0
    raw = bytes(np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8))
    whole, parts = quality.grams(raw), quality.grams(raw, part=64)
    assert np.array_equal(whole, parts) and (whole**2).sum() == pytest.approx(1)
    assert round((whole**2 * 4998).sum()) == 4998


def test_noisy_or_loss_falls_to_its_floor():
    """The trained weights are a stationary point of the noisy-or likelihood, written plainly."""
    rng = np.random.default_rng(1)

    class Row:
        def __init__(self, y):
            self.y, self.n = y, 4
            rows = [list(rng.choice(3, rng.integers(0, 3), replace=False) + (0 if y and k == 0 else 3)) for k in range(4)]
            self.f = np.array([x for r in rows for x in r], np.int32).tobytes()
            self.s = np.repeat(np.arange(4, dtype=np.int32), [len(r) for r in rows]).tobytes()
            self.rows = rows

    rows = [Row(i % 2) for i in range(60)]
    kinds = np.arange(6, dtype=np.int32)
    weights, b = toxicity.fit(rows, kinds, rounds=3000, rate=0.03, ridge=0.5)
    w = weights[kinds].astype(float)

    def loss(w, b):
        total = 0.0
        for r in rows:
            clean = math.prod(1 - 1 / (1 + math.exp(-(b + sum(w[x] for x in s)))) for s in r.rows)
            total -= math.log(max(1 - clean if r.y else clean, 1e-12)) / 60
        return total + 0.5 * (w @ w) / 2 / 60

    here = loss(w, b)
    for d in np.eye(6) * 1e-3:
        assert loss(w + d, b) > here - 1e-5 and loss(w - d, b) > here - 1e-5
    assert loss(w, b + 1e-2) > here - 1e-4 and loss(w, b - 1e-2) > here - 1e-4
    assert w[:3].min() > w[3:].max()


def test_samples_are_bounded_in_rows(spark):
    """An id that is repeated without end counts once; held-out, null and contradicting rows as stated."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(1, "a")] * 50 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 1)] * 9 + [(2, None), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 5).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) == 10 and sorted(r.label for r in rows) == [0] * 5 + [1] * 5
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    every = {r.doc_id: r.text for r in labelled_sample(docs, labels, "toxic", 100).collect()}
    assert None not in every and every.get(1, "a") == "a" and len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30))


def plainly(docs, labels, label):
    """(sample rows as (doc_id, text, label), all rows) by loops: labelled rows outside the held-out fifth, one text an id."""
    outside = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 0
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r[label] in (0, 1) and outside(r.doc_id):
            known[r.doc_id] = min(r[label], known.get(r.doc_id, 1))
    texts = {}
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        if r.doc_id in known and r.text is not None:
            texts[r.doc_id] = min(r.text, texts.get(r.doc_id, r.text))
    return [(i, texts.get(i), y) for i, y in sorted(known.items()) if any(r.doc_id == i for r in rows)], [(r.doc_id, r.text) for r in rows], outside


def test_quality_scores_are_those_of_loops(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    sample, rows, outside = plainly(docs, labels, "quality")
    known = [r.quality for r in labels.collect() if r.quality in (0, 1) and outside(r.doc_id)]
    x = np.array([quality.vector(t) for _, t, _ in sample])
    weights, shift = quality.fit_rows(x, np.array([y for *_, y in sample], bool), at=0.3, bad_share=1 - sum(known) / len(known))

    def loop(text):
        raw, cells = (text or "").encode(), [0] * quality.CELLS
        for i in range(len(raw) - 2):
            h = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % (1 << 32)
            cells[h >> (33 - quality.CELLS.bit_length())] += 1
        v = [*map(float, quality.features(text)), *(math.sqrt(c / max(sum(cells), 1)) for c in cells)]
        return 1 / (1 + math.exp(-(math.fsum(a * b for a, b in zip(v, weights.tolist())) + shift)))

    want = {(i, t): loop(t) for i, t in rows}
    got = quality.op2(spark, tables).join(docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("c")).distinct(), "doc_id")
    by_id = {}
    for (i, t), p in want.items():
        by_id.setdefault(i, []).append(p)
    for r in got.collect():
        assert min(abs(r.score - p) for p in by_id[r.doc_id]) < 1e-6
        assert r.held_out == (not outside(r.doc_id)) and r.predicted == int(r.score >= 0.3)
    assert quality.op2(spark, tables).count() == len(rows)


def test_toxicity_scores_are_those_of_loops(spark, tables):
    """Noisy-or over sentences by plain loops, with the model's weights."""
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = model = toxicity.train(docs, labels, 3000)

    def loop(text):
        clean = 1.0
        for start, end, words in toxicity.sentences(text or ""):
            z = bias + sum(float(weights[toxicity.features(w)].sum()) for w in words)
            clean *= 1 - 1 / (1 + math.exp(-max(min(z, 40), -40)))
        return 1 - clean

    rows = docs.select("doc_id", "text").collect()
    got = {(r.doc_id, r.n): r for r in toxicity.toxicity(docs, labels, model=model).join(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).distinct(), "doc_id").collect()}
    for r in rows:
        if r.doc_id is not None and r.doc_id not in (302, 303):
            assert abs(got[r.doc_id, len(r.text or "")].score - loop(r.text)) < 1e-6
    same = {r.doc_id: r.score for r in toxicity.op8(spark, tables).where("doc_id IS NOT NULL").collect()}
    assert all(abs(same[i] - got[k].score) < 1e-9 for k in got if (i := k[0]) not in (302, 303))


def test_very_long_texts_are_scored_whole(spark, tables):
    long = "a calm word here. " * 200_000 + "what a blasted wretched thing. " * 3
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    model = toxicity.train(docs, labels, 3000)
    one = spark.createDataFrame([(7001, long)], "doc_id long, text string")
    got = toxicity.toxicity(one, labels, model=model).first()
    assert got.predicted == 1 and len(got.offending) == 3 and min(x.start for x in got.offending) >= 18 * 200_000 - 1
    assert len(quality.vector(long)) == len(quality.vector("x"))


def test_all_pairs_are_those_listed():
    rng = np.random.default_rng(4)
    s, y = rng.normal(size=70) * 6, rng.random(70) < 0.4
    good, bad = (g.ravel() for g in np.meshgrid(np.flatnonzero(y), np.flatnonzero(~y)))
    loss, slope = quality.pair_loss(np.ones(1), s[:, None], good, bad, np.zeros(1))
    got, table = quality.all_pairs(quality.laid(s, y))
    at, weights = quality.nodes(s)
    pull = (np.where(y, table[1][at], table[0][at]) * weights).sum(axis=0)
    assert got == pytest.approx(loss, abs=1e-6) and (pull * s).sum() == pytest.approx(slope[0], abs=1e-6)


def test_quality_is_learnt_from_every_row(spark, tables):
    """One model whether the driver or jobs add up; more rows of a class than any sample held count."""
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.labelled(docs, labels, "quality").cache()
    assert rows.count() == len(plainly(docs, labels, "quality")[0])
    assert rows.count() == quality.labelled(docs, labels, "quality", few=0).count()
    (w, shift), (v, moved) = quality.fit(rows), quality.fit(rows, few=0)
    assert shift == pytest.approx(moved, abs=1e-6) and w == pytest.approx(v, abs=1e-6 * np.abs(w).max())
    many = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "CAST(id % 2 AS INT) AS quality")
    want = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30_000))
    assert quality.labelled(many, many.drop("text"), "quality").count() == want > 2 * 8000


def test_toxicity_is_learnt_from_every_row(spark, tables):
    """One model whether the driver or jobs add up over all training rows; those over any sample's size count."""
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    (w, b), (v, c) = toxicity.train(docs, labels), toxicity.train(docs, labels, few=0)
    assert b == pytest.approx(c, abs=1e-6) and np.abs(w).max() > 0 and v == pytest.approx(w, abs=1e-5)
    rows = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "CAST(id % 2 AS INT) AS toxic")
    seen = {r.label: r.n for r in toxicity.labelled(rows, rows.drop("text"), "toxic").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert min(seen.values()) > 2 * 3000
