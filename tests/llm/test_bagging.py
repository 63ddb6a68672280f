import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftcorpus.llm import bagging, toxicity
from weftcorpus.llm.samples import labelled

ODD = [None, "", "..a", "!", "İstanbul. ΟΔΟΣ.Σ! " * 3, "x" * 49 + " " + "é" * 24 + " " + "é" * 25 + ". " + "中" * 200 + "a", "😀 a_b 𝔘n?\nΣ's"]


@pytest.mark.parametrize("most", [5, 50, 1 << 18])
def test_arrays_are_those_of_loops(most):
    """Sentences, spans, words and hashes of whole batches as text by text, however texts are cut."""
    rng = random.Random(most)
    texts = ODD + ["".join(rng.choice("abcABZ  ..!?\n\t_09éÉΣσςİß中😀𝔘́·'٣") for _ in range(rng.randrange(150))) for _ in range(60)]
    got = [[] for _ in texts]
    for p in bagging.pieces(texts, most):
        piece = bagging.Piece(*p)
        words = [[] for _ in piece.sentence_row]
        for i, (a, b) in enumerate(zip(piece.start, piece.end)):
            assert [x for x in piece.features[i].tolist() if x < bagging.BUCKETS] == bagging.features(piece.text[a:b])
        for i in piece.distinct(np.arange(len(piece.start))):
            words[piece.of[i]].append(piece.text[piece.start[i] : piece.end[i]])
        for row, a, b, w in zip(piece.sentence_row, piece.sentence_start, piece.sentence_end, words):
            assert len(w) == len(set(w))
            got[row].append((a, b, set(w)))
    assert got == [list(bagging.sentences(t or "")) for t in texts]


def test_rounds_go_over_few_blocks(spark, tables):
    """A round reads blocks, not bags; like sentences are one kind, and the model is that of the bags one by one."""
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    sample = labelled(docs, labels, "toxic").select(F.col("doc_id"), "text", "label").cache()
    kinds = toxicity.telling(sample)
    rows = toxicity.bags(sample, kinds).cache()
    blocks = toxicity.packed(rows.coalesce(1)).collect()
    n = rows.agg(F.sum("n")).first()[0]
    assert len(blocks) == 1 and 0 < len(blocks[0].kind) // 4 < n / 2
    assert np.frombuffer(blocks[0].times, np.int32).sum() == n
    (w, b), (v, c) = toxicity.fit(sorted(rows.collect()), kinds), toxicity.descend_far(rows, kinds, each=50)
    assert b == pytest.approx(c, abs=1e-6) and v == pytest.approx(w, abs=1e-5) and np.abs(w).max() > 0
