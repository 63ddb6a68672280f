import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftcorpus.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def placed(lengths, capacity, unit):
    """All pieces of documents of these lengths through a plan; checks that they cover the documents and the sequences."""
    ranks, sizes, own = Counter(), [], []
    for n in lengths:
        while n > 0:
            sizes.append(min(n, capacity))
            own.append(ranks[sizes[-1]])
            ranks[sizes[-1]] += 1
            n -= capacity
    plan = packing.Plan(dict(ranks), capacity, unit)
    piece, skip, size, sequence, offset = (x.tolist() for x in plan.place(np.array(sizes, np.int64), np.array(own, np.int64)))
    covered, filled = defaultdict(list), defaultdict(list)
    for p, s, n, q, o in zip(piece, skip, size, sequence, offset):
        covered[p].append((s, n))
        filled[q].append((o, n))
    assert sorted(covered) == list(range(len(sizes))) and sorted(filled) == list(range(plan.sequences))
    for parts, total in [(covered[i], n) for i, n in enumerate(sizes)] + [(x, None) for x in filled.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == total if total else at == capacity or at < capacity and at & (at - 1) == 0
    return plan, sum(len(x) > 1 for x in covered.values()), filled


def test_every_plan_covers_everything_without_padding():
    random.seed(4)
    for _ in range(150):
        most = random.choice([3, 40, 150])
        placed([random.randrange(1, most) for _ in range(random.randrange(300))], 64, random.choice([1, 4, 16]))
    for lengths in ([], [1], [2048], [2049], [4096], [2047] * 50, [1500] * 300, [2] * 3000, [1] * 3):
        placed(lengths, 2048, 16)


def test_few_documents_are_cut():
    random.seed(5)
    lengths = [int(random.lognormvariate(5.5, 1)) % 2047 + 1 for _ in range(4000)]
    plan, cut, filled = placed(lengths, 2048, 16)
    assert cut < 0.08 * len(lengths) and len(filled) <= -(-sum(lengths) // 2048) + 11
    assert plan.times.sum() > 0.9 * len(filled)


def test_a_pattern_is_as_good_as_any():
    # the relaxed optimum of a small instance by hand: 3+3+2 twice, 5+3 once leave nothing
    lengths, counts = np.array([2, 3, 5]), np.array([2, 5, 1])
    used = packing.relaxed(lengths, counts, 8)
    assert sum(x * 8 for x in used.values()) == pytest.approx(float(lengths @ counts))
    best, last = packing.priced(lengths, np.array([2.0, 3.5, 5.0]), 8)
    assert best[8] == 9.0 and last[1] == -1 and best[1] == -np.inf  # 3 + 3 + 2


def strange():
    random.seed(2)
    some = ["", " ", "don't WE'LL İi ǅ ß ΑΣ Σ", "a<|endoftext|>b<|startoftext|>", "x" * 5000, "é ́e e f\x1cg\x85h i　j", "1234 ½ ² ٣", "\t\n\r\x0b\x0c", "…—“q”", "한국어 中文 ไทย", "a ́b ᄀ ᅡ", "J̌. J̌ ǰ, Åx Å. H̱! É. a.̈ É.", "a|b | |c. 's, 'S. it's. IT'S! 12. a1, ..., A.B. x?! :", "A<|endoftext|>. <|ENDOFTEXT|>."]
    return some + ["".join(random.choice("abE thiN'\n\t\x0b\x85́ 12éß中<|>.,") for _ in range(80)) for _ in range(200)]


def test_words_are_encoded_as_the_library_does():
    texts, spec = strange(), open(PATH, encoding="utf-8").read()
    want = library(texts)

    def each(words, texts):
        ids, at = words.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(at, at[1:])]

    assert each(packing.Words(spec), texts) == want
    small = packing.Words(spec, known=3, longest=4, together=3)
    assert [each(small, [t])[0] for t in texts] == want
    assert each(small, texts[3:40]) == want[3:40] and each(small, []) == []


def check(rows, docs):
    """Pieces against the library's ids; rows of one id may come in any order."""
    want = Counter()
    for (doc, _), ids in zip(docs, library([t for _, t in docs])):
        want[doc, len(ids) + 1] += 1
    assert sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    whole = {doc: np.array(ids + [1], "<u4") for (doc, _), ids in zip(docs, library([t for _, t in docs]))}
    once = {doc for doc, n in Counter(d for d, _ in docs).items() if n == 1 and doc is not None}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        if r.doc_id in once:
            assert r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
    for doc in once:
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(whole[doc])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_pieces_of_documents(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    check(packing.op13(spark, tables).collect(), docs)


def test_hot_length_and_strange_texts(spark):
    docs = [(i, "word " * 700) for i in range(400)] + list(enumerate(strange(), 5000)) + [(9000, None), (9001, "a b c " * 30_000)]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), PATH).collect()
    check(rows, docs)


def test_bases_that_are_joined(spark, monkeypatch):
    # the way without a broadcast gives the same
    docs = spark.createDataFrame([(i, "some words " * (i % 90)) for i in range(300)], "doc_id long, text string").repartition(4, "doc_id")
    want = sorted(map(tuple, packing.packed(docs, PATH).collect()))
    monkeypatch.setattr(F, "broadcast", lambda df: df)
    assert sorted(map(tuple, packing.packed(docs, PATH).collect())) == want


def test_packing_nothing(spark, empty):
    assert packing.op13(spark, empty).count() == 0
