import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftcorpus.llm import jaccard, lsm_dedup, substrings
from weftcorpus.llm.common import bloom_of
from weftcorpus.llm.components import components
from weftcorpus.llm.shingles import shingle_sets

SPACE = "[\x20\x09-\x0d]"


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


# exact dedup


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)[3]
        out += [(m[3], best, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1, "bits_log2": 8}, {"memtable_bytes": 200}])
def test_groups_are_those_of_equal_texts(spark, tables, options):
    """Also when digests collide, so that only bytes tell texts apart, and when every task flushes many runs."""
    docs = documents(spark, tables)
    got = lsm_dedup.exact_groups(docs, **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_rows_without_copies(spark, tables, empty):
    docs = documents(spark, tables)
    out = lsm_dedup.without_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub(SPACE, "", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(SPACE, "", r.text or "") for r in docs.collect()})
    assert lsm_dedup.op10(spark, empty).count() == 0


# shingles and the join


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))


def shingles(t, k=5):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé中 \n\t", max_size=30), min_size=1, max_size=8))
def test_hashed_sets_are_the_sets(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, a in enumerate(texts):
        assert len(got[i]) == len(shingles(a))
        for j, b in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(a) & shingles(b))


def expected_components(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(words, k):
    words = list(words)
    for _ in range(k):
        words[random.randrange(len(words))] = f"w{random.randrange(10**6)}"
    return " ".join(words)


def test_components_are_those_of_all_pairs(spark, tables):
    """Near copies at all distances around the threshold, a passage that many share, and the odd rows."""
    random.seed(2)
    passage = [f"p{i}" for i in range(40)]
    rows = [(r.doc_id, r.text) for r in documents(spark, tables).collect()]
    for g in range(12):
        base = [f"b{g}x{i}" for i in range(random.choice([6, 30, 120, 400]))]
        rows += [(1000 + 100 * g + j, edited(base, random.randrange(0, max(2, len(base) // 20)))) for j in range(12)]
    rows += [(5000 + j, " ".join([f"u{j}v{i}" for i in range(random.randrange(60))] + passage)) for j in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in jaccard.near_groups(df).collect()}
    want = expected_components(rows)
    assert {i: r.component_id for i, r in got.items() if i is not None} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in rows) and got[None].component_id is None
    kept = jaccard.without_near_copies(df)
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}


def test_cut_tiles_lose_no_pair(spark):
    random.seed(4)
    base = [f"b{i}" for i in range(60)]
    rows = [(j, edited(base, random.randrange(0, 4))) for j in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = 18
    classes = spark.sparkContext.broadcast(jaccard.cell_classes(df, bits, 5))
    v = jaccard.indexed(df, classes, bits, 5, 80).withColumnRenamed("doc_id", "v").cache()
    postings = jaccard.shared_keys(v.select(F.explode("keys").alias("key"), "v", "n"), 80)
    none = spark.createDataFrame([], "v long, root long")
    found = [{tuple(r) for r in jaccard.tiles(postings, v, none, 80, tile_rows=k).collect()} for k in (8192, 5)]
    sets = {i: shingles(t) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert found[0] == found[1] >= links


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(0)
    for n in (3, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
        x, y = jaccard.folded([jaccard.signature(a), jaccard.signature(b)])
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_rows_of_one_id_are_one_document(spark):
    """To the near-copies stage: unlike texts under one id stay or go together; columns of any name pass through."""
    random.seed(6)
    text = lambda: " ".join(random.choice("abcdefghijklmnop") * random.randrange(1, 5) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x", 0), (2, a + " end", "y", 1), (2, b, "z", 2), (3, c, "z", 3), (3, c, "z", 4), (None, a, "w", 5), (4, None, "w", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, root int")
    out = jaccard.without_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.root for r in out.collect())) == [0, 3, 4, 5, 6]


def test_near_groups_of_nothing(spark, empty):
    assert jaccard.op9(spark, empty).count() == 0


def test_components_of_paths_and_stars(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + random.randrange(30), 200 + random.randrange(30)) for _ in range(25)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_bloom_has_what_went_in(spark):
    ids = spark.range(0, 5000, 3)
    b = bloom_of(ids, "id")
    x = np.arange(5000)
    has = b.may_have(x)
    assert has[x % 3 == 0].all() and has[x % 3 != 0].mean() < 0.1


# repeated substrings


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(b[k] for k in range(len(b)) if not gone[k])).hexdigest())
    return out


def odd_texts():
    random.seed(3)
    rows = [(i, " ".join(random.choice(["alpha", "beta", "gam", "de"]) for _ in range(random.choice([3, 30, 200])))) for i in range(60)]
    base = " ".join(random.choice("abcdefghijklmnop") * random.randrange(1, 6) for _ in range(300))
    noise = lambda: "".join(random.choice("xyz") for _ in range(random.randrange(80)))
    rows += [(100 + i, noise() + base[random.randrange(300) : random.randrange(400, 900)] + noise()) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "ab" * 300), (303, "ab" * 100), (304, base), (305, base), (None, base), (306, "é" * 120), (307, base), (307, base)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{"length": 20, "gram": 6}, {}, {"length": 20, "gram": 6, "most_contexts": 3}, {"length": 20, "gram": 6, "block_bytes": 500}, {"length": 20, "gram": 6, "piece": 64}])
def test_removed_bytes_are_those_of_a_scan(spark, options):
    rows = odd_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, options.get("length", 100))
    got = substrings.without_repeats(df, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[1:5]) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_rows_without_an_id_of_their_own(spark):
    """Unlike texts of a null or repeated doc_id are documents of their own, in the order of a hash; equal rows are one."""
    random.seed(8)
    prose = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d = prose(60), prose(60), prose(60), prose(40)
    rows = [(1, a), (None, a), (None, b), (None, b + d), (None, None), (None, ""), (2, c), (2, c + " " + d), (2, c), (3, d), (None, prose(3)), (9, prose(50)), (9, prose(70))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    place = {(r.doc_id, r.t): (r.doc_id is None, r.doc_id or 0, r.h) for r in df.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    ordered = sorted(place, key=place.get)
    want = brute([(k, t) for k, (_, t) in enumerate(ordered)], 100)
    expected = sorted((str(i), *want[ordered.index((i, t or ""))]) for i, t in rows)
    got = substrings.without_repeats(df).collect()
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == expected
    assert [r.n_removed for r in got if r.doc_id == 9] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 9))
def test_interval_expansion_finds_equal_prefixes(raw, length):
    text = np.frombuffer(raw, np.uint8)
    order, group = substrings.equal_prefixes(text, length)
    twice = raw * (length + 1)
    prefix = [twice[i : i + length] for i in order]
    assert prefix == sorted(prefix)
    assert all((group[i] == group[i + 1]) == (prefix[i] == prefix[i + 1]) for i in range(len(raw) - 1))


def test_no_repeats_of_nothing(spark, empty):
    assert substrings.op7(spark, empty).count() == 0


def test_only_rows_with_a_partner_in_reach_are_posted_and_led(spark):
    """Rows of a key whose sizes no other row's size allows are not posted; leaders follow the sizes."""
    # key 1: 64 and 79 reach each other, 50 and 100 nobody; key 4: seven pairs of equal sizes far apart
    rows = [(1, 10, 100), (1, 11, 50), (1, 12, 79), (1, 13, 64), (2, 10, 100), (2, 14, 20), (3, 15, 5), *((4, 20 + i, 10 * 2 ** (i // 2)) for i in range(14))]
    got = {(r.key, r.v): r.leader for r in jaccard.shared_keys(spark.createDataFrame(rows, "key long, v long, n long"), 80).collect()}
    assert got == {(1, 13): 13, (1, 12): 13} | {(4, 20 + i): 20 + i // 2 * 2 for i in range(14)}


@pytest.mark.parametrize("options", [{}, {"most": 300, "few": 0}])
def test_near_misses_leave_no_pairs(spark, options):
    """Rows that link with their base alone, not with each other: edges stay fewer than rows, and join what all pairs join."""
    random.seed(9)
    base = [f"b{i}" for i in range(104)]
    # two words replaced spoil 7 shingles of 100: 87 % with the base, 75 % with those that replace elsewhere
    rows = [(0, " ".join(base))]
    rows += [(j, " ".join(f"e{j}" if i in (p, p + 2) else w for i, w in enumerate(base))) for j in range(1, 91) for p in [5 + 7 * (j % 13)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bits = 18
    classes = spark.sparkContext.broadcast(jaccard.cell_classes(df, bits, 5))
    v = jaccard.indexed(df, classes, bits, 5, 80).withColumnRenamed("doc_id", "v").cache()
    postings = jaccard.shared_keys(v.select(F.explode("keys").alias("key"), "v", "n"), 80)
    none = spark.createDataFrame([], "v long, root long")
    edges = jaccard.tiles(postings, v, none, 80, spanning=True).cache()
    pairs = jaccard.tiles(postings, v, none, 80)
    families = {r.v: r.root for r in components(edges).collect()}
    assert families == {r.v: r.root for r in components(pairs).collect()}
    assert edges.count() < 4 * len(rows) < pairs.count()
    found = jaccard.settled(spark.createDataFrame(list(families.items()), "v long, root long"), v, none, df, 5, 80, **options).collect()
    got = {r.v: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == expected_components(rows)
    assert options or len(found) == len(got) - len(set(got.values()))
