import hashlib
import math

import duckdb
import numpy as np
import pytest

from weftcorpus.llm import lloyd, norm_codes

KIND = "vec_id long, embedding array<float>, label int, code string, x long"


def rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)).astype(np.float32) * np.float32(0.4)
    x[100:160] = x[100]  # copies, so ties between rows and equal first entries
    x[3] = x[5]
    out = [(i, [float(v) for v in r], int(i % 4) if i % 7 else None, "clash", 1) for i, r in enumerate(x)]
    out += [(900, None, 1, "c", 1), (901, [None] + [0.5] * 63, 1, "c", 1), (902, [math.inf] + [0.5] * 63, 1, "c", 1), (903, [math.nan] * 64, None, "c", 1), (904, [0.25] * 32, 2, "c", 1), (905, [], 2, "c", 1)]
    return out + [(None, [0.125] * 64, 3, "c", 1), (7, out[7][1], 2, "c", 1), (906, [0.0] * 64, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows(), KIND).repartition(5).write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("no-vectors"))
    spark.createDataFrame([], KIND).write.parquet(f"{where}/embeddings.parquet")
    return where


def kept(scale):
    usable = [(i, v, label) for i, v, label, *_ in rows() if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(scale * c) for c in v], label) for i, v, label in usable]


def full_search(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(entries))


def improved(parts, entries):
    out = list(entries)
    near = [full_search(x, entries)[1] for x in parts]
    for j in set(near):
        own = [x for x, n in zip(parts, near) if n == j]
        out[j] = [sum(c) // len(own) for c in zip(*own)]
    return out


def by_id(i):
    return (i is None, i or 0)


def test_pruned_search_is_the_full_search():
    rng = np.random.default_rng(3)
    for case in range(60):
        k, w = int(rng.integers(1, 17)), int(rng.integers(1, 9))
        reach = (2, 40, 1 << 27)[case % 3]  # small numbers tie often
        entries, x = rng.integers(-reach, reach, (k, w)), rng.integers(-reach, reach, (200, w))
        near, d, evaluated = norm_codes.nearest(x, entries)
        assert evaluated <= 200 * k
        want = [full_search(r, entries.tolist()) for r in x.tolist()]
        assert list(zip(d.tolist(), near.tolist())) == want


def test_norms_prune():
    x = np.array([[100 * i + 1, 0] for i in range(16)] * 50)
    assert norm_codes.nearest(x, x[:16])[2] <= 2 * len(x)


def test_codes_are_those_of_a_full_search(spark, folder):
    data = kept(4096)
    first = sorted(data, key=lambda r: (by_id(r[0]), r[1]))[:16]
    books = []
    for p in range(8):
        own, entries = [x[8 * p : 8 * p + 8] for _, x, _ in data], [x[8 * p : 8 * p + 8] for _, x, _ in first]
        for _ in range(6):
            entries = improved(own, entries)
        books.append(entries)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    want, totals = [], {}
    for i, x, label in data:
        found = [full_search(x[8 * p : 8 * p + 8], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        totals[label] = totals.get(label, 0) + error
        want.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    got = norm_codes.op11(spark, folder).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == sorted(((i, c, e, totals[label], sha) for i, c, e, label in want), key=str)


def test_clusters_are_those_of_plain_lloyd(spark, folder):
    data = kept(1024)
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [x for _, x, _ in sorted(data, key=lambda r: (digest(r[0]), r[1]))[:8]]
    for _ in range(10):
        centroids = improved([x for _, x, _ in data], centroids)
    found = [(i, *full_search(x, centroids)) for i, x, _ in data]
    inertia = [sum(d for _, d, j in found if j == c) for c in range(8)]
    want = [(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]
    assert sorted(map(tuple, lloyd.op12(spark, folder).collect()), key=str) == sorted(want, key=str)


def test_sql_says_the_same(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    for query, sql in ((norm_codes.op11, norm_codes.oracle()), (lloyd.op12, lloyd.oracle())):
        got = query(spark, folder)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_few_vectors_and_none(spark, nothing, tmp_path):
    for query in (norm_codes.op11, lloyd.op12):
        assert query(spark, nothing).count() == 0
    spark.createDataFrame(rows()[:3], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.error for r in norm_codes.op11(spark, str(tmp_path)).collect()] == [0, 0, 0]
    assert [r.inertia for r in lloyd.op12(spark, str(tmp_path)).collect()] == [0, 0, 0]


def test_components_beyond_exact_distances(spark):
    with pytest.raises(Exception, match="too large for exact"):
        norm_codes.codes(spark.createDataFrame([(1, [1e30] * 8, 0)], "id long, embedding array<float>, label int")).collect()
