"""Vector codes whose nearest entries are found by annular norm pruning.

A vector of whole numbers is cut into equal parts; each part has a codebook that
rounds of assigning and averaging improve. A part's nearest entry is found among
the entries sorted by norm: an entry nearer than the best so far has a norm that
differs from the part's by that distance at most, so a binary search gives the
interval of entries that are worth evaluating, both ends included, and it shrinks
with every better entry. What is evaluated is exact, so the result is that of a
full search.

The vectors are written once as whole numbers. A round reads them, adds up counts
and sums inside each partition and merges these by entry; the driver holds the
codebooks, whose size depends on parameters alone.

Edge cases: vectors that are null or have null or non-finite components take no
part; neither do vectors of another length than most (of equally frequent lengths
the smallest counts), nor those whose length isn't a multiple of the number of
parts; null ids come last in the choice of first entries, rows that repeat an id
are rows of their own, of which the smaller vector comes first; with fewer rows
than entries each row is an entry; null labels are one label; other columns aren't
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import drop, table, written
from weftcorpus.llm.whole_vectors import matrix, sums_by, whole


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of each row's nearest entry (ties: the lower one), the squared distance, and how many distances that took."""
    k, n = len(entries), len(x)
    squares = (entries * entries).sum(1)
    order = np.lexsort((np.arange(k), squares))
    norms, by_norm = np.sqrt(squares[order].astype(np.float64)), entries[order]
    own = np.sqrt((x * x).sum(1).astype(np.float64))
    # the entry of nearest norm is the first guess
    right = np.minimum(np.searchsorted(norms, own), k - 1)
    left = np.maximum(right - 1, 0)
    at = np.where(own - norms[left] <= norms[right] - own, left, right)
    best, d = order[at], ((x - by_norm[at]) ** 2).sum(1)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def annulus(rows):
        # a little wider than the distance, for the rounding of roots
        reach = np.sqrt(d[rows].astype(np.float64))
        slack = 1e-9 * (own[rows] + reach + 1)
        low[rows] = np.searchsorted(norms, own[rows] - reach - slack, "left")
        high[rows] = np.searchsorted(norms, own[rows] + reach + slack, "right")

    annulus(np.arange(n))
    evaluated = n
    for step in range(1, k):
        for j in (at + step, at - step):
            rows = np.flatnonzero((j >= low) & (j < high))
            if len(rows):
                evaluated += len(rows)
                e = ((x[rows] - by_norm[j[rows]]) ** 2).sum(1)
                index = order[j[rows]]
                better = (e < d[rows]) | (e == d[rows]) & (index < best[rows])
                rows = rows[better]
                best[rows], d[rows] = index[better], e[better]
                annulus(rows)
        if not ((at + step + 1 < high) | (at - step - 1 >= low)).any():
            break
    return best, d, evaluated


def codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int, dim: int) -> np.ndarray:
    """(parts, entries, dim / parts): the first entries are those of the smallest ids. vectors: id, x."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    k, width = len(first), dim // parts
    books = np.array([r.x for r in first], np.int64).reshape(k, parts, width).transpose(1, 0, 2)
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(books)

        def sums(batches, shared=shared):
            n, s = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), dim)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    counts, added = sums_by(nearest(own, shared.value[p])[0], own, k)
                    n[p] += counts
                    s[p] += added
            used = np.flatnonzero(n.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(np.repeat(n.ravel()[used], width)), pa.array(s.reshape(-1, width)[used].ravel())], ["entry", "place", "n", "s"])

        merged = vectors.select("x").mapInArrow(sums, "entry long, place long, n long, s long").groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        books = books.copy()
        for r in merged.collect():  # parts * entries * width rows at most
            books[r.entry // k, r.entry % k, r.place] = int(r.s) // r.n
        shared.unpersist()
    return books


def codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """id, label, code, error and codebooks_sha256 of the rows (id, embedding, label) that take part, as a written table."""
    spark = rows.sparkSession
    vectors = written(whole(rows.select(F.col("id").cast("long").alias("id"), "embedding", "label"), "embedding", scale).select("id", "label", "x"), "whole-vectors")
    size = vectors.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size.n if size else 0
    schema = f"id long, label {dict(rows.dtypes)['label']}, code string, error long, codebooks_sha256 string"
    if not dim or dim % parts:
        return spark.createDataFrame([], schema)
    vectors = vectors.where(F.size("x") == dim)
    books = codebooks(vectors, parts, entries, rounds, dim)
    shared, width = spark.sparkContext.broadcast(books), dim // parts
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), dim)
            found = [nearest(x[:, p * width : (p + 1) * width], shared.value[p]) for p in range(parts)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8 if shared.value.shape[1] <= 256 else ">u2")
            text = code.tobytes().hex()
            each = len(text) // max(len(x), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[i : i + each] for i in range(0, len(text), each or 1)], pa.string()), pa.array(sum(f[1] for f in found), pa.int64()), pa.array([digest] * len(x), pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

    out = written(vectors.select("id", "label", "x").mapInArrow(run, schema), "codes")
    drop(vectors)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"))
    totals = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    # a row for each label: broadcast only while they are few
    totals = F.broadcast(totals) if totals.count() <= 100_000 else totals
    return coded.join(totals, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256", "label")


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL of op11: a full search of all entries, its rounds written one after another."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "w AS MATERIALIZED (SELECT * FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND len(x) > 0)",
        f"p AS MATERIALIZED (SELECT r, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM w, range({parts}) AS t(p) WHERE len(x) % {parts} = 0)",
        f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM w QUALIFY e < {entries})",
        "b0 AS MATERIALIZED (SELECT p.p, f.e, p.x FROM p JOIN f USING (r))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT p.p, p.r, any_value(p.x) AS x, min((list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.e)) AS m FROM p JOIN b{i} b ON p.p = b.p GROUP BY 1, 2)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT p, m[2] AS e, o, sum(x[o])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS o) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY o) AS x FROM u{i} GROUP BY 1, 2)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.x, b{i}.x) AS x FROM b{i} LEFT JOIN m{i} USING (p, e))")
    return (
        "WITH " + ",\n".join(steps) + f""",
c AS (SELECT w.vec_id, w.label, string_agg(format('{{:02x}}', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} JOIN w USING (r) GROUP BY r, w.vec_id, w.label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256, label FROM c"""
    )
