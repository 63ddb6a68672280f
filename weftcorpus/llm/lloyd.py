"""Centroid clustering by plain Lloyd over whole-number vectors.

The centroids are broadcast; mapInPandas computes the squared distance to each
centroid in whole numbers with NumPy and takes the lowest index of the least; sums
and counts of each partition are merged through groupBy. The vectors are written
once and read in every round; the driver holds k centroids and nothing else.

Edge cases: only vectors with exactly `dim` components take part, none of them null
or non-finite; null ids come last in the choice of first centroids, rows that repeat
an id are rows of their own, of which the smaller vector comes first; with fewer
vectors than centroids each is one; empty clusters keep their centroid; other columns
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import drop, table, written
from weftcorpus.llm.whole_vectors import sums_by, whole


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and the squared distance."""
    near, d = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        e = ((x - centre) ** 2).sum(1)
        closer = e < d
        near[closer], d[closer] = c, e[closer]
    return near, d


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose seeded ids have the smallest hashes, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def clustered(rows: DataFrame, k: int = 8, dim: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of the rows (id, embedding) that take part, as a written table, and the final centroids."""
    spark, schema = rows.sparkSession, "id long, cluster int, distance long"
    sized = rows.where(F.size("embedding") == dim).select(F.col("id").cast("long").alias("id"), "embedding")
    vectors = written(whole(sized, "embedding", scale).select("id", "x"), "whole-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(frames, shared=shared):
            n, s = np.zeros(len(shared.value), np.int64), np.zeros_like(shared.value)
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["x"].to_numpy())
                    counts, added = sums_by(assigned(x, shared.value)[0], x, len(n))
                    n += counts
                    s += added
            used = np.flatnonzero(n)
            yield pd.DataFrame({"cluster": np.repeat(used, dim), "place": np.tile(np.arange(dim), len(used)), "n": np.repeat(n[used], dim), "s": s[used].ravel()})

        merged = vectors.select("x").mapInPandas(sums, "cluster long, place long, n long, s long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in merged.collect():  # k * dim rows at most
            centroids[r.cluster, r.place] = int(r.s) // r.n
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centroids)

    def run(frames):
        for frame in frames:
            near, d = assigned(np.stack(frame["x"].to_numpy()), shared.value) if len(frame) else (np.zeros(0, int), np.zeros(0, int))
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "cluster": near.astype(np.int32), "distance": d})

    out = written(vectors.select("id", "x").mapInPandas(run, schema), "clusters")
    drop(vectors)
    return out, centroids


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    each = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    totals = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, dim: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL of op12, its rounds written one after another."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min((list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.c)) AS m FROM v, c{i} c GROUP BY v.r)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT m[2] AS c, o, sum(x[o])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS o) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY o) AS x FROM u{i} GROUP BY 1)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, m[2]::INT AS cluster, m[1] AS distance, sum(m[1]) OVER (PARTITION BY m[2])::BIGINT AS cluster_inertia, sum(m[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = m[2]"""
    )
