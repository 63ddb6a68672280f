"""Exact dedup by a log-structured merge index.

Each task is a memtable: it takes the digests of its documents, merges equal
ones after comparing bytes, and flushes a run sorted by digest whenever it holds
memtable_bytes of text. A filter over all runs (two bits a cell, of bounded
size) tells which digests were seen more than once anywhere; only those entries
carry their text on. Compaction merges the runs by digest and bytes, keeping the
longest original and then the smallest identifier; grouping on the bytes
themselves is the verification of a hit. A group of copies reaches compaction
as one entry a run, so no task ever sees a whole group.

Edge cases: null text counts as empty; all empty texts are equal; a null doc_id
loses ties; rows that repeat a doc_id are separate rows, of which one stays.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.llm.common import SPACE, as_long, table, text_bytes, written

RUN_SCHEMA = "key binary, sha binary, tag binary, run long, best_len long, best_id long, best_row long, n long, ids array<long>, rows array<long>, norm binary"
_DELETE = SPACE.encode()
_FAR = 1 << 62


def _normalised(column):
    data, at = text_bytes(column)
    raw = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        text = raw[a:b]
        yield text.translate(None, _DELETE), text


def _code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def repeat_filter(docs: DataFrame, digest_bytes: int, bits_log2: int) -> np.ndarray:
    """A bit for each cell that two or more rows fall into, built by the executors slice by slice."""
    slice_log2 = min(20, bits_log2)
    slice_cells = 1 << slice_log2

    def cells(batches):
        for batch in batches:
            at = np.array([int.from_bytes(hashlib.sha256(n).digest()[:digest_bytes][:8], "little") & ((1 << bits_log2) - 1) for n, _ in _normalised(batch.column(0))], np.int64)
            at.sort()
            cut = np.searchsorted(at, np.arange(0, (1 << bits_log2) + slice_cells, slice_cells))
            rows = [(i, (at[a:b] & (slice_cells - 1)).astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "at"])

    def twice(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                once, more = seen.setdefault(i, [np.zeros(slice_cells // 8 or 1, np.uint8), np.zeros(slice_cells // 8 or 1, np.uint8)])
                cell, count = np.unique(np.frombuffer(at, np.uint32), return_counts=True)
                bit = (1 << (cell & 7)).astype(np.uint8)
                again = (count > 1) | ((once[cell >> 3] & bit) > 0)
                np.bitwise_or.at(more, cell[again] >> 3, bit[again])
                np.bitwise_or.at(once, cell >> 3, bit)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([zlib.compress(m.tobytes(), 1) for _, m in seen.values()], pa.binary())], ["slice", "bits"])

    out = np.zeros(max(1, (1 << bits_log2) // 8), np.uint8)
    size = slice_cells // 8 or 1
    for row in docs.select("text").mapInArrow(cells, "slice int, at binary").repartition("slice").mapInArrow(twice, "slice int, bits binary").collect():
        out[row.slice * size : (row.slice + 1) * size] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def flush_runs(docs: DataFrame, repeats, digest_bytes: int, bits_log2: int, memtable_bytes: int) -> DataFrame:
    """docs (doc_id, row, text) as runs of RUN_SCHEMA; entries that no other row can equal have null norm."""

    def memtables(batches):
        more, mask = repeats.value, (1 << bits_log2) - 1
        held, size, run = {}, 0, None

        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[]] * 11
            kinds = [pa.binary()] * 3 + [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def flush():
            for part in range(0, len(order := sorted(held)), 500):
                yield batch_of([e for k in order[part : part + 500] for e in held[k]])

        for batch in batches:
            singles = []
            ids = batch.column(0).to_pylist()
            rows = as_long(batch.column(1)).tolist()
            for i, row, (norm, text) in zip(ids, rows, _normalised(batch.column(2))):
                run = row if run is None else run
                sha, length = hashlib.sha256(norm).digest(), _code_points(text)
                key = sha[:digest_bytes]
                cell = int.from_bytes(key[:8], "little") & mask
                if not more[cell >> 3] >> (cell & 7) & 1:
                    singles.append((key, sha, b"", run, length, i, row, 1, [i], [row], None))
                    continue
                entries = held.setdefault(key, [])
                for e in entries:
                    if e[10] == norm:  # the bytes decide, not the digest
                        e[7] += 1
                        e[8].append(i)
                        e[9].append(row)
                        if (-length, i is None, i or 0, row) < (-e[4], e[5] is None, e[5] or 0, e[6]):
                            e[4:7] = [length, i, row]
                        size += 16
                        break
                else:
                    entries.append([key, sha, xxhash.xxh128_digest(norm), run, length, i, row, 1, [i], [row], norm])
                    size += len(norm) + 200
                if size > memtable_bytes:
                    yield from flush()
                    held, size, run = {}, 0, row
            yield batch_of(singles)
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(memtables, RUN_SCHEMA)


def compact(runs: DataFrame) -> DataFrame:
    """One row for each distinct text among the runs' verified entries."""
    rank = F.struct((-F.col("best_len")).alias("a"), F.coalesce("best_id", F.lit(_FAR)).alias("b"), F.col("best_row").alias("c"), F.col("best_id").alias("id"))
    return (
        runs.where("norm IS NOT NULL")
        .groupBy("key", "sha", "tag", "norm")
        .agg(F.min(rank).alias("best"), F.sum("n").alias("group_size"))
        .select("sha", "tag", F.col("best.id").alias("keep_id"), F.col("best.c").alias("keep_row"), "group_size")
    )


def exact_groups(docs: DataFrame, digest_bytes: int = 32, bits_log2: int | None = None, memtable_bytes: int = 32 << 20, row: str | None = None) -> DataFrame:
    """Each row of docs with the row that stays of its group: doc_id, row, keep_id,
    group_size, kept, text_sha256. row names a column that tells rows apart."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    if bits_log2 is None:
        # 16 cells a row, 32 MB at most: beyond that more single texts travel, and results stay exact
        bits_log2 = min(28, max(20, (16 * docs.count()).bit_length()))
    repeats = spark.sparkContext.broadcast(repeat_filter(docs, digest_bytes, bits_log2))
    runs = written(flush_runs(docs, repeats, digest_bytes, bits_log2, memtable_bytes), "runs")
    repeats.destroy()
    winners = written(compact(runs), "winners")
    hits = runs.where("norm IS NOT NULL").select("sha", "tag", "ids", "rows").join(winners, ["sha", "tag"])
    members = hits.select("sha", "keep_id", "keep_row", "group_size", F.explode(F.arrays_zip("ids", "rows")).alias("m")).select(
        F.col("m.ids").alias("doc_id"), F.col("m.rows").alias("row"), "keep_id", "group_size", (F.col("m.rows") == F.col("keep_row")).alias("kept"), "sha"
    )
    singles = runs.where("norm IS NULL").select(F.col("best_id").alias("doc_id"), F.col("best_row").alias("row"), F.col("best_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return singles.unionByName(members).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay of their groups. Rows are numbered in a written table: a second
    scan of docs may be cut into other partitions, or come in another order."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    gone = written(exact_groups(rows, row="_row").where("NOT kept").select(F.col("row").alias("_row")), "gone")
    few = gone.count() <= 1_000_000
    return rows.join(F.broadcast(gone) if few else gone, "_row", "left_anti").select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


ORACLE = r"""
WITH n AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(coalesce(text, '')) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
