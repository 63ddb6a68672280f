"""Helpers that the training-data operators share: bounded filters and byte-level
views of Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcorpus.sources.shared import drop, shared_dir, small_batches, written

__all__ = ["Bloom", "SPACE", "as_long", "bloom_of", "drop", "freed", "held_out", "mix64", "shared_dir", "small_batches", "table", "text_bytes", "trim", "worker_cache", "written"]

#: ASCII white space, the only separators that the corpus operators know.
SPACE = " \t\n\x0b\x0c\r"

def worker_cache(key, make):
    """A value made once for each Python worker, whichever task asks first."""
    store = sys.modules.setdefault("_weft_worker_cache", type(sys)("_weft_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def freed(spark: SparkSession) -> None:
    """Has the driver's garbage collected: only then do the shuffle files of finished jobs go, which
    Spark by itself may leave on the executors' disks for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives freed memory of a worker back to the system; large arrays leave holes in its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose label training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column without copying; null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_long(column: pa.Array, null: int = -1) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


class Bloom:
    """A Bloom filter of at most max_bits over 64-bit ids. It only decides what
    travels early: with more ids than it was sized for, more rows pass and the
    join behind it still gives the exact answer."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(ids: np.ndarray, n_bits: int) -> np.ndarray:
        h = mix64(ids.astype(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(i) * step) & np.uint64(n_bits - 1) for i in range(3)]).astype(np.int64)

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def bloom_of(ids: DataFrame, column: str, max_bits: int = 1 << 26) -> Bloom:
    """Built by the executors in slices of 64 kB; the driver gets max_bits / 8 bytes at most."""
    n = ids.count()
    n_bits = 1 << 16
    while n_bits < min(16 * n, max_bits):
        n_bits *= 2
    slice_bits = 1 << 19

    def places(batches):
        for batch in batches:
            at = np.unique(Bloom.places(as_long(batch.column(0)), n_bits))
            cut = np.searchsorted(at, np.arange(0, n_bits + slice_bits, slice_bits))
            rows = [(i, at[a:b].astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "at"])

    def union(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = have.setdefault(i, np.zeros(slice_bits, bool))
                bits[np.frombuffer(at, np.uint32) & (slice_bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([zlib.compress(np.packbits(b, bitorder="little").tobytes(), 1) for b in have.values()], pa.binary())], ["slice", "bits"])

    slices = ids.select(F.col(column).cast("long").alias("id")).mapInArrow(places, "slice int, at binary").repartition("slice").mapInArrow(union, "slice int, bits binary")
    bits = np.zeros(max(n_bits, slice_bits) // 8, np.uint8)
    for row in slices.collect():
        bits[row.slice * slice_bits // 8 : (row.slice + 1) * slice_bits // 8] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return Bloom(bits[: n_bits // 8])
