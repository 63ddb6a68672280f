"""Near-duplicate removal on streams: the bands of kept rows are the state, and they expire.

A micro-batch meets the bands of the rows kept so far; rows that share one go, the
rest are deduplicated among themselves as a table is, and the bands of what stays join
the state. The state is a folder with a part for each batch, written again as a whole
when a batch is replayed, so a query that restarts gives the same rows once. A part
goes when its latest row is more than `delay` seconds older than the latest row seen.

As long as no state has expired, the result is that of MinHashDeduplicator over all rows
at once, if ids grow in the order of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcorpus.operators.dedup import MinHashDeduplicator
from weftcorpus.sources.shared import children, drop, remove, written

_STATE = "band int, hash long, seen timestamp"


@dataclass(frozen=True)
class NearDuplicateStream:
    folder: str
    dedup: MinHashDeduplicator = field(default_factory=MinHashDeduplicator)
    time: str = "ts"
    delay: int = 600

    def __post_init__(self):
        if self.dedup.verify:
            raise ValueError("a stream keeps bands, not texts: verify needs the texts of kept rows")

    def kept(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a micro-batch that stay, as a written table; the state then has their bands."""
        spark, name = batch.sparkSession, self.dedup.id_field
        batch = written(batch, "stream-batch")
        parts = {int(p.rpartition("=")[2]): p for p in children(spark, self.folder) if "batch=" in p}
        earlier = [p for i, p in parts.items() if i < batch_id]
        state = spark.read.schema(_STATE).parquet(*earlier) if earlier else spark.createDataFrame([], _STATE)
        latest = state.groupBy(F.input_file_name().alias("part")).agg(F.max("seen").alias("seen")).agg(F.max("seen")).first()[0]
        if latest is not None:
            state = state.where(F.col("seen") >= F.lit(latest) - F.make_dt_interval(secs=F.lit(self.delay)))
        bands = written(self.dedup.bands(batch), "stream-bands")
        gone = bands.join(state.select("band", "hash").distinct(), ["band", "hash"], "left_semi").select(F.col("row").alias("_gone")).distinct()
        out = written(self.dedup.dedup(batch.join(gone, F.col(name) == F.col("_gone"), "left_anti")), "stream-kept")
        own = bands.join(out.select(F.col(name).cast("long").alias("row"), F.col(self.time).cast("timestamp").alias("seen")), "row")
        own.select("band", "hash", "seen").write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        self._expire(batch, [p for i, p in parts.items() if i < batch_id])
        drop(batch, bands)
        return out

    def _expire(self, batch: DataFrame, parts: list[str]) -> None:
        """Removes the parts whose rows are all too old to matter to later batches."""
        spark, newest = batch.sparkSession, batch.agg(F.max(self.time).cast("timestamp")).first()[0]
        if newest is None:
            return
        for p in parts:
            old = spark.read.schema(_STATE).parquet(p).agg((F.max("seen") < F.lit(newest) - F.make_dt_interval(secs=F.lit(2 * self.delay))).alias("old")).first().old
            if old is None or old:
                remove(spark, p)

    def start(self, stream: DataFrame, output: str, checkpoint: str, **trigger):
        """A running query that writes the rows that stay to output (Parquet, a folder for each batch)."""

        def each(batch: DataFrame, batch_id: int) -> None:
            out = self.kept(batch, batch_id)
            out.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            drop(out)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
