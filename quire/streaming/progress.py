"""Incremental ordered output and progress on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("doc_id", "seg_index")


def append_segments(stream: DataFrame, table: str, checkpoint: str, keys: tuple[str, ...] = KEYS, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch, after ``change`` (such as a translation), is one folder named by its number. A batch
    that is replayed after a crash replaces its own folder, and what earlier batches wrote is never read or changed, so a
    job may go on with another engine. Of rows of a batch with the same key the least is written. ``stop()`` of the query
    ends it between batches; the checkpoint says where to go on. Read the table by ``written``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        least = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
        (change(least) if change else least).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, table: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of a table of batches, each key once: where a lost checkpoint had batches dealt anew, the first batch counts."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct("batch", *[c for c in rest if c != "batch"])).alias("_r"))
    return first.select(*keys, "_r.*").drop("batch")
