"""Following a change feed: debouncing, and applying batches of changes to the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.operators.store import Buckets, chunked
from tarnbeck.sources.files import indexable, visible


def debounced(events: DataFrame, key: str, at: str, seconds: int = 2, late: str = "10 minutes") -> DataFrame:
    """(window start, key, n): changes of a key within a window count once; streaming or batch.

    ``at`` is read as UTC. Rows without key or time are dropped; a stream drops those later than ``late``.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.window(at, f"{seconds} seconds").start.alias("start"), key).agg(F.count("*").alias("n"))


def last_change(batch: DataFrame) -> DataFrame:
    """The last change of each path of (path, seq, text, size, gone)."""
    last = batch.where("path is not null").groupBy("path").agg(F.max_by(F.struct("text", "size", "gone"), "seq").alias("c"))
    return last.select("path", "c.*")


def apply_batch(batch: DataFrame, chunks: Buckets, ledger: Buckets, after: Callable[[Buckets], None] | None = None) -> None:
    """Stores one batch: changed files anew; gone and no longer indexable ones are removed. Applying a batch twice changes nothing.

    The batch is read once. ``after`` gets the chunks, e.g. to refresh a search index.
    """
    changes = last_change(batch).persist()
    try:
        kept = changes.where(~F.coalesce("gone", F.lit(False)) & indexable(F.col("path"), F.col("size")) & visible(F.col("path"), False))
        fresh = chunked(kept).persist()
        counts = fresh.groupBy("path").agg(F.count("*").cast("int").alias("chunk_count"))
        chunks.replace(fresh, changes)
        ledger.replace(kept.select("path", "size").join(counts, "path", "left").fillna(0, ["chunk_count"]), changes)
        fresh.unpersist()
    finally:
        changes.unpersist()
    if after:
        after(chunks)


def follow(feed: DataFrame, chunks: Buckets, ledger: Buckets, checkpoint: str, trigger: dict | None = None, after: Callable[[Buckets], None] | None = None):
    """Starts the query that applies the streaming ``feed`` (path, seq, text, size, gone)."""
    writer = feed.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, chunks, ledger, after)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1600 milliseconds"})).start()


def written(result: DataFrame, keys: list[str], folder: str, trigger: dict) -> DataFrame:
    """Runs a streaming aggregation in update mode and gives its table: each batch writes the groups it changed, readers take the last of each.

    A batch that is run again overwrites its own folder, so nothing counts twice.
    """
    spark = result.sparkSession
    spark.createDataFrame([], result.schema).write.parquet(f"{folder}/result/batch=-1")  # a stream of no files has no batch

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    result.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(**trigger).start().awaitTermination()
    rows = spark.read.schema(result.schema.add("batch", "long") if "batch" not in result.columns else result.schema).parquet(f"{folder}/result")
    values = [c for c in result.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
