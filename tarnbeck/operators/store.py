"""Ledger and chunk tables: what changed, what is stale, upserts and removals that touch only the buckets of their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnbeck.functions import text as tx

from .index import exists


def latest(ledger: DataFrame) -> DataFrame:
    """The newest ledger row of each path (mtime_ns, then seen_at, size and chunk_count); null paths are left out."""
    row = F.struct("mtime_ns", F.coalesce("seen_at", F.timestamp_micros(F.lit(0))).alias("t"), F.coalesce("size", F.lit(-1)).alias("s"), F.coalesce("chunk_count", F.lit(-1)).alias("c"))
    newest = ledger.where("path is not null").groupBy("path").agg(F.max(row).alias("r"))
    return newest.select("path", "r.mtime_ns", F.when(F.col("r.s") >= 0, F.col("r.s")).alias("size"), F.when(F.col("r.c") >= 0, F.col("r.c")).alias("chunk_count"))


def changed(scan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scanned files that the ledger doesn't have with the same time and size."""
    same = (scan["path"] == ledger["path"]) & scan["mtime_ns"].eqNullSafe(ledger["mtime_ns"]) & scan["size"].eqNullSafe(ledger["size"])
    return scan.join(ledger, same, "left_anti")


def stale(ledger: DataFrame, scan: DataFrame) -> DataFrame:
    """Ledger rows whose file isn't there any more."""
    return ledger.join(scan.select("path").distinct(), "path", "left_anti")


def chunked(texts: DataFrame) -> DataFrame:
    """(path, chunk_index, text) of files (path, text); index by position after short chunks are dropped."""
    return texts.where("path is not null and text is not null").select("path", F.posexplode(F.expr(tx.chunks_sql("text"))).alias("chunk_index", "text"))


def replaced(chunks: DataFrame, incoming: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks after all of ``files`` (path) were stored anew with ``incoming``; a file without incoming chunks just loses its own."""
    columns = incoming.columns
    return chunks.join(files.select("path").distinct(), "path", "left_anti").select(*columns).unionByName(incoming)


def removed(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("path").distinct(), "path", "left_anti")


class Buckets:
    """A table in ``root`` partitioned by a hash of the path; a change rewrites the buckets of its paths only.

    The number of buckets is fixed when the table is first written, from the rows it then has. Files of
    other buckets stay as they are (dynamic partition overwrite; the new files of a bucket appear when the job commits). A
    bucket that loses its last row keeps a row without path, which readers don't see.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, bucket_rows: int = 1_000_000, least: int = 16) -> None:
        self.spark, self.root, self.bucket_rows, self.least = spark, root.rstrip("/"), bucket_rows, least
        self.schema = spark.createDataFrame([], schema).schema

    def stored(self) -> DataFrame | None:
        return self.spark.read.parquet(self.root) if exists(self.spark, self.root) else None

    def read(self) -> DataFrame:
        """All rows; columns as declared, those a stored table lacks are null."""
        table = self.stored()
        if table is None:
            return self.spark.createDataFrame([], self.schema)
        return table.where("path is not null").select(*(F.col(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))

    def matches(self) -> bool:
        """Whether what is stored has the declared columns and types. If not, ``rebuild`` it."""
        table = self.stored()
        return table is None or {f.name: f.dataType for f in table.drop("of", "bucket").schema} == {f.name: f.dataType for f in self.schema}

    def count_of(self, rows: int) -> int:
        return max(self.least, -(-rows // self.bucket_rows))

    def rebuild(self, df: DataFrame) -> None:
        """The whole table anew, e.g. after its columns changed. ``df`` must not read the table."""
        self._write(df, self.count_of(df.count()), "static")

    def replace(self, incoming: DataFrame, files: DataFrame) -> None:
        """All rows of ``files`` (path) go, those of ``incoming`` come. ``incoming`` is read twice when the table is new, else once."""
        table = self.stored()
        if table is None:
            self.rebuild(incoming)
            return
        of = table.select("of").first()[0]
        paths = files.where("path is not null").select("path").distinct()
        touched = [r.bucket for r in paths.select(bucket_of(of).alias("bucket")).distinct().collect()]  # at most ``of`` numbers
        kept = table.where(F.col("bucket").isin(touched) & F.col("path").isNotNull()).join(paths, "path", "left_anti").select(*self.schema.names)
        self._write(kept.unionByName(incoming.select(*self.schema.names)), of, "dynamic", touched)

    def _write(self, df: DataFrame, of: int, mode: str, touched: list[int] | None = None) -> None:
        df = df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("bucket", bucket_of(of))
        marks = self.spark.createDataFrame([(b,) for b in (range(of) if touched is None else touched)], "bucket int")
        df = df.unionByName(marks, allowMissingColumns=True).withColumn("of", F.lit(of))
        salt = F.pmod(F.xxhash64(*self.schema.names), F.lit(8))  # a path may have a third of all rows
        df.repartition("bucket", salt).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("of", "bucket").parquet(self.root)


def bucket_of(of: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(of)).cast("int")
