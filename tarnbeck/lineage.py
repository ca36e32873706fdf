"""Cutting lineage with tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


_ROOTS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(spark, "_tarnbeck_folder", None):
        spark._tarnbeck_folder = "file://" + tempfile.mkdtemp(prefix="tarnbeck-")
    return spark._tarnbeck_folder


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that earlier jobs of this driver wrote into the shared folder; their results can't be read any more."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


class Stages:
    """Tables written by one job into the shared folder.

    ``keep(df)`` writes ``df`` and returns it as read back, so that a lost
    executor costs a re-read and not the whole lineage. ``drop(df)`` deletes a
    table that no later plan reads; what is left is deleted by ``clear``.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}", 0
        _ROOTS.add(self.root)
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                _delete(self.spark, path)


def in_blocks(queries: DataFrame, most: int, one_pass: Callable[[list[Row]], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """What ``one_pass`` gives for all rows of ``queries``, which has query_id, in as many passes as it takes.

    ``one_pass`` gets some collected rows, and gives a DataFrame and the
    broadcast behind it. More than ``most`` rows are dealt by a hash of query_id into
    blocks somewhat smaller than that; each block's result is written before
    the next is collected, so that the driver holds one block at a time.
    """
    rows = queries.limit(most + 1).collect()
    if len(rows) <= most:
        return one_pass(rows)[0]
    del rows
    stages = Stages(queries.sparkSession, "blocks")
    queries = stages.keep(queries)
    n = -(-5 * queries.count() // (4 * most))
    parts = []
    for i in range(n):
        part, shared = one_pass(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect())
        parts.append(stages.keep(part))
        shared.destroy()
    stages.drop(queries)
    return reduce(DataFrame.unionByName, parts)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For costly Python work right after a scan: a table of one small file comes
    in a single partition. A table of enough files is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
