"""A stored search index over chunks: their rows, postings with document frequencies and lengths, and vectors by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.functions.vector import best_rows, usable
from tarnbeck.lineage import Stages

FIELDS = ("text", "name")
ROWS = "chunk_id long, path string, chunk_index int, name string, text string, vector array<float>"
POSTINGS = "field string, term string, shard int, df long, ids array<long>, tf array<int>, dl array<int>"
BLOCKS = "field string, term string, shard int, ids array<long>, tf array<int>, dl array<int>"
TOTALS = "field string, n long, avgdl double"
VECTORS = "cell int, part int, chunk_id long, vector array<float>"
CENTROIDS = "cell int, centroid array<double>"
LEAST_CELLS = 20_000  # fixed value: from so many chunks on vectors lie in cells
REFRESH_UPTO = 50_000  # fixed value: up to so many chunks the index is rebuilt after a batch of changes


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def blocks_of(batches: Iterator[pa.RecordBatch], terms_a_batch: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Postings (``BLOCKS``) of one shard, all of whose chunks (shard, chunk_id, a list of words a field) come in one task."""
    codes: dict[str, dict[str, int]] = {f: {} for f in FIELDS}
    found: dict[str, list[tuple]] = {f: [] for f in FIELDS}
    at = 0
    for b in batches:
        if not b.num_rows:
            continue
        at, ids = b.column(0)[0].as_py(), np.asarray(b.column(1))
        for f, lists in zip(FIELDS, b.columns[2:]):
            dl = np.asarray(lists.value_lengths())
            words = lists.flatten().dictionary_encode()
            known = codes[f]
            code = np.array([known.setdefault(w, len(known)) for w in words.dictionary.to_pylist()], np.int64)[np.asarray(words.indices)]
            key, tf = np.unique(np.repeat(np.arange(len(ids)), dl) << 32 | code, return_counts=True)
            row = key >> 32
            found[f].append((key & 0xFFFFFFFF, ids[row], tf.astype(np.int32), dl[row].astype(np.int32)))
    for f in FIELDS:
        if codes[f]:
            code, ids, tf, dl = (np.concatenate(z) for z in zip(*found[f]))
            order = np.lexsort((ids, code))
            ids, tf, dl = ids[order], tf[order], dl[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(codes[f])))])
            names = list(codes[f])  # in the order of their codes
            for a in range(0, len(names), terms_a_batch):
                some = ends[a : a + terms_a_batch + 1]
                lists = [pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(z[some[0] : some[-1]])) for z in (ids, tf, dl)]
                n = len(some) - 1
                yield pa.RecordBatch.from_arrays([pa.array([f] * n), pa.array(names[a : a + n]), pa.array(np.full(n, at, np.int32)), *lists], names=["field", "term", "shard", "ids", "tf", "dl"])


class SearchIndex:
    """Tables in ``folder``. ``build`` writes them whole; readers of an older folder aren't disturbed.

    postings: a row per field, term and shard of chunks with the term's document frequency, sorted by term, so
    that a question reads only the row groups of its terms. A shard has a bounded number of chunks,
    and scoring it is one task's work. vectors: usable ones; from ``LEAST_CELLS`` chunks on in cells
    around centroids fitted on a bounded sample, a large cell in several parts.
    """

    def __init__(self, spark: SparkSession, folder: str, dim: int = 64) -> None:
        self.spark, self.folder, self.dim = spark, folder.rstrip("/"), dim

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        return self.table("rows", ROWS)

    def postings(self) -> DataFrame:
        return self.table("postings", POSTINGS)

    def totals(self) -> DataFrame:
        return self.table("totals", TOTALS)

    def vectors(self) -> DataFrame:
        return self.table("vectors", VECTORS)

    def centroids(self) -> DataFrame:
        return self.table("centroids", CENTROIDS)

    @classmethod
    def build(cls, rows: DataFrame, folder: str, dim: int = 64, shard_rows: int = 100_000, part_rows: int = 50_000, sample: int = 50_000, least_cells: int = LEAST_CELLS) -> SearchIndex:
        """Indexes ``rows`` (chunk_id, path, chunk_index, name, text, vector), one a chunk."""
        index = cls(rows.sparkSession, folder, dim)
        cores = index.spark.sparkContext.defaultParallelism
        rows.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in ROWS.split(", "))).write.mode("overwrite").parquet(f"{index.folder}/rows")
        stored = index.rows()
        n = stored.count()
        shards = max(1, min(cores, -(-n // 256)), -(-n // shard_rows))
        shard = F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")
        dealt = stored.select(shard.alias("shard"), "chunk_id", *FIELDS).repartitionById(shards, "shard")
        stages = Stages(index.spark, "postings")
        blocks = stages.keep(dealt.select("shard", "chunk_id", *(tx.terms(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS)).mapInArrow(blocks_of, BLOCKS))
        words = {r.field: r.n for r in blocks.groupBy("field").agg(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
        totals = [(f, n, words.get(f, 0) / n) for f in FIELDS if n]
        index.spark.createDataFrame(totals, TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/totals")
        df = blocks.groupBy("field", "term").agg(F.sum(F.size("ids")).alias("df"))
        blocks.join(df, ["field", "term"]).select("field", "term", "shard", "df", "ids", "tf", "dl").repartitionByRange("field", "term").sortWithinPartitions("field", "term", "shard").write.mode("overwrite").parquet(f"{index.folder}/postings")
        stages.drop(blocks)
        index.write_vectors(stored.where(usable(F.col("vector"), dim)).select("chunk_id", "vector"), n >= least_cells, part_rows, sample)
        return index

    def write_vectors(self, vectors: DataFrame, cells: bool, part_rows: int, sample: int) -> None:
        spark = self.spark
        n = vectors.count() if cells else 0
        if n:
            unit = vectors.select("chunk_id", "vector", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
            k = int(min(4096, max(1, n**0.5)))
            model = KMeans(k=k, maxIter=8, seed=1, distanceMeasure="cosine", initSteps=1).fit(unit.sample(min(1.0, sample / n), 1) if n > sample else unit)
            centres = [(i, [float(z) for z in c]) for i, c in enumerate(model.clusterCenters())]
            placed = model.transform(unit).select(F.col("prediction").alias("cell"), "chunk_id", "vector")
        else:
            centres, placed = [(0, [0.0] * self.dim)], vectors.select(F.lit(0).alias("cell"), "chunk_id", "vector")
        spark.createDataFrame(centres, CENTROIDS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
        placed = placed.join(F.broadcast(parts), "cell")  # at most 4096 cells
        placed = placed.withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int")).select("cell", "part", "chunk_id", F.col("vector").cast("array<float>"))
        placed.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{self.folder}/vectors")

    def probed(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, chunk_id, score): like ``top_cosines``, but only the ``probes`` cells nearest to a query's vector are searched."""
        spark, dim = self.spark, self.dim
        centres = sorted(self.centroids().collect())  # at most 4096
        matrix = np.array([c.centroid for c in centres])
        shared = spark.sparkContext.broadcast(matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None])

        @F.pandas_udf("array<int>")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                sims = np.array(vectors.tolist(), np.float64).reshape(-1, dim) @ shared.value.T
                yield pd.Series(list(np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        asked = queries.where(usable(F.col("vector"), dim)).select("query_id", "vector", F.explode(nearest("vector")).alias("cell"))
        parts = self.vectors().select("cell", "part").distinct()
        asked = asked.join(parts, "cell")

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            x, q = (np.array(side["vector"].tolist(), np.float64).reshape(-1, dim) for side in (right, left))
            n, r, s = best_rows(q, x, right["chunk_id"].to_numpy(), k) if len(x) and len(q) else ([], [], [])
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[n], "chunk_id": r, "score": s}) if len(n) else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

        return asked.groupBy("cell", "part").cogroup(self.vectors().groupBy("cell", "part")).applyInPandas(score, "query_id long, chunk_id long, score double")


def refreshed(index: SearchIndex | None, rows: DataFrame, folder: str, upto: int = REFRESH_UPTO) -> SearchIndex | None:
    """After a batch of changes: a new index if the chunks are few enough for it, else the old one, until someone builds a new one."""
    if rows.limit(upto + 1).count() > upto:
        return index
    return SearchIndex.build(rows, folder, index.dim if index else 64)
