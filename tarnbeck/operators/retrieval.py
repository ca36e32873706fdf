"""Hybrid retrieval for batches of queries: cosine and BM25 lists, fusion, floors, reranking, per-file cap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions import text as tx
from tarnbeck.functions.vector import cosine, first_of, sigmoid, top_cosines, usable
from tarnbeck.lineage import in_blocks, spread

from .index import SearchIndex


@dataclass(frozen=True)
class Limits:
    """Fixed values of the retrieval pipeline."""

    per_list: int = 24
    pool: int = 16
    per_file: int = 3
    top: int = 8
    rrf: int = 60
    least_cosine: float = 0.30
    trusted_ranks: int = 3
    least_rerank: float = 0.02
    k1: float = 1.2
    b: float = 0.75


LIMITS = Limits()
MOST_HITS, SEPARATOR = 50, "\n\n---\n\n"  # fixed values: hits a query can ask for, and what stands between them in a context


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """One row per chunk, the one stored first where (path, chunk_index) is stored again; null keys are left out."""
    keyed = chunks.where("path is not null and chunk_index is not null")
    first = keyed.groupBy("path", "chunk_index").agg(F.min("chunk_id").alias("chunk_id"))
    return keyed.join(first.select("chunk_id"), "chunk_id", "left_semi")


def postings(rows: DataFrame, column: str) -> DataFrame:
    """(term, chunk_id, tf, dl): the inverted index of a text column."""
    words = rows.select("chunk_id", tx.terms(F.coalesce(F.col(column), F.lit(""))).alias("w"))
    return words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def bm25_top(queries: DataFrame, index: SearchIndex, limits: Limits = LIMITS, most_queries: int = 65_536) -> DataFrame:
    """(query_id, chunk_id, bm25): for each query (query_id, query) the best ``per_list`` chunks of each shard that share a term with it, ties by chunk_id.

    A chunk's score is the greater of those on its text and on its name; terms of a query
    count once. At most ``most_queries`` queries are scored at once, more in several passes.
    A task scores one shard of chunks and hands on no more than ``per_list`` of them a query, so
    that frequent words cost no shuffle beyond their postings.
    """
    asked = queries.where("query is not null").select("query_id", F.array_distinct(tx.terms(tx.search_text(F.col("query")))).alias("w"))
    totals = {r.field: (r.n, r.avgdl or 1.0) for r in index.totals().collect()}
    return in_blocks(asked, most_queries, lambda rows: bm25_of(rows, index, totals, limits))


def bm25_of(asked: list[Row], index: SearchIndex, totals: dict[str, tuple[int, float]], limits: Limits, most_in_filter: int = 1000) -> tuple[DataFrame, Broadcast]:
    """``bm25_top`` of collected queries over the index's postings, and the broadcast that holds them."""
    spark, k = index.spark, limits.per_list
    vocabulary = sorted({w for r in asked for w in r.w})
    place = {w: i for i, w in enumerate(vocabulary)}
    ids = np.array([r.query_id for r in asked], np.int64)
    wanted = [np.array(sorted(place[w] for w in r.w), np.int64) for r in asked]
    shared = spark.sparkContext.broadcast((place, ids, wanted, totals))
    if len(vocabulary) <= most_in_filter:  # reaches the scan, which skips all other terms
        postings = index.postings().where(F.col("term").isin(vocabulary))
    else:
        postings = index.postings().join(F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "term string")), "term", "left_semi")

    def score(shard: dict[str, dict[int, tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best chunks of one shard: {field: {term: (df, chunk ids, tf, dl)}}."""
        _, ids, wanted, totals = shared.value
        chunk = np.unique(np.concatenate([p[1] for terms in shard.values() for p in terms.values()]))
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for field, terms in shard.items():
            n, avgdl = totals[field]
            weights = {}
            for t, (df, at, tf, dl) in terms.items():
                idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
                w = idf * (tf * (limits.k1 + 1) / (tf + limits.k1 * (1 - limits.b + limits.b * dl / avgdl)))
                weights[t] = np.searchsorted(chunk, at), w, w.max()
            for q, asked in enumerate(wanted):
                found = [weights[t] for t in asked.tolist() if t in weights]
                if found:
                    at, s = best_sums(found, k, len(chunk))
                    kept.append((np.full(len(at), q), at, s))
        q, at, s = (np.concatenate(x) for x in zip(*kept))
        # a chunk among a query's k best is among the k best of the field that scores it higher
        order = np.lexsort((-s, at, q))
        q, at, s = q[order], at[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1])
        return first_of(q[new], chunk[at[new]], s[new], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, _, _ = shared.value
        at, shard = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if shard:
                q, c, s = score(shard)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_id", "bm25"])

        for b in batches:
            lists = [(c, np.asarray(c.flatten()), np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths()))])) for c in (b.column(i) for i in (4, 5, 6))]
            for i, (n, field, term, df) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)))):
                if n != at:
                    yield from done()
                    at, shard = n, {}
                shard.setdefault(field, {})[place[term]] = (df, *(flat[ends[i] : ends[i + 1]] for _, flat, ends in lists))
        yield from done()

    parts = postings.select("shard", "field", "term", "df", "ids", "tf", "dl").repartition("shard").sortWithinPartitions("shard")
    return parts.mapInArrow(run, "query_id long, chunk_id long, bm25 double"), shared


def best_sums(found: list[tuple[np.ndarray, np.ndarray, float]], k: int, n: int, few: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums (to six digits) of the k of ``n`` places with the greatest sums over (sorted places, weights, greatest weight), ties by place.

    Places that have none of the weightiest terms are not looked at once the other terms can't lift them to the k-th sum.
    """
    def top(at: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            at, s = at[keep], s[keep]
        order = np.lexsort((at, -s))[:k]
        return at[order], s[order]

    sizes = [len(at) for at, _, _ in found]
    if sum(sizes) > few:
        order = sorted(range(len(found)), key=lambda i: -found[i][2])
        upto = np.cumsum([sizes[i] for i in order])
        for e in range(1, len(order)):
            if upto[e - 1] < k:
                continue
            if 8 * upto[e - 1] > n:
                break
            at = np.unique(np.concatenate([found[i][0] for i in order[:e]])) if e > 1 else found[order[0]][0]
            s = np.zeros(len(at))
            for there, w, _ in found:
                near = np.minimum(np.searchsorted(there, at), len(there) - 1)
                s += np.where(there[near] == at, w[near], 0)
            s = np.round(s, 6)
            if len(at) >= k and sum(found[i][2] for i in order[e:]) + 2e-6 < np.partition(s, len(s) - k)[len(s) - k]:
                return top(at, s)
    s = np.bincount(np.concatenate([at for at, _, _ in found]), np.concatenate([w for _, w, _ in found]), n)
    at = np.flatnonzero(s)
    return top(at, np.round(s[at], 6))


def ranked(df: DataFrame, score: Column, k: int, name: str, ties: str = "chunk_id") -> DataFrame:
    """The k rows of greatest score per query with their rank from 1, ties by id."""
    order = Window.partitionBy("query_id").orderBy(score.desc(), ties)
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def vector_list(queries: DataFrame, index: SearchIndex, limits: Limits = LIMITS, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, vec_rank): by all vectors, or with ``probes`` by those of the cells nearest to a query."""
    q = queries.where(usable(F.col("vector"), index.dim))
    if probes:
        hits = index.probed(q, limits.per_list, probes)
    else:
        hits = top_cosines(q, spread(index.vectors().select(F.col("chunk_id").alias("row_id"), "vector")), limits.per_list, index.dim).withColumnRenamed("row_id", "chunk_id")
    return ranked(hits, F.col("score"), limits.per_list, "vec_rank")


def text_list(queries: DataFrame, index: SearchIndex, limits: Limits = LIMITS) -> DataFrame:
    """(query_id, chunk_id, bm25, fts_rank): the better of the scores on text and on name."""
    return ranked(bm25_top(queries, index, limits), F.col("bm25"), limits.per_list, "fts_rank")


def fuse(vectors: DataFrame, texts: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(query_id, chunk_id, rrf, score, fts_rank): reciprocal-rank fusion of the two lists; score is null for chunks found by text only."""
    empty = F.lit(None)
    a = vectors.select("query_id", "chunk_id", F.col("vec_rank").alias("rank"), "score", empty.cast("int").alias("fts_rank"))
    b = texts.select("query_id", "chunk_id", F.col("fts_rank").alias("rank"), empty.cast("double").alias("score"), "fts_rank")
    joined = a.unionByName(b).groupBy("query_id", "chunk_id")
    return joined.agg(F.round(F.sum(1.0 / (limits.rrf + F.col("rank"))), 8).alias("rrf"), F.max("score").alias("score"), F.min("fts_rank").alias("fts_rank"))


def with_scores(fused: DataFrame, queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Fills the cosine of chunks that only the text list found; 0 where a vector is unusable."""
    ok = usable(F.col("qv"), index.dim) & usable(F.col("v"), index.dim)
    joined = index.rows().select("chunk_id", F.col("vector").alias("v")).join(fused, "chunk_id").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
    missing = F.when(ok, F.round(F.greatest(cosine(F.col("qv"), F.col("v")), F.lit(0.0)) + 1e-12, 4)).otherwise(0.0)
    return joined.withColumn("score", F.coalesce("score", missing)).drop("v", "qv")


def with_rows(hits: DataFrame, queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Hits with their query and the rows of their chunks; asked for late, so that texts aren't shuffled for hits that drop out."""
    rows = index.rows().select("chunk_id", "path", "chunk_index", "name", "text")
    return rows.join(hits, "chunk_id").join(queries.select("query_id", "query"), "query_id")


def confident(fused: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Hits with enough cosine or among the first of the text list."""
    return fused.where((F.col("score") >= limits.least_cosine) | (F.col("fts_rank") <= limits.trusted_ranks))


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in relevance: a logit of the share of the query's terms that the text has."""
    q = F.array_distinct(tx.terms(query))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(q, tx.terms(F.coalesce(text, F.lit(""))))), F.size(q)), F.lit(0.0))
    return F.round(sigmoid(12 * share - 6), 4)


def pooled(hits: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    return ranked(hits, F.col("rrf"), limits.pool, "pool_rank")


def reranked(pool: DataFrame, score: Column | None, limits: Limits = LIMITS) -> DataFrame:
    """The pool in the order of a reranker's probability; without one (null scores) the order of fusion and no floor."""
    scored = pool.withColumn("rerank", score if score is not None else F.lit(None).cast("double"))
    kept = scored.where(F.col("rerank").isNull() | (F.col("rerank") >= limits.least_rerank))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "pool_rank")
    return kept.withColumn("place", F.row_number().over(order))


def capped(hits: DataFrame, k: int | None = None, limits: Limits = LIMITS) -> DataFrame:
    """At most ``per_file`` hits a file, then the k first, numbered from 1 as ``ref``."""
    per_file = Window.partitionBy("query_id", "path").orderBy("place")
    few = hits.withColumn("nth", F.row_number().over(per_file)).where(F.col("nth") <= limits.per_file)
    order = Window.partitionBy("query_id").orderBy("place")
    return few.withColumn("ref", F.row_number().over(order)).where(F.col("ref") <= (k or limits.top)).drop("nth", "place")


def search(queries: DataFrame, index: SearchIndex, k: int | None = None, rerank: bool = True, limits: Limits = LIMITS, probes: int | None = None) -> DataFrame:
    """Hybrid search for ``queries`` (query_id, query, vector) over an index.

    (query_id, ref, chunk_id, path, name, chunk_index, text, score, rrf, fts_rank, rerank).
    A query without usable vector is answered from the text list, one without
    terms from the vector list, one with neither by nothing.
    """
    if k is not None and not 1 <= k <= MOST_HITS:
        raise ValueError(f"k must be from 1 to {MOST_HITS}")
    fused = with_scores(fuse(vector_list(queries, index, limits, probes), text_list(queries, index, limits), limits), queries, index)
    pool = with_rows(pooled(confident(fused, limits), limits), queries, index)
    out = capped(reranked(pool, overlap_score(F.col("query"), F.col("text")) if rerank else None, limits), k, limits)
    return out.select("query_id", "ref", "chunk_id", "path", tx.shown_name(F.col("name"), F.col("path")).alias("name"), "chunk_index", "text", "score", "rrf", "fts_rank", "rerank")


def mining_pool(queries: DataFrame, index: SearchIndex, size: int = 30, limits: Limits = LIMITS) -> DataFrame:
    """Fused hits before any floor or cap."""
    fused = fuse(vector_list(queries, index, limits), text_list(queries, index, limits), limits)
    return ranked(fused, F.col("rrf"), size, "pool_rank").join(index.rows().select("chunk_id", "path", "chunk_index", "text"), "chunk_id")


def for_client(hits: DataFrame) -> DataFrame:
    """Hits as a client gets them."""
    return hits.select("query_id", "path", "name", F.col("chunk_index").alias("chunkIndex"), "text", "score")


def citations(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "ref", "path", "name", "score", F.substring("text", 1, 240).alias("preview"))


def percent(score: Column) -> Column:
    """A score as whole percent, halves to the even number: a format string alone would round them up."""
    return F.format_string("%.0f%%", F.rint(100 * score))


def block() -> Column:
    """A hit as a numbered block of a model's context."""
    return F.concat(F.lit("["), F.col("ref"), F.lit("] "), F.col("path"), F.lit("\n"), F.coalesce("text", F.lit("")))


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits of a query as numbered blocks; at most ``MOST_HITS`` a query."""
    listed = F.array_sort(F.collect_list(F.struct("ref", block().alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["b"]), SEPARATOR).alias("context"))
