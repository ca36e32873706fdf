"""Similarity of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tarnbeck.lineage import in_blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector; 1 for the zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, n).otherwise(1.0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def usable(v: Column, dim: int) -> Column:
    """Not null, of ``dim`` finite elements, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def first_of(n: np.ndarray, r: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query number, row id, score) the k best of each query, ties by row id."""
    order = np.lexsort((r, -s, n))
    n, r, s = n[order], r[order], s[order]
    keep = np.arange(len(n)) - np.searchsorted(n, n) < k
    return n[keep], r[keep], s[keep]


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, score) of the k rows of ``x`` with the greatest cosine for each row of ``q``; scores clipped at 0, to four digits."""
    q, x = (v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None] for v in (q, x))
    score = np.round(np.maximum(q @ x.T, 0) + 1e-12, 4)
    m = min(k, score.shape[1])
    if not m or not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    n, c = np.nonzero(score >= np.partition(score, score.shape[1] - m, axis=1)[:, [score.shape[1] - m]])
    return first_of(n, ids[c], score[n, c], k)


def top_cosines(queries: DataFrame, rows: DataFrame, k: int, dim: int, block: int = 1024, most_blocks: int = 64) -> DataFrame:
    """(query_id, row_id, score): the k rows of greatest cosine for each query, ties by row_id.

    ``queries`` (query_id long, vector) is packed into
    blocks of ``block``, and every partition of ``rows`` (row_id long, vector)
    is multiplied with one block after the other. Scores are clipped at 0 and
    rounded to four digits before they are ranked. Each partition hands on at
    most k rows a query. Beyond ``block * most_blocks`` queries there are several
    passes over ``rows``.
    """
    return in_blocks(queries.select("query_id", "vector"), block * most_blocks, lambda packed: cosines_of(packed, rows, k, dim, block))


class Best:
    """The k best rows of each of some queries (unit length), as rows come in batches.

    Once a query has k rows, 32-bit products tell which others can reach the last of them;
    only those are scored with 64 bits. Queries whose k-th score is 0 are scored against all rows.
    """

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.small = q.astype(np.float32)
        self.least = np.zeros(len(q))
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.pile: list[tuple] = []
        self.waiting = 0

    def look(self, x: np.ndarray, small: np.ndarray, ids: np.ndarray, first: int = 512, step: int = 4096) -> None:
        """``x`` are rows at unit length, ``small`` the same with 32 bits."""
        ends = [0, *range(first if len(self.kept[0]) == 0 else step, len(x), step), len(x)]
        for a, b in zip(ends, ends[1:]):
            every = np.flatnonzero(self.least <= 0)
            if len(every):
                n, r, s = best_rows(self.q[every], x[a:b], ids[a:b], self.k)
                self.add(every[n], r, s)
            some = np.flatnonzero(self.least > 0)
            if len(some):
                least = (self.least[some] - 6e-5 - 1.2e-7 * x.shape[1]).astype(np.float32)  # rounding to four digits, and to 32 bits
                at = np.flatnonzero(self.small[some] @ small[a:b].T >= least[:, None])
                n, c = some[at // (b - a)], a + at % (b - a)
                self.add(n, ids[c], np.round(np.maximum(np.einsum("ij,ij->i", self.q[n], x[c]), 0) + 1e-12, 4))
            if len(every) or self.waiting > 2 * self.k * len(self.q):
                self.merge()

    def add(self, n: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
        good = s >= self.least[n]
        self.pile.append((n[good], r[good], s[good]))
        self.waiting += int(good.sum())

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.pile:
            self.kept = first_of(*(np.concatenate(z) for z in zip(self.kept, *self.pile)), self.k)
            self.pile, self.waiting = [], 0
            n, _, s = self.kept
            count = np.bincount(n, minlength=len(self.q))
            full = count == self.k
            self.least[full] = s[(np.cumsum(count) - 1)[full]]
        return self.kept


def cosines_of(packed: list[Row], rows: DataFrame, k: int, dim: int, block: int) -> tuple[DataFrame, Broadcast]:
    """``top_cosines`` of collected queries, and the broadcast that holds them."""
    ids = np.array([r.query_id for r in packed], np.int64)
    matrix = np.array([r.vector for r in packed], np.float64).reshape(-1, dim)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None]
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        blocks = [Best(q[a : a + block], k) for a in range(0, len(q), block)]
        for b in batches:
            x, rid = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dim), np.asarray(b.column(0))
            x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
            small = x.astype(np.float32)
            for best in blocks:
                best.look(x, small, rid)
        for i, best in enumerate(blocks):
            n, r, s = best.merge()
            yield pa.RecordBatch.from_arrays([pa.array(qids[n + i * block]), pa.array(r), pa.array(s)], names=["query_id", "row_id", "score"])

    return rows.select("row_id", "vector").mapInArrow(run, "query_id long, row_id long, score double"), shared
