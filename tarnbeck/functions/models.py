"""Where models plug in. Without one, deterministic stand-ins are used, and called so."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.functions.text import terms

# Fixed value: the instruction that models of this family were trained with.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def query_input(text: Column, model: str) -> Column:
    """What is embedded for a query: models of the bge family expect an instruction before it."""
    return F.concat(F.lit(QUERY_PREFIX), text) if "bge" in model.lower() else text


def hashed_vectors(lists: pa.ListArray, dim: int) -> pa.ListArray:
    """Words hashed to signed slots: eight hexadecimal digits of a word's MD5 give the slot, the next one the sign (odd is plus)."""
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    words = lists.flatten().dictionary_encode()
    places = np.array([_place(w, dim) for w in words.dictionary.to_pylist()], np.int64).reshape(-1, 2)[np.asarray(words.indices)]
    at = np.repeat(np.arange(len(lists)), lengths) * dim + places[:, 0]
    values = np.bincount(at, places[:, 1], len(lists) * dim).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * dim, pa.int32()), pa.array(values))


@lru_cache(maxsize=100_000)
def _place(word: str, dim: int) -> tuple[int, int]:
    h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(h[:8], 16) % dim, 1 if int(h[8], 16) % 2 else -1


def embedder(load: Callable[[], Callable[[list[str]], list]] | None = None, dim: int = 64) -> Callable[[Column], Column]:
    """A column function text -> array<float>, the same for questions and chunks.

    ``load`` runs once per worker and returns a batch encoder of texts. Without it the words of
    a text are hashed: such vectors are similar if texts share words, and all zero without words.
    """

    if load is None:

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                yield hashed_vectors(lists, dim)

        return lambda text: hashed(terms(F.coalesce(text, F.lit(""))))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for values in batches:
            yield pd.Series(list(encode(values.fillna("").tolist())))

    return embed


def reranker(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A column function (query, passage) -> probability; null for all of a worker's rows once its model failed."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001
            model = None
        for q, p in batches:
            try:
                logits = np.asarray(model(q.tolist(), p.tolist()), float) if model else None
            except Exception:  # noqa: BLE001
                model = logits = None
            yield pd.Series([None] * len(q), dtype="float64") if logits is None else pd.Series(1 / (1 + np.exp(-logits)))

    return score
