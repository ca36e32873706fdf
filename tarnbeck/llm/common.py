"""Words, token frequencies and small Arrow helpers shared by the operators."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x2060, 0xFEFF))
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after dropping invisible characters, NFKC and lower case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(INVISIBLE))
    return _WORD.findall(text.lower())


def hash_words(flat: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    if not flat:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(flat, dtype=object), categorize=True)


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Frequencies:
    """Counts of all tokens of a corpus, folded into ``2 ** bits`` counters of one byte.

    The size is bounded whatever the data, so the counters
    may be sent to every worker; with more tokens they only tell frequent from rare ones less finely. A counter stands for at least its tokens' own
    counts: exact up to 31, then in steps of a fourteenth of a power of two. Used to order
    tokens from rare to frequent, and to tell tokens that occur only once.
    """

    def __init__(self, counters: np.ndarray) -> None:
        self.counters, self.mask = counters, np.uint64(len(counters) - 1)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.counters[(tokens & self.mask).astype(np.int64)]

    @staticmethod
    def bits_for(tokens: int) -> int:
        """Counters for so many tokens, within bounds: about two a token, 1 to 64 MB."""
        return int(min(26, max(20, np.ceil(np.log2(2 * tokens + 1)))))

    @staticmethod
    def count(df: DataFrame, tokens: Callable[[pa.RecordBatch], np.ndarray], bits: int = 24, slots: int = 64) -> Frequencies:
        """Counts every row of ``df``. Each task adds up locally and sends compressed counters; slots are added in parallel."""
        size, width = 1 << bits, (1 << bits) // slots

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.uint32)
            for batch in batches:
                found = tokens(batch)
                if len(found):
                    at, n = np.unique((found & np.uint64(size - 1)).astype(np.int64), return_counts=True)
                    total[at] += n.astype(np.uint32)
            for slot in range(slots):
                part = total[slot * width : (slot + 1) * width]
                at = np.flatnonzero(part)
                yield pa.RecordBatch.from_pydict({"slot": [slot], "at": [zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)], "n": [zlib.compress(part[at].tobytes(), 1)]}, schema=pa.schema([("slot", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

        def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width, np.int64)
            for pdf in batches:
                for at, n in zip(pdf["at"], pdf["n"]):
                    where = np.cumsum(np.frombuffer(zlib.decompress(at), np.uint32), dtype=np.int64)
                    total[where] += np.frombuffer(zlib.decompress(n), np.uint32)
            code = np.where(total < 32, total, np.minimum(255, 32 + 14 * np.log2(np.maximum(total, 32) / 32)))
            yield pd.DataFrame({"slot": [key[0]], "part": [zlib.compress(code.astype(np.uint8).tobytes(), 1)]})

        parts = df.mapInArrow(local, "slot int, at binary, n binary").groupBy("slot").applyInPandas(add, "slot int, part binary").collect()
        counters = np.zeros((slots, width), np.uint8)
        for row in parts:
            counters[row.slot] = np.frombuffer(zlib.decompress(row.part), np.uint8)
        return Frequencies(counters.reshape(-1))
