"""Held-out texts that occur, whole or in part, in training text.

Held-out words are numbered; an Aho-Corasick automaton over word numbers has each
question as one pattern, and each passage as a chain of blocks of half a run.
A run of enough consecutive words contains a whole block, so every training text is
scanned once and each block found is extended to both sides along its passage;
runs that are long enough are merged into intervals and mapped back to offsets in the original text.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.lineage import Stages, spread

from .common import _WORD, INVISIBLE, words

SCHEMA = "row_id long, item_id long, field string, n_words int, start int, end int"
Item = tuple[int, str, str]  # id, kind (passage or query), text


class Patterns:
    """The automaton of one shard of items. Its size is about the number of their words."""

    def __init__(self, items: list[Item], run: int) -> None:
        self.run, self.numbers = run, {}
        texts: dict[tuple[str, tuple[int, ...]], list[int]] = {}
        for item, kind, text in items:
            found = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text))
            if len(found) >= (run if kind == "passage" else 1):
                texts.setdefault((kind, found), []).append(item)
        self.texts = [(kind, found, sorted(set(ids))) for (kind, found), ids in texts.items()]
        block, chains = (run + 1) // 2, {}
        for n, (kind, found, _) in enumerate(self.texts):
            size = block if kind == "passage" else len(found)
            for at in range(0, len(found) - size + 1, size):
                chains.setdefault(found[at : at + size], []).append((n, at))
        self.search = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for chain, who in chains.items():
            self.search.add_word(chain, (len(chain), who))
        if chains:
            self.search.make_automaton()

    def runs(self, text: list[str], kind: str) -> dict[int, list[tuple[int, int]]]:
        """For each item the runs of a text's words that it has: word numbers, the end exclusive."""
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in text])
        out: dict[int, list[tuple[int, int]]] = {}
        seen: dict[tuple[int, int], int] = {}  # passage and shift against the text: end of the last run
        for end, (size, who) in self.search.iter(numbers) if len(self.search) and any(numbers) else ():
            for n, at in who:
                what, found, ids = self.texts[n]
                shift = end + 1 - size - at
                if what != kind or seen.get((n, shift), -1) > end:
                    continue
                a, e = end + 1 - size, end + 1
                while a > max(0, shift) and numbers[a - 1] == found[a - 1 - shift]:
                    a -= 1
                while e < min(len(numbers), shift + len(found)) and numbers[e] == found[e - shift]:
                    e += 1
                seen[n, shift] = e
                if kind == "query" or e - a >= self.run:
                    for item in ids:
                        out.setdefault(item, []).append((a, e))
        return out


@lru_cache(maxsize=2)
def patterns(key: str, shared, run: int) -> Patterns:
    """Built once a worker and shard."""
    return Patterns(shared.value, run)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of ``words(text)`` in the original text.

    Composition never crosses white space, so each run between white space is
    normalised alone. A run that keeps its length gives exact offsets; a word
    of any other run gets the run's.
    """
    out, at = [], 0
    for piece in text.split():
        at = text.index(piece, at)
        plain = piece if piece.isascii() else unicodedata.normalize("NFKC", piece.translate(INVISIBLE))
        lower = plain.lower()
        exact = len(lower) == len(piece) and (piece.isascii() or all(unicodedata.normalize("NFKC", a).lower() == b for a, b in zip(piece, lower)))
        out += [(at + m.start(), at + m.end()) if exact else (at, at + len(piece)) for m in _WORD.finditer(lower)]
        at += len(piece)
    return out


def scan(df: DataFrame, items: list[Item], run: int) -> DataFrame:
    """One shard of items against every row of df (row_id, doc, query)."""
    key, shared = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_out = patterns(key, shared, run)
        for batch in batches:
            ids, docs, queries = (c.to_pylist() for c in batch.columns)
            out = []
            for row, *texts in zip(ids, docs, queries):
                for field, kind, text in zip(("doc", "query"), ("passage", "query"), texts):
                    found = held_out.runs(words(text), kind) if text else None
                    if not found:
                        continue
                    original = word_spans(text)
                    for item, runs in found.items():
                        out += [(row, item, field, e - a, original[a][0], original[e - 1][1]) for a, e in merged(runs)]
            yield pa.RecordBatch.from_pydict(dict(zip(("row_id", "item_id", "field", "n_words", "start", "end"), map(list, zip(*out)) if out else ([],) * 6)), schema=pa.schema([("row_id", pa.int64()), ("item_id", pa.int64()), ("field", pa.string()), ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    return df.mapInArrow(work, SCHEMA)


def find_leaks(train: DataFrame, held_out: DataFrame, run: int = 12, shard_chars: int = 16_000_000) -> DataFrame:
    """(pair_id, probe_id, field, n_words, start, end): each stretch of a held-out item in a training row.

    ``train`` needs pair_id, doc and query; ``held_out`` probe_id, query and
    passage; other columns are ignored. A passage counts from ``run``
    consecutive words on, a query only whole. start and end are offsets in the
    original doc or query. Null, blank or wordless texts and passages shorter
    than ``run`` words match nothing; repeated items and rows are reported each;
    empty tables give an empty result.

    Held-out sets don't grow with the corpus: up to ``shard_chars`` characters of them
    are one automaton and one scan. Larger sets are dealt by a hash to more automata, each with
    a scan of its own, whatever their number; the driver collects one shard at a time.
    """
    both = F.create_map(F.lit("passage"), F.col("passage").cast("string"), F.lit("query"), F.col("query").cast("string"))
    items = held_out.select(F.col("probe_id").cast("long").alias("id"), F.explode(both).alias("kind", "text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))
    text = train.select(F.col("pair_id").cast("long").alias("row_id"), F.col("doc").cast("string"), F.col("query").cast("string"))
    if shards > 1:
        items = Stages(train.sparkSession, "leaks").keep(items)
    parts = (items.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k).collect() for k in range(shards))
    text = spread(text)
    scans = [scan(text, [tuple(r) for r in part], run) for part in parts]
    return reduce(DataFrame.unionByName, scans).withColumnsRenamed({"row_id": "pair_id", "item_id": "probe_id"})
