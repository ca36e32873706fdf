"""The same or nearly the same question in training and in evaluation records.

Two questions overlap if they have the same words with digits and share, as
multisets, at least ``share`` of the words of the longer one. Words may stand in
any order, so a question's passage is its words in one order common to all
questions, rare ones first, a word's later copies numbered, closed to a circle.

A shard's Aho-Corasick automaton has two kinds of n-grams of its evaluation
passages: all pairs of neighbours on the circle, and as anchors the few rarest words
alone. It scans the training passages; the intervals matched in one are
merged into the coverage of each evaluation question with an anchor there, and those
covered enough are verified as multisets.

Why no pair is lost: of n words a partner lacks at most n - ceil(share * n), so it has one of
that many and one more of the rarest, an anchor. If c words are common to passages of n and m words, the
n + m - 2c others cut the circle of common words into as many runs at most; at most all runs but one
are of a single word, so neighbours cover at least c - (n + m - 2c) + 1 words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.lineage import Stages, spread

from .common import Frequencies, hash_words, words

PASSAGE = "row_id long, side int, key binary, digits string, passage string, anchors array<long>"
LINK = pa.schema([("eval_key", pa.binary()), ("train_key", pa.binary()), ("covered", pa.int32()), ("longer", pa.int32())])


def numbered(ws: list[str]) -> list[str]:
    """Words with a repeated word's later copies numbered, so that multisets become sets."""
    seen: Counter = Counter()
    out = []
    for w in ws:
        seen[w] += 1
        out.append(w if seen[w] == 1 else f"{w}#{seen[w]}")
    return out


def tokens_of(batch: pa.RecordBatch) -> np.ndarray:
    return hash_words([w for text in batch.column("query").to_pylist() for w in numbered(words(text))])


def common_words(n: int, share: float) -> int:
    """Words that a pair has in common at least if the longer question has n."""
    return ceil(share * n - 1e-9)


def passages(rows: DataFrame, frequencies: Frequencies, share: float) -> DataFrame:
    """Each question's passage and the words with digits in it, a key of the two, and hashes of its anchors."""
    shared = rows.sparkSession.sparkContext.broadcast(frequencies.counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Frequencies(shared.value)
        for batch in batches:
            split = [numbered(sorted(words(q))) for q in batch.column(2).to_pylist()]
            has = [i for i, ws in enumerate(split) if ws]
            n = np.array([len(split[i]) for i in has], np.int64)
            flat = [w for i in has for w in split[i]]
            hashes = hash_words(flat)
            digits = [" ".join(w for w in split[i] if any(c.isdigit() for c in w.partition("#")[0])) for i in has]
            owner = np.repeat(np.arange(len(has)), n)
            order = np.lexsort((hashes, counts.of(hashes), owner))
            ends = np.cumsum(n)
            texts = [" ".join([flat[j] for j in order[e - k : e].tolist()]) for e, k in zip(ends.tolist(), n.tolist())]
            place = np.arange(len(order)) - np.repeat(ends - n, n)
            few = n - np.ceil(share * n - 1e-9).astype(np.int64) + 1
            kept = order[place < few[owner]]  # owner is sorted, so it is the owner of order too
            anchors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]), pa.int32()), pa.array((hashes[kept] * np.uint64(3) + hash_words(digits)[owner[kept]]).view(np.int64)))
            keys = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts]
            at = pa.array(has, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary()), pa.array(digits, pa.string()), pa.array(texts, pa.string()), anchors], names=["row_id", "side", "key", "digits", "passage", "anchors"])

    return rows.mapInArrow(run, PASSAGE)


class Shard:
    """Evaluation passages of one shard and their automaton. Symbols are words together with the question's words with digits."""

    def __init__(self, share: float) -> None:
        self.share = share
        self.symbols: dict[str, int] = {}
        self.keys: list[bytes] = []
        self.words: list[frozenset[int]] = []
        self.pairs: list[frozenset[tuple[int, int]]] = []
        self.anchored: dict[int, list[int]] = {}
        self.search: ahocorasick.Automaton | None = None

    @staticmethod
    def circle(symbols: list[int]) -> list[int]:
        return symbols + symbols[:1] if len(symbols) > 2 else symbols

    def add(self, key: bytes, digits: str, passage: str) -> None:
        """Every passage once."""
        symbols = [self.symbols.setdefault(f"{w} {digits}", len(self.symbols) + 1) for w in passage.split(" ")]
        for s in symbols[: len(symbols) - common_words(len(symbols), self.share) + 1]:
            self.anchored.setdefault(s, []).append(len(self.keys))
        round_ = self.circle(symbols)
        self.keys.append(key)
        self.words.append(frozenset(symbols))
        self.pairs.append(frozenset(zip(round_, round_[1:])))

    def automaton(self) -> ahocorasick.Automaton:
        if self.search is None:
            self.search = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for s in self.anchored:
                self.search.add_word((s,), (s,))
            for pair in {pair for pairs in self.pairs for pair in pairs}:
                self.search.add_word(pair, pair)
            if self.anchored:
                self.search.make_automaton()
        return self.search

    def matches(self, digits: str, passage: str) -> Iterator[tuple[bytes, int, int]]:
        """Key, common words and length of the longer question, for each evaluation question that overlaps."""
        symbols = [self.symbols.get(f"{w} {digits}", 0) for w in passage.split(" ")]
        m = len(symbols)
        if not any(symbols):
            return
        hits = [(end + 1 - len(gram), end + 1, gram) for end, gram in self.automaton().iter(tuple(self.circle(symbols)))]
        for k in {k for _, _, gram in hits if len(gram) == 1 for k in self.anchored[gram[0]]}:
            n = len(self.words[k])
            longer = max(n, m)
            least = common_words(longer, self.share)
            if min(n, m) < least:
                continue
            pairs, own = self.pairs[k], self.words[k]
            if covered(((a, e) for a, e, gram in hits if (gram in pairs if len(gram) == 2 else gram[0] in own)), m) < min(least, 3 * least - n - m + 1):
                continue
            both = len(own.intersection(symbols))
            if both >= least:
                yield self.keys[k], both, longer


def covered(intervals: Iterator[tuple[int, int]], m: int) -> int:
    """Words that intervals, merged, cover on a circle of m."""
    total, upto, first = 0, 0, 0
    for a, e in sorted(intervals):
        first = max(first, 1 - a)  # 1 if the first word is covered
        total, upto = total + max(0, e - max(a, upto)), max(upto, e)
    return total - (1 if upto > m and first else 0)


def find_overlaps(pairs: DataFrame, share: float = 0.75, shards: int | None = None, part_rows: int = 100_000) -> DataFrame:
    """(eval_id, train_id, split, style, covered, longer): each evaluation row with each training row that asks the same.

    ``pairs`` needs pair_id, query, label, split and style; other columns are
    ignored. Only label 1 counts; split is matched after trimming and lower
    case; style is lower case, without what follows ``+``. Null or wordless
    queries match nothing; repeated rows each give their pairs; empty tables
    give none. covered is the number of common words.

    A question is scanned once, whatever the number of its rows. Passages go to
    shards by their anchors: a shard that has none of a training passage's anchors has
    no partner of it, as the rarest common word is an anchor of both. A shard is scanned in
    a grid of tasks with at most about ``part_rows`` passages of each side; a
    task holds the evaluation side and streams the training side.
    """
    spark = pairs.sparkSession
    stages = Stages(spark, "overlap")
    split = F.lower(F.trim("split"))
    rows = pairs.where(F.col("label") == 1).select(F.col("pair_id").cast("long").alias("row_id"), F.when(split == "train", 1).when(split.isin("val", "test"), 0).alias("side"), F.col("query").cast("string"), split.alias("split"), F.lower(F.trim(F.substring_index("style", "+", 1))).alias("style")).where("side is not null and query is not null")
    named = rows.select("row_id", "split", "style")
    rows = spread(rows.select("row_id", "side", "query"))
    frequencies = Frequencies.count(rows.select("query"), tokens_of, bits=22)
    marked = stages.keep(passages(rows, frequencies, share))
    distinct = marked.groupBy("key", "side").agg(*(F.first(c).alias(c) for c in ("digits", "passage", "anchors")))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    in_shards = F.array_distinct(F.transform("anchors", lambda a: F.pmod(a, F.lit(n)).cast("int")))
    routed = distinct.select("key", "side", "digits", "passage", F.explode(in_shards).alias("shard"))
    parts = routed.groupBy("shard").agg(*(F.ceil(F.count_if(F.col("side") == s) / part_rows).cast("int").alias(f"parts{s}") for s in (0, 1))).where("parts0 > 0 and parts1 > 0")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1))
    placed = routed.join(F.broadcast(parts), "shard").withColumns({"own": own, "other": across})  # a row a shard
    placed = placed.withColumn("cell", F.when(F.col("side") == 0, F.struct("own", "other")).otherwise(F.struct(F.col("other").alias("own"), F.col("own").alias("other"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, Shard(share)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in LINK.names}
            for s, i, j, side, key, digits, passage in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (s, i, j):
                    at, shard = (s, i, j), Shard(share)
                if side == 0:
                    shard.add(key, digits, passage)
                    continue
                for other, both, longer in shard.matches(digits, passage):
                    for k, v in zip(out, (other, key, both, longer)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=LINK)

    streamed = placed.repartition(n, "shard", "cell").sortWithinPartitions("shard", "cell", "side").select("shard", "cell.own", "cell.other", "side", "key", "digits", "passage")
    links = streamed.mapInArrow(run, "eval_key binary, train_key binary, covered int, longer int").distinct()
    ids = marked.select("row_id", "side", "key")
    ev = ids.where("side = 0").select(F.col("key").alias("eval_key"), F.col("row_id").alias("eval_id"))
    tr = ids.where("side = 1").select(F.col("key").alias("train_key"), F.col("row_id").alias("train_id"))
    found = links.join(ev, "eval_key").join(tr, "train_key").select("eval_id", "train_id", "covered", "longer")
    return found.join(named.withColumnRenamed("row_id", "eval_id"), "eval_id")


def overlap_report(found: DataFrame) -> DataFrame:
    """Overlapping pairs and evaluation rows by split and style."""
    per = found.groupBy("split", "style", "eval_id").agg(F.count("*").alias("n"))
    return per.groupBy("split", "style").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_eval_rows"))
