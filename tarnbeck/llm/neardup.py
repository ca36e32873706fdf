"""Near-duplicate texts by a parity-sketch join.

A text is the set of its word shingles, and falls into a band of sizes. The
sketch of a band is cut into pieces, a fixed number of them for a shingle of its largest set; a shingle's 64
hash bits are XORed into one piece, so every bit of a piece is a parity, and the number of pieces in
which two sketches differ never exceeds the symmetric difference of the sets. Two sets of enough
similarity therefore agree on a known number of pieces (pigeonhole). A pair is looked for
in the band of its larger set: sets are joined on band and piece, each with its
rarest pieces only, as many as make sure that enough of those that agree are among them.
A second sketch of 128 single parities, whose Hamming distance also bounds the symmetric difference from
below, discards most candidates before the texts are compared.

In a piece that holds several shingles of a set, a difference may hide what else agrees. How many shingles
fall into a piece that is taken already is counted for each set; sets with more
of them than is allowed for are joined once more on their shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.lineage import Stages, spread

from .common import Frequencies, hash_words, words
from .components import components

RATIO = 16  # sizes of a band: from a power of this to the next
PIECES = 65_536  # pieces of a band's sketch for each shingle of its largest set: so many that two of a set seldom share one
MOST_AMONG = 500_000  # shingles of spoiled sets that are sent to tasks
SHARED = 3  # pieces that two sets have to share among their rarest
SKETCH = "row_id long, class binary, n int, crowd int, s0 long, s1 long, spoiled boolean, pieces array<struct<band: int, early: boolean, piece: long>>"


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct shingles of each text, sorted by row and hash."""
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    hashes = hash_words([w for ws in split for w in ws])
    rows = np.repeat(np.arange(len(n)), n)
    last = np.repeat(np.cumsum(n), n)
    starts = np.flatnonzero(np.arange(len(rows)) + size <= last)
    mixed = np.zeros(len(starts), np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    rows = rows[starts]
    order = np.lexsort((mixed, rows))
    rows, mixed = rows[order], mixed[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (mixed[1:] != mixed[:-1])
    return rows[new], mixed[new]


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


def pieces(rows: np.ndarray, hashes: np.ndarray, band: np.ndarray, per: int = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the non-zero pieces of sketches in the given ``band`` (of each shingle); a piece's number and band are mixed into its value."""
    count = np.uint64(per) * np.uint64(RATIO) ** (band + 1).astype(np.uint64)
    piece = (hashes >> np.uint64(7)) % count
    order = np.lexsort((piece, rows))
    rows, piece, hashes, band = rows[order], piece[order], hashes[order], band[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(first)
    value = np.bitwise_xor.reduceat(hashes, at) if len(at) else hashes
    keep = value != 0
    token = (value[keep] + piece[at][keep] * np.uint64(0x9E3779B97F4A7C15) + band[at][keep].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return rows[at][keep], token ^ (token >> np.uint64(32))


def allowed(n: np.ndarray, band: np.ndarray, spare: float, per: int) -> np.ndarray:
    """Shingles of a set of n that may fall into a piece taken already: with ``spare`` 1 four times their mean number, and one."""
    return np.floor(spare * (1 + 2.0 * n * n / (per * float(RATIO) ** (band + 1))))


def bits(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit words a row, one bit flipped a shingle."""
    at = ((hashes >> np.uint64(40)) & np.uint64(127)).astype(np.int64)
    odd = (np.bincount(rows * 128 + at, minlength=n * 128) & 1).astype(np.uint8).reshape(n, 128)
    return np.packbits(odd, axis=1).view(np.int64).reshape(n, 2)


class Sketches:
    """The sketches of a batch of texts, each in its own band and, if its partner may be of the next one, in that, too."""

    def __init__(self, texts: list[str | None], size: int, share: float, spare: float = 1.0, per: int = PIECES) -> None:
        self.share, self.spare, self.per = share, spare, per
        self.rows, self.hashes = shingles(texts, size)
        self.n = np.bincount(self.rows, minlength=len(texts))
        own = band_of(self.n)
        reaches = (self.n > 0) & (self.n >= share * float(RATIO) ** (own + 1) - 1e-9)
        self.parts = []
        for up, chosen in ((0, self.n > 0), (1, reaches)):
            mine = chosen[self.rows]
            band = own + up
            rows, values = pieces(self.rows[mine], self.hashes[mine], band[self.rows[mine]], per)
            self.parts.append((band, chosen, rows, values))

    def values(self) -> np.ndarray:
        return np.concatenate([values for *_, values in self.parts])

    def joined(self, counts: Frequencies) -> tuple[np.ndarray, ...]:
        """Rows, bands and values of the pieces to join on, by row, whether they count for the smaller set of a pair, how crowded each set's pieces are, and which sets are spoiled.

        With |A - B| shingles that a partner B lacks, and at most ``allowed`` of B's own pieces spoiled, all
        other pieces of A agree with B's. So the first |A - B| + allowed + SHARED of A's pieces, in
        an order common to all sets, hold the first SHARED ones of those that agree, and B's hold
        them likewise. In its own band A may be the larger set, in the next it is the smaller. The smaller set of
        a pair (or both, if they are equal) lacks no more than a part (1 - share) / (1 + share), so fewer of its pieces count.
        """
        spoiled, crowd = np.zeros(len(self.n), bool), np.zeros(len(self.n), np.int64)
        kept = []
        for (band, chosen, rows, values), lacking in zip(self.parts, (1 - self.share, (1 - self.share) / (1 + self.share))):
            q = np.bincount(rows, minlength=len(self.n))
            excess = np.where(chosen, self.n - q, 0)
            crowd = np.maximum(crowd, excess)
            spoiled |= excess > allowed(self.n, band, self.spare, self.per)
            seen = counts.of(values)
            order = np.lexsort((values, seen, rows))
            rows, values, seen = rows[order], values[order], seen[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            most = np.floor(lacking * self.n + 1e-9) + allowed(np.ceil(self.n / self.share), band, self.spare, self.per) + SHARED
            few = (place < most[rows]) & (seen > 1)  # a piece counted once has no partner
            least = np.floor((1 - self.share) / (1 + self.share) * self.n + 1e-9) - np.floor(lacking * self.n + 1e-9)
            kept.append((rows[few], band[rows[few]], values[few], (place < (most + least)[rows])[few]))
        rows, band, values, early = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(rows, kind="stable")
        return rows[order], band[order], values[order], early[order], crowd, spoiled


def sketched(df: DataFrame, size: int, share: float, spare: float, per: int, frequencies: Frequencies) -> DataFrame:
    """A row per text with shingles: class of equal shingle sets, size, single parities, whether it is spoiled, and the pieces to join on."""
    shared = df.sparkSession.sparkContext.broadcast(frequencies.counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Frequencies(shared.value)
        for b in batches:
            s = Sketches(b.column(1).to_pylist(), size, share, spare, per)
            has = np.flatnonzero(s.n)
            ends = np.cumsum(s.n)
            sets = [hashlib.md5(s.hashes[ends[i] - s.n[i] : ends[i]].tobytes(), usedforsecurity=False).digest() for i in has]
            parities = bits(s.rows, s.hashes, len(s.n))
            rows, band, values, early, crowd, spoiled = s.joined(counts)
            m = np.bincount(rows, minlength=len(s.n))[has]
            items = pa.StructArray.from_arrays([pa.array(band, pa.int32()), pa.array(early), pa.array(values.view(np.int64))], names=["band", "early", "piece"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(sets, pa.binary()), pa.array(s.n[has], pa.int32()), pa.array(crowd[has], pa.int32()), *(pa.array(parities[has, i]) for i in range(2)), pa.array(spoiled[has]), lists], names=["row_id", "class", "n", "crowd", "s0", "s1", "spoiled", "pieces"])

    return df.mapInArrow(run, SKETCH)


def single_shingles(df: DataFrame, size: int, among: np.ndarray | None = None) -> DataFrame:
    """(row_id, shingle) of all texts (row_id, text), with ``among`` only those in that sorted array."""
    shared = df.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for b in batches:
            rows, hashes = shingles(b.column(1).to_pylist(), size)
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                rows, hashes = (x[wanted[at] == hashes] for x in (rows, hashes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(hashes.view(np.int64))], names=["row_id", "shingle"])

    return df.select("row_id", "text").mapInArrow(run, "row_id long, shingle long")


def spoiled_pairs(texts: DataFrame, reps: DataFrame, size: int, share: float, stages: Stages) -> DataFrame | None:
    """(a, b): pairs with a spoiled set, by counting common shingles; None if there is no such set.

    Up to ``MOST_AMONG`` shingles of such sets are sent to the tasks, which then pass on no others; more are joined.
    """
    marked = reps.where("spoiled").select("row_id", "n")
    if marked.isEmpty():
        return None
    mine = stages.keep(single_shingles(texts.join(marked.select("row_id"), "row_id", "left_semi"), size).join(marked, "row_id"))
    wanted = mine.select("shingle").distinct()
    few = wanted.limit(MOST_AMONG + 1).toArrow()["shingle"].to_numpy().view(np.uint64)
    others = single_shingles(texts, size, np.sort(few)) if len(few) <= MOST_AMONG else single_shingles(texts, size).join(wanted, "shingle", "left_semi")
    others = others.join(reps.select("row_id", F.col("n").alias("m")), "row_id").withColumnRenamed("row_id", "other")
    shared = mine.join(others, "shingle").where((F.col("row_id") != F.col("other")) & (F.least("n", "m") >= share * F.greatest("n", "m") - 1e-9))
    enough = F.ceil(share / (1 + share) * (F.col("n") + F.col("m")) - 1e-9)
    again = shared.groupBy("row_id", "other", "n", "m").agg(F.count("*").alias("c")).where(F.col("c") >= enough)
    return again.select(F.least("row_id", "other").alias("a"), F.greatest("row_id", "other").alias("b"))


class Near:
    """Result of a near-duplicate join: members (row_id, rep) and links (a, b, similarity) between representatives, a < b."""

    def __init__(self, members: DataFrame, links: DataFrame, stages: Stages) -> None:
        self.members, self.links, self.stages = members, links, stages

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every pair of rows, copies included."""
        left = self.members.select(F.col("rep").alias("a"), F.col("row_id").alias("x"))
        right = self.members.select(F.col("rep").alias("b"), F.col("row_id").alias("y"))
        linked = self.links.join(left, "a").join(right, "b").select("x", "y")
        copies = left.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
        return linked.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """(row_id, group_id, n_links): one row a text; group_id is the least row_id of what links connect, n_links the representative's links."""
        roots = components(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")), self.stages)
        degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        joined = self.members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        return joined.select("row_id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, size: int = 5, share: float = 0.8, spare: float = 1.0, per: int = PIECES) -> Near:
    """Texts whose sets of ``size``-word shingles have at least ``share`` of their union in common.

    Other columns are ignored. Null, blank and shorter texts have no shingle and
    are in no result; texts with equal shingle sets are copies of one
    representative (the least id), whose links stand for all of them; an empty
    table gives empty results. No candidate is capped and no pair lost: frequent pieces are
    joined last and only where a set has no rarer ones; how pieces are ordered depends on counters of bounded size, the result doesn't.
    """
    stages = Stages(df.sparkSession, "neardup")
    texts = spread(df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0

    def values(batch: pa.RecordBatch) -> np.ndarray:
        return Sketches(batch.column("text").to_pylist(), size, share, spare, per).values()

    frequencies = Frequencies.count(texts.select("text"), values, bits=Frequencies.bits_for(chars // 6))
    rows = stages.keep(sketched(texts, size, share, spare, per, frequencies))
    least = rows.groupBy("class").agg(F.min("row_id").alias("rep"))
    members = stages.keep(rows.select("row_id", "class").join(least, "class").select("row_id", "rep"))
    reps = rows.join(members.where("row_id <> rep").select("row_id"), "row_id", "left_anti")  # the fewer: copies
    keys = reps.select("row_id", "n", "crowd", "s0", "s1", F.explode("pieces").alias("p")).select("row_id", "n", "crowd", "s0", "s1", "p.*")
    a, b = keys.alias("a"), keys.alias("b")
    hamming = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    larger = F.greatest("a.n", "b.n")
    fits = (F.least("a.n", "b.n") >= share * larger - 1e-9) & (hamming <= (1 - share) / (1 + share) * (F.col("a.n") + F.col("b.n")) + 1e-9)
    sure = F.ceil(share * larger - 1e-9) - F.col("a.crowd") - F.col("b.crowd")  # pieces that agree at least
    need = F.greatest(F.lit(1), F.least(F.lit(SHARED), sure)).cast("int")
    early = (F.col("a.early") | (F.col("a.n") > F.col("b.n"))) & (F.col("b.early") | (F.col("b.n") > F.col("a.n")))
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.row_id") < F.col("b.row_id")) & early & fits).select(F.col("a.row_id").alias("a"), F.col("b.row_id").alias("b"), need.alias("need"))
    found = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    again = spoiled_pairs(texts, reps, size, share, stages)
    found = stages.keep(found if again is None else found.union(again).distinct())
    stages.drop(rows)
    involved = stages.keep(found.select(F.explode(F.array("a", "b")).alias("row_id")).distinct())  # written, so that Spark knows its size
    needed = texts.join(involved, "row_id", "left_semi")
    compared = found.join(needed.select(F.col("row_id").alias("a"), F.col("text").alias("x")), "a").join(needed.select(F.col("row_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows, hashes = shingles(batch.column(2).to_pylist() + batch.column(3).to_pylist(), size)
            count = np.bincount(rows, minlength=2 * n)
            pair, order = rows % n if n else rows, None
            order = np.lexsort((hashes, pair))
            p, h = pair[order], hashes[order]
            twice = (p[1:] == p[:-1]) & (h[1:] == h[:-1])
            both = np.bincount(p[1:][twice], minlength=n)
            union = count[:n] + count[n:] - both
            like = both / np.maximum(union, 1)
            keep = np.flatnonzero(both >= share * union - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(like[keep])], names=["a", "b", "similarity"])

    links = stages.keep(compared.mapInArrow(verify, "a long, b long, similarity double"))
    stages.drop(found, involved)
    return Near(members, links, stages)
