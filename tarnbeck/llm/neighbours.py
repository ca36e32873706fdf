"""The k most similar vectors of every vector, by balanced posting lists.

Equal vectors are handled as one. Centroids are fitted on a bounded sample.
Every vector is stored in the list of its nearest centroid and, near a
boundary, in a further list. A graph over the centroids (each knows its nearest
ones) finds a query's nearest centroid by a greedy walk and the lists around
it; lists much farther than the nearest are pruned by a distance ratio. Lists
that lie together form a region of a bounded number of vectors. Every vector is a query, too, and is sent to the regions that hold
its lists; a task holds a region, or a slice of one with a long list, and queries stream past it. What a
query's tasks found is joined.
Vectors are sent with 16 bits an element and scored by their distance, so
that the order among near copies is kept; what this rounding leaves open at the
k-th place is ranked by the full vectors.
Where only neighbours of a least cosine are asked for, see ``CloseIndex``: lists
are chosen by planes between centroids, and a pair is found from either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions.vector import cosine
from tarnbeck.lineage import Stages, spread

SCALE = 32767
EXACT = float(1 << 30)
TIE = 5e-7  # cosines are ranked by six digits
FLOAT = 4.1e-6  # error of a 32-bit product of 66 terms, against the sum of their absolute values


@dataclass(frozen=True)
class Settings:
    """list_size: vectors a list; hood_lists: lists around a centroid, of which a query searches its own nearest most_lists, and at least least_lists; ratio: distance up to which a list is searched,
    against the nearest; closure: the same for storing in up to most_copies lists; most_regions: regions that a query visits, those with most of its lists;
    region_rows and task_queries: stored vectors and queries of a task, about; group: queries of a home list that go to the same task, about; sample: vectors the centroids are fitted on, or sample_each a centroid if that is more;
    most_centroids: bounds what every worker holds (beyond it, lists get longer and regions hold fewer of them);
    sigmas: how unusual the direction between two close vectors may be for the pair to be found all the same."""

    list_size: int = 500
    most_lists: int = 88
    hood_lists: int = 256
    least_lists: int = 8
    ratio: float = 1.6
    closure: float = 1.005
    most_copies: int = 2
    most_regions: int = 8
    region_rows: int = 100_000
    task_queries: int = 500_000
    group: int = 2000
    sample: int = 40_000
    sample_each: int = 8
    most_centroids: int = 65_536
    sigmas: float = 6.0

    def lists(self, total: int) -> int:
        return max(1, min(round(total / self.list_size), self.most_centroids))


def packed(df: DataFrame, dim: int) -> DataFrame:
    """(id, v, h): the usable vectors as 16-bit integers, and a digest of them at unit length with 31 bits an element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lengths = np.asarray(lists.value_lengths().fill_null(-1))
            keep = np.flatnonzero(lengths == dim)
            flat = lists.take(pa.array(keep)).flatten().cast(pa.float64()).fill_null(np.nan)
            x = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
            peak = np.abs(x).max(axis=1, initial=0)
            good = np.isfinite(x).all(axis=1) & (peak > 0)
            x = x[good] / peak[good, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            q = np.rint(x * EXACT).astype(np.int32)
            digests = [hashlib.md5(r.tobytes(), usedforsecurity=False).digest() for r in q]
            data = [r.tobytes() for r in np.rint(x * (SCALE / np.abs(x).max(axis=1, keepdims=True, initial=1e-9))).astype(np.int16)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep[good])), pa.array(data, pa.binary()), pa.array(digests, pa.binary())], names=["id", "v", "h"])

    return df.mapInArrow(run, "id long, v binary, h binary")


def unpack(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at unit length, and for each a bound of its distance to the vector before rounding."""
    q = np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64))
    return (q / np.maximum(norm, 1e-9)[:, None].astype(np.float32)).astype(np.float32), 0.51 * np.sqrt(dim) / np.maximum(norm, 1) + 5e-7


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a crowded centroid is made less attractive, which evens out list lengths."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    handicap = np.zeros(k, np.float32)
    for _ in range(rounds if k < len(x) else 0):
        a = np.concatenate([np.argmax(x[i : i + 4096] @ c.T - handicap, axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        sums = np.zeros_like(c)
        full = np.flatnonzero(n)
        sums[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n)[:-1]])[full], axis=0)
        empty = np.flatnonzero(n == 0)
        sums[empty] = x[rng.choice(len(x), len(empty))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
        handicap += 0.02 * np.clip(n * k / len(x) - 1, -1, 1).astype(np.float32)
    return c


def centroids_of(x: np.ndarray, k: int, rng: np.random.Generator, flat: int = 2048) -> np.ndarray:
    """k centroids, beyond ``flat`` of them in two levels: those of a level's cells are fitted on the cells' own vectors."""
    if k <= flat:
        return kmeans(x, k, rng)
    top = kmeans(x, int(np.sqrt(k)), rng)
    cell = np.concatenate([np.argmax(x[i : i + 4096] @ top.T, axis=1) for i in range(0, len(x), 4096)])
    order = np.argsort(cell, kind="stable")
    groups = [g for g in np.split(order, np.cumsum(np.bincount(cell, minlength=len(top)))[:-1]) if len(g)]
    upto = np.rint(np.cumsum([len(g) for g in groups]) * k / len(x)).astype(np.int64)
    return np.concatenate([kmeans(x[g], n, rng) for g, n in zip(groups, np.diff(upto, prepend=0)) if n])


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but for the last."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        waiting += [b] * bool(b.num_rows)
        if sum(w.num_rows for w in waiting) >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


class Index:
    """Centroids, their graph, and the tasks of each region. Its size is that of ``Settings.most_centroids`` at most."""

    def __init__(self, sample: np.ndarray, total: int, s: Settings, cores: int, places: int) -> None:
        rng = np.random.default_rng(7)
        self.settings = s
        self.centroids = centroids_of(sample, min(s.lists(total), max(1, len(sample) // 4)), rng)
        k = len(self.centroids)
        degree = min(k, s.hood_lists)
        self.near = np.empty((k, degree), np.int32)
        for a in range(0, k, 1024):
            sims = self.centroids[a : a + 1024] @ self.centroids.T
            top = np.argpartition(-sims, degree - 1, axis=1)[:, :degree]
            self.near[a : a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
        self.pivots = rng.choice(k, min(k, 5 * int(np.sqrt(k)) + 1), replace=False)
        # what the sample tells of list lengths, and of how many vectors and queries a region gets
        scale = total / len(sample)
        list_of = self.around(sample, 1)[1][:, 0]
        length = np.bincount(list_of, minlength=k) * scale + 1
        self.places = places
        self.sample = sample[np.argsort(list_of, kind="stable")]
        self.sample_at = np.concatenate([[0], np.cumsum(np.bincount(list_of, minlength=k))])
        self.shares_of_home = np.ceil(length / s.group).astype(np.int64)
        self.region = np.empty(k, np.int32)
        self.regions = 0
        self.divide(np.arange(k), length, self.wished(length.sum(), cores))
        _, _, _, region = self.stored(sample)
        slices = np.ceil(np.bincount(region, minlength=self.regions) * scale * 1.1 / s.region_rows)
        region = np.concatenate([r for _, r, *_ in self.visits(sample)])
        parts = np.ceil(np.bincount(region, minlength=self.regions) * scale / s.task_queries)
        self.slices = np.maximum(1, slices).astype(np.int64)
        self.parts = np.maximum(-(-cores // self.regions), parts).astype(np.int64)
        self.first_task = np.cumsum(self.slices * self.parts) - self.slices * self.parts
        self.tasks = int((self.slices * self.parts).sum())

    def wished(self, rows: float, cores: int) -> int:
        """How many regions there should be."""
        return max(int(np.ceil(rows / self.settings.region_rows)), min(round(np.sqrt(cores)), len(self.centroids)))

    def divide(self, lists: np.ndarray, length: np.ndarray, regions: int) -> None:
        """``regions`` of about as many vectors each, by cutting along the direction in which centroids differ most. A region is a single list at least."""
        if len(lists) == 1 or regions == 1:
            self.region[lists] = self.regions
            self.regions += 1
            return
        c = self.centroids[lists] - self.centroids[lists].mean(axis=0)
        along = c @ np.linalg.eigh(c.T @ c)[1][:, -1]
        order = np.argsort(along, kind="stable")
        upto = np.cumsum(length[lists][order])
        left = regions // 2
        cut = int(np.clip(np.searchsorted(upto, upto[-1] * left / regions) + 1, 1, len(lists) - 1))
        self.divide(lists[order[:cut]], length, min(left, cut))
        self.divide(lists[order[cut:]], length, min(regions - left, len(lists) - cut))

    def stored(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where vectors are stored, a row per vector and region: the lists there, as bounds into a flat array, the vector and the region."""
        sims, lists = self.around(x, self.settings.most_copies)
        far = np.sqrt(np.maximum(2 - 2 * sims, 1e-9))
        rows, cols = np.nonzero(far <= self.settings.closure * far[:, :1])
        held = lists[rows, cols]
        key = rows.astype(np.int64) * self.regions + self.region[held]
        order = np.argsort(key, kind="stable")
        uniq, first = np.unique(key[order], return_index=True)
        return np.append(first, len(order)), held[order], uniq // self.regions, uniq % self.regions

    def visits(self, x: np.ndarray, near_lists: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """What queries ask for, home list by home list: rows and the regions they visit, the home, the distance up to which each row searches lists, and a score.

        That score is one that as many sampled vectors as there are places reach in lists that the row searches, so lower ones needn't
        be looked at. (One more is counted, as the row may be in the sample; -9 if there are too few.)
        """
        s = self.settings
        at = self.walk(x)
        order = np.argsort(at, kind="stable")
        nodes, starts = np.unique(at[order], return_index=True)
        for node, a, b in zip(nodes, starts, [*starts[1:], len(order)]):
            hood = self.near[node]
            far = np.sqrt(np.maximum(2 - 2 * (x[order[a:b]] @ self.centroids[hood].T), 1e-9))
            last = lambda n: np.partition(far, min(n, len(hood)) - 1, axis=1)[:, min(n, len(hood)) - 1]
            limit = np.maximum(np.minimum(last(s.most_lists), s.ratio * far.min(axis=1)), last(s.least_lists))
            regions, which = np.unique(self.region[hood], return_inverse=True)
            wanted = (far <= limit[:, None]).astype(np.float32) @ (which[:, None] == np.arange(len(regions))).astype(np.float32)
            if len(regions) > s.most_regions:
                wanted[wanted < np.partition(wanted, len(regions) - s.most_regions, axis=1)[:, [len(regions) - s.most_regions]]] = 0
            least = np.full(b - a, -9.0, np.float32)
            some = np.concatenate([np.arange(self.sample_at[h], self.sample_at[h + 1]) for h in hood[:near_lists]])
            if len(some) > self.places and len(regions) <= s.most_regions:
                dots = x[order[a:b]] @ self.sample[some].T
                sizes = self.sample_at[hood[:near_lists] + 1] - self.sample_at[hood[:near_lists]]
                dots[np.repeat(far[:, :near_lists] > limit[:, None], sizes, axis=1)] = -9.0
                least = np.partition(dots, len(some) - self.places - 1, axis=1)[:, len(some) - self.places - 1]
            row, col = np.nonzero(wanted)
            yield order[a:b][row], regions[col], int(node), limit[row].astype(np.float32), np.where(least > -2, least - 1, -9.0)[row].astype(np.float32)

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row: from the best pivot along the graph as long as it gets nearer."""
        at = self.pivots[np.argmax(x @ self.centroids[self.pivots].T, axis=1)]
        active = np.arange(len(x))
        while len(active):
            order = active[np.argsort(at[active], kind="stable")]
            nodes, starts = np.unique(at[order], return_index=True)
            best = np.empty(len(order), np.int64)
            for node, a, b in zip(nodes, starts, [*starts[1:], len(order)]):
                hood = self.near[node, :48]
                best[a:b] = hood[np.argmax(x[order[a:b]] @ self.centroids[hood].T, axis=1)]
            moved = best != at[order]
            at[order] = best
            active = order[moved]
        return at

    def around(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row: similarities to the n nearest lists, and those lists, nearest first."""
        at = self.walk(x)
        n = min(n, self.near.shape[1])
        sims, lists = np.empty((len(x), n), np.float32), np.empty((len(x), n), np.int32)
        order = np.argsort(at, kind="stable")
        nodes, starts = np.unique(at[order], return_index=True)
        for node, a, b in zip(nodes, starts, [*starts[1:], len(order)]):
            hood = self.near[node, :48]
            found = x[order[a:b]] @ self.centroids[hood].T
            top = np.argsort(-found, axis=1, kind="stable")[:, :n]
            sims[order[a:b]], lists[order[a:b]] = np.take_along_axis(found, top, 1), hood[top]
        return sims, lists


class CloseIndex(Index):
    """An index for pairs with a cosine of at least ``least``.

    A vector is stored in the list of its nearest centroid, of all centroids. Two vectors a distance d apart lie on their
    own sides of the plane between their centroids, and one of them lies within d / 2 of it at most. The part of d across a
    plane is d / sqrt(dim) in the root mean square if directions are even, so half of ``sigmas`` times that is how far (``reach``)
    a query looks across planes; whoever looks tells the other (``Stored.across``). Centroids fitted on some of a small group of close vectors
    aren't independent of its directions: a query near a sampled vector looks as far as d / 2. Every list and region
    that is so near is searched. Only in crowds, where the sample has more than k vectors that near, a query searches
    most_lists lists for its own k best.
    """

    def __init__(self, sample: np.ndarray, total: int, s: Settings, cores: int, places: int, least: float) -> None:
        apart = np.sqrt(2 - 2 * least)
        self.least, self.half = least, float(apart / 2)
        self.reach = float(min(1.0, s.sigmas / np.sqrt(sample.shape[1]))) * self.half
        super().__init__(sample, total, s, cores, places)

    def wished(self, rows: float, cores: int) -> int:
        return max(int(np.ceil(1.3 * rows / self.settings.region_rows)), min(2 * cores, len(self.centroids)))  # room for uneven ones, so that few need slices

    def blocks(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Similarities to all centroids, some rows at a time."""
        rows = max(64, (1 << 22) // len(self.centroids))
        for a in range(0, len(x), rows):
            yield a, x[a : a + rows] @ self.centroids.T

    def walk(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(sims, axis=1) for _, sims in self.blocks(x)] or [np.empty(0, np.int64)])

    def stored(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        home = self.walk(x).astype(np.int32)
        return np.arange(len(x) + 1), home, np.arange(len(x)), self.region[home].astype(np.int64)

    def across(self, sims: np.ndarray, home: np.ndarray, lists: np.ndarray | slice, reach: np.ndarray | float) -> np.ndarray:
        """Which of some lists are within reach. ``sims``: to these lists, less those to the home."""
        homes, which = np.unique(home, return_inverse=True)
        apart = np.sqrt(np.maximum(2 - 2 * (self.centroids[homes] @ self.centroids[lists].T), 0))
        return sims >= apart.astype(np.float32)[which] * np.float32(-1) * np.reshape(np.asarray(reach, np.float32), (-1, 1)) - np.float32(1e-5)

    def visits(self, x: np.ndarray, near_lists: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As for ``Index``, for many homes at once; the distance is -1 for what isn't in a crowd (-2 if it looks as far as needed for certain), and the score -9."""
        s, k = self.settings, len(self.centroids)
        for a, sims in self.blocks(x):
            home, best = np.argmax(sims, axis=1), sims.max(axis=1)
            wanted = self.across(sims - best[:, None], home, slice(None), self.reach)
            limit, least = np.full(len(sims), -1.0, np.float32), np.full(len(sims), -9.0, np.float32)
            order = np.argsort(home, kind="stable")
            nodes, starts = np.unique(home[order], return_index=True)
            for node, b, e in zip(nodes, starts, [*starts[1:], len(order)]):
                hood, rows = self.near[node, :near_lists], order[b:e]
                some = np.concatenate([np.arange(self.sample_at[h], self.sample_at[h + 1]) for h in hood])
                dots = x[a + rows] @ self.sample[some].T
                near = dots >= self.least - 1e-4
                limit[rows[(near & (dots < 1 - 1e-6)).any(axis=1)]] = -2.0
                crowd = np.flatnonzero(np.count_nonzero(near, axis=1) > self.places)
                if not len(crowd):
                    continue
                dots, rows = dots[crowd], rows[crowd]
                around = self.near[node]
                far = np.sqrt(np.maximum(2 - 2 * sims[rows][:, around], 1e-9))
                last = lambda n: np.partition(far, min(n, len(around)) - 1, axis=1)[:, min(n, len(around)) - 1]
                limit[rows] = np.maximum(np.minimum(last(s.most_lists), s.ratio * far.min(axis=1)), last(s.least_lists))
                # the score must come from lists that are searched
                sizes = self.sample_at[hood + 1] - self.sample_at[hood]
                dots[np.repeat(far[:, : len(hood)] > limit[rows, None], sizes, axis=1)] = -9.0
                reached = np.partition(dots, len(some) - self.places - 1, axis=1)[:, len(some) - self.places - 1]
                least[rows] = np.maximum(reached, self.least) - 1
                wanted[rows] = False
                wanted[rows[:, None], around] = far <= limit[rows, None]
            sure = np.flatnonzero(limit == -2)
            wanted[sure] = self.across(sims[sure] - best[sure, None], home[sure], slice(None), self.half)
            row, held = np.nonzero(wanted)
            key = np.unique(row * self.regions + self.region[held])
            row = key // self.regions
            yield a + row, key % self.regions, home[row], limit[row], least[row]


ROUTED = "task int, role int, home int, rep long, bound float, least float, ids array<long>, v binary, lists array<int>"


def route(classes: DataFrame, index, dim: int) -> DataFrame:
    """Vectors as what is stored (role 0, for each task of its regions' slice; a query, too, if it has a home) and as queries alone (role 1, for each slice of the regions they visit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value

        def sent(b: pa.RecordBatch, row: np.ndarray, ids: pa.Array, task: np.ndarray, role: int, home: np.ndarray, bound: np.ndarray, least: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
            at = pa.array(row)
            return pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(np.full(len(row), role, np.int32)), pa.array(home, pa.int32()), b.column(0).take(at), pa.array(bound, pa.float32()), pa.array(least, pa.float32()), b.column(1).take(ids), b.column(2).take(at), lists], names=["task", "role", "home", "rep", "bound", "least", "ids", "v", "lists"])

        def copies(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows repeated n times each, and the number of the copy."""
            return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

        for b in gathered(batches, 1 << 16):  # homes are handled one by one, so that few rows each would be slow
            x, _ = unpack(b.column(2), dim)
            deal = (np.asarray(b.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
            found = list(ix.visits(x))
            row, region, bound, least = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3, 4))
            home = np.concatenate([np.broadcast_to(f[2], len(f[0])) for f in found])
            own, copy = copies(ix.slices[region])
            row, region, bound, least, home = row[own], region[own], bound[own], least[own], home[own]
            part = (home + deal[row] % ix.shares_of_home[home] * 7) % ix.parts[region]
            asked = row * ix.tasks + ix.first_task[region] + copy * ix.parts[region] + part
            first, held, kept, region = ix.stored(x)
            own, copy = copies(ix.parts[region])
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(held, pa.int32())).take(pa.array(own))
            there = kept[own] * ix.tasks + ix.first_task[region[own]] + deal[kept[own]] % ix.slices[region[own]] * ix.parts[region[own]] + copy
            # a query to a task that has the vector anyway is sent with it
            order = np.argsort(asked, kind="stable")
            at = np.minimum(np.searchsorted(asked[order], there), len(order) - 1)
            both = asked[order][at] == there
            yield sent(b, kept[own], pa.array(kept[own]), there % ix.tasks, 0, np.where(both, home[order][at], -1), np.where(both, bound[order][at], 0), np.where(both, least[order][at], -9), lists)
            alone = ~np.isin(asked, there)
            known = np.isin(row[alone], kept[own][both]) & (not isinstance(ix, CloseIndex))  # the ids of a query need to come from one task only, unless it is told to others
            yield sent(b, row[alone], pa.array(row[alone], mask=known), asked[alone] % ix.tasks, 1, home[alone], bound[alone], least[alone], pa.nulls(int(alone.sum()), pa.list_(pa.int32())))

    return classes.select("rep", "ids", "v").mapInArrow(run, ROUTED)


PARTIAL = "rep long, ids array<long>, found array<long>, score array<float>, doubt float"


class Stored:
    """The vectors of one task, by list. Queries stream past them."""

    def __init__(self, rows: pa.Table, ix: Index, dim: int) -> None:
        self.ix, self.dim = ix, dim
        rows = rows.combine_chunks()
        (x, self.error), self.reps = unpack(rows["v"].combine_chunks(), dim), np.asarray(rows["rep"])
        lists, ids = rows["lists"].combine_chunks(), rows["ids"].combine_chunks()
        owner = np.repeat(np.arange(len(x)), np.asarray(lists.value_lengths()))
        which = np.asarray(lists.flatten())
        order = np.argsort(which, kind="stable")
        self.member, self.bounds = owner[order], np.searchsorted(which[order], np.arange(len(ix.centroids) + 1))
        self.x = np.ascontiguousarray(x[self.member])
        self.flat, self.n_ids = np.asarray(ids.flatten()), np.asarray(ids.value_lengths())
        self.id_at = np.cumsum(self.n_ids) - self.n_ids

        self.lists = np.flatnonzero(np.diff(self.bounds))
        self.centre = self.x.mean(axis=0) if len(self.x) else np.zeros(dim, np.float32)
        self.side = sided(self.x - self.centre, False)
        home = np.asarray(rows["home"])
        asks = np.flatnonzero(home >= 0)
        self.asks = asks[np.argsort(home[asks], kind="stable")]
        self.own = x[self.asks], self.error[self.asks], rows.take(pa.array(self.asks)).combine_chunks()

    def own_answers(self, k: int) -> Iterator[pa.RecordBatch]:
        """For the queries among the stored vectors, home by home."""
        if len(self.asks):
            x, errors, rows = self.own
            yield from self.by_home(x, errors, rows.to_batches()[0], k)

    def answers(self, batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """For a batch of queries from elsewhere, in the order of their homes: list by list; those without a first bound home by home."""
        x, errors = unpack(batch.column("v"), self.dim)
        bounded = np.asarray(batch.column("least")) > -8
        for rows, way in ((np.flatnonzero(bounded), self.by_list), (np.flatnonzero(~bounded), self.by_home)):
            if len(rows):
                yield from way(x[rows], errors[rows], batch.take(pa.array(rows)), k)

    def close(self, k: int, batch: pa.RecordBatch | None = None, rows: int = 8192) -> Iterator[pa.RecordBatch]:
        """For a batch of queries from elsewhere, or the stored ones: what a ``CloseIndex`` looks for."""
        x, errors, batch = (*unpack(batch.column("v"), self.dim), batch) if batch is not None else (*self.own[:2], self.own[2].to_batches()[0] if len(self.asks) else None)
        for a in range(0, len(x), rows):
            part = batch.slice(a, rows)
            crowd = np.asarray(part.column("bound")) >= 0
            for at, way in ((np.flatnonzero(crowd), self.by_home), (np.flatnonzero(~crowd), self.across)):
                if len(at):
                    for out in way(x[a + at], errors[a + at], part.take(pa.array(at)), k):
                        yield out.filter(pa.array(np.asarray(out.column("found").value_lengths()) > 0))

    def across(self, x: np.ndarray, errors: np.ndarray, batch: pa.RecordBatch, k: int, often: int = 32) -> Iterator[pa.RecordBatch]:
        """List by list; of what is found, vectors that don't look into the query's list are told of the query."""
        ix, home, asked = self.ix, np.asarray(batch.column("home")), np.asarray(batch.column("rep"))
        mine = sided(x - self.centre, True)
        wanted = ix.across(x @ ix.centroids[self.lists].T - np.einsum("ij,ij->i", x, ix.centroids[home])[:, None], home, self.lists, np.where(np.asarray(batch.column("bound")) == -2, ix.half, ix.reach))
        best = Best(self, asked, errors, -2.0 * mine[:, self.dim], np.full(len(x), ix.least - 1), k)
        first, told = best.thr.astype(np.float32), []
        for i, h in enumerate(self.lists):
            q = np.flatnonzero(wanted[:, i])
            if len(q):
                dots = mine[q] @ self.side[self.bounds[h] : self.bounds[h + 1]].T
                hot = np.flatnonzero(dots.max(axis=1) >= first[q])
                dots = dots[hot]
                at = np.flatnonzero(dots >= first[q[hot], None])
                row, j, score = q[hot[at // dots.shape[1]]], self.bounds[h] + at % dots.shape[1], dots.ravel()[at]
                may = score >= best.thr[row]
                best.pile.append((row[may], j[may], score[may]))
                other = np.flatnonzero(home[row] != h)
                plane = ix.centroids[h] - ix.centroids[home[row[other]]]
                beyond = other[np.einsum("ij,ij->i", self.x[j[other]], plane) > ix.reach * np.linalg.norm(plane, axis=1) - 1e-5]
                told.append((row[beyond], j[beyond], score[beyond]))
            if i % often == often - 1:
                best.merge()
        yield best.result(batch)
        row, j, score = (np.concatenate(t) for t in zip(*told)) if told else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        if len(row):
            j = self.member[j]
            ids = batch.column("ids").take(pa.array(row))
            n = np.asarray(ids.value_lengths())
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            off = np.nextafter(best.doubt(score, row, self.error[j]).astype(np.float32), np.float32(9))
            yield pa.RecordBatch.from_arrays([pa.array(self.reps[j]), pa.nulls(len(row), pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, ids.flatten()), pa.ListArray.from_arrays(ends, pa.array(np.repeat(np.minimum(score, 0), n).astype(np.float32))), pa.array(off)], names=["rep", "ids", "found", "score", "doubt"])

    def by_list(self, x: np.ndarray, errors: np.ndarray, batch: pa.RecordBatch, k: int, often: int = 32) -> Iterator[pa.RecordBatch]:
        """All queries against one list after the other; scores around the centre of all that is stored."""
        mine = sided(x - self.centre, True)
        wanted = np.sqrt(np.maximum(2 - 2 * (x @ self.ix.centroids[self.lists].T), 1e-9)) <= np.asarray(batch.column("bound"))[:, None] * np.float32(1 + 1e-5)
        best = Best(self, np.asarray(batch.column("rep")), errors, -2.0 * mine[:, self.dim], np.asarray(batch.column("least")), k)
        for i, h in enumerate(self.lists):
            q = np.flatnonzero(wanted[:, i])
            if len(q):
                best.look(q, mine[q] @ self.side[self.bounds[h] : self.bounds[h + 1]].T, self.bounds[h])
            if i % often == often - 1:
                best.merge()
        yield best.result(batch)

    def by_home(self, every: np.ndarray, errors: np.ndarray, batch: pa.RecordBatch, k: int, start: int = 4, often: int = 40) -> Iterator[pa.RecordBatch]:
        """Queries of one home list are taken together, and search its nearest lists first; scores around the home centroid, so that their error shrinks with the distance."""
        ix, bounds = self.ix, self.bounds
        home, limits, scores, asked = (np.asarray(batch.column(c)) for c in ("home", "bound", "least", "rep"))
        homes, starts = np.unique(home, return_index=True)  # rows come by home
        for c, a, e in zip(homes, starts, [*starts[1:], len(home)]):
            hood = ix.near[c]
            hood = hood[bounds[hood + 1] > bounds[hood]]
            if not len(hood):
                continue
            x, centre = every[a:e], ix.centroids[c]
            mine = sided(x - centre, True)
            wanted = np.sqrt(np.maximum(2 - 2 * (x @ ix.centroids[hood].T), 1e-9)) <= limits[a:e, None] * np.float32(1 + 1e-5)
            wanted[:, :start] = True
            best = Best(self, asked[a:e], errors[a:e], -2.0 * mine[:, self.dim], scores[a:e], k)
            open_ = np.flatnonzero(scores[a:e] < -8)
            if len(open_):  # the k-th best of the nearest lists is a first bound
                some = np.concatenate([np.arange(bounds[h], bounds[h + 1]) for h in hood[:start]])
                m = ix.settings.most_copies * (k + 1)  # a vector may stand here twice, and one is the query
                if len(some) > m:
                    dots = mine[open_] @ sided(self.x[some] - centre, False).T
                    best.thr[open_] = best.below(np.partition(dots, len(some) - m, axis=1)[:, len(some) - m], open_)
            for i, h in enumerate(hood):
                q = np.flatnonzero(wanted[:, i])
                if len(q):
                    best.look(q, mine[q] @ sided(self.x[bounds[h] : bounds[h + 1]] - centre, False).T, bounds[h])
                if i == start or i % often == often - 1:
                    best.merge()
            yield best.result(batch.slice(a, e - a))


class Best:
    """What a group of queries has found in a task. A score is minus half the squared distance (cosine - 1).

    Only what may still be among a query's k best is kept; ``thr`` starts at a score that sampled vectors reach.
    """

    def __init__(self, stored: Stored, asked: np.ndarray, own: np.ndarray, width: np.ndarray, scores: np.ndarray, k: int) -> None:
        self.stored, self.asked, self.own, self.k = stored, asked, own, k
        self.width = width  # squared distance of a query to the point that scores are computed around
        self.worst = max(stored.error.max(initial=0), own.max(initial=0))
        self.everyone = np.arange(len(asked))
        self.thr = self.below(scores.astype(np.float64) - 3e-6, self.everyone)
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        self.pile: list[tuple] = []

    def doubt(self, score: np.ndarray, row: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        """How far a score may be from that of the full vectors."""
        off, away = self.own[row] + other, np.sqrt(np.maximum(-2.0 * score, 0))
        return off * away + off * off + FLOAT * (self.width[row] + (np.sqrt(self.width[row]) + away + off) ** 2) + TIE

    def below(self, score: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The least score that may still beat a candidate of ``score``."""
        least = score - self.doubt(score, row, self.worst)
        for _ in range(3):
            other = self.doubt(least, row, self.worst)
            least = score - self.doubt(score, row, self.worst) - other
        return least - 0.1 * other

    def look(self, q: np.ndarray, dots: np.ndarray, first: int) -> None:
        """Scores of the queries ``q`` against the stored vectors from ``first`` on."""
        thr = self.thr[q].astype(np.float32)
        hot = np.flatnonzero(dots.max(axis=1) >= thr)
        if len(hot):
            dots = dots[hot]
            at = np.flatnonzero(dots >= thr[hot, None])
            self.pile.append((q[hot[at // dots.shape[1]]], first + at % dots.shape[1], dots.ravel()[at]))

    def merge(self) -> None:
        if not self.pile:
            return
        stored, k, n_rows = self.stored, self.k, len(self.asked)
        row, j, score = (np.concatenate(p) for p in zip(*self.pile))
        self.pile = []
        j = stored.member[j]
        other = stored.reps[j] != self.asked[row]
        row, j, score = distinct(*(np.concatenate(z) for z in zip(self.kept, (row[other], j[other], score[other]))), stored.reps)
        # of those that surely have a cosine of 1.000000, only the k smallest ids can be among the best
        top = score - self.doubt(score, row, stored.error[j]) > -2 * TIE
        tops, head = np.cumsum(top), np.searchsorted(row, row)
        few = ~top | (tops - tops[head] + top[head] <= k)
        row, j, score = row[few], j[few], score[few]
        order = np.lexsort((-score, row))
        row, j, score = row[order], j[order], score[order]
        n = np.bincount(row, minlength=n_rows)
        full = n >= k
        last = (np.cumsum(n) - n + k - 1)[full]
        self.thr[full] = np.maximum(self.thr[full], self.below(score[last].astype(np.float64), self.everyone[full]))
        few = score >= self.thr[row]
        self.kept = row[few], j[few], score[few]

    def result(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """For each query all ids that may be among its k best of this task, best first, and how far their scores may be off."""
        self.merge()
        stored, n_rows = self.stored, len(self.asked)
        row, j, score = self.kept
        off = self.doubt(score, row, stored.error[j])
        n = stored.n_ids[j]
        ids = np.repeat(stored.id_at[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, found, score, off = np.repeat(row, n), stored.flat[ids], np.repeat(score, n), np.repeat(off, n)
        sure, maybe = settle(row, score - off, score + off, self.k, n_rows)
        may = sure | maybe
        row, found, score, off = row[may], found[may], score[may], off[may]
        largest = np.zeros(n_rows, np.float32)
        np.maximum.at(largest, row, np.nextafter(off.astype(np.float32), np.float32(9)))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))]), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("ids"), pa.ListArray.from_arrays(ends, pa.array(found)), pa.ListArray.from_arrays(ends, pa.array(np.minimum(score, 0).astype(np.float32))), pa.array(largest)], names=["rep", "ids", "found", "score", "doubt"])


def settled(partial: DataFrame, k: int) -> DataFrame:
    """(rep, ids, found, score, open, places): from what the tasks of a query found, the ids that are sure, best first, and for the remaining places all that may have them."""
    both = F.collect_list(F.struct("found", "score"))
    joined = partial.groupBy("rep").agg(F.coalesce(F.first("ids", ignorenulls=True), F.array("rep")).alias("ids"), both.alias("b"), F.max("doubt").alias("doubt"))
    joined = joined.select("rep", "ids", F.flatten("b.found").alias("found"), F.flatten("b.score").alias("score"), "doubt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, score = b.column("found"), b.column("score")
            row = np.repeat(np.arange(b.num_rows), np.asarray(found.value_lengths()))
            found, score, off = np.asarray(found.flatten()), np.asarray(score.flatten()).astype(np.float64), np.asarray(b.column("doubt"))
            order = np.lexsort((-score, found, row))
            row, found, score = row[order], found[order], score[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            row, found, score = row[new], found[new], score[new]
            order = np.lexsort((found, -score, row))
            row, found, score = row[order], found[order], score[order]
            sure, maybe = settle(row, score - off[row], score + off[row], k, b.num_rows)

            def listed(chosen: np.ndarray, values: np.ndarray, row=row, n=b.num_rows) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=n))]), pa.int32()), pa.array(values[chosen]))

            places = k - np.bincount(row[sure], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("ids"), listed(sure, found), listed(sure, score.astype(np.float32)), listed(maybe, found), pa.array(places, pa.int32())], names=["rep", "ids", "found", "score", "open", "places"])

    return joined.mapInArrow(run, "rep long, ids array<long>, found array<long>, score array<float>, open array<long>, places int")


def sided(x: np.ndarray, left: bool) -> np.ndarray:
    """Two columns more, with which the product of a left and a right side is minus half the squared distance."""
    half, one = -0.5 * np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1), np.float32)
    return np.concatenate([x, half, one] if left else [x, one, half], axis=1)


def distinct(rows: np.ndarray, found: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without repeats (a vector may stand in two lists), by row and id."""
    order = np.lexsort((-score, ids[found], rows))
    rows, found, score = rows[order], found[order], score[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new], score[new]


def settle(row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates (by row, best first) are surely among a row's k best, and which may be. ``low`` and ``high`` bound their scores."""

    def nth(values: np.ndarray, n: int) -> np.ndarray:
        """The n-th greatest value of each row, -inf if it has fewer."""
        order = np.lexsort((-values, row))
        count = np.bincount(row, minlength=n_rows)
        out = np.full(n_rows, -np.inf)
        out[count >= n] = values[order][(np.cumsum(count) - count + n - 1)[count >= n]]
        return out

    sure = low > nth(high, k + 1)[row]
    return sure, ~sure & (high >= nth(low, k)[row])


def ranked_open(results: DataFrame, df: DataFrame, most: int = 100_000) -> DataFrame:
    """(rep, late, late_score): for the places that ``search`` left open, the best of the open ids by the full vectors.

    Their vectors are picked by a broadcast of the ids if there are at most ``most``, else by a join.
    """
    stages = Stages(df.sparkSession, "open")
    pairs = results.where(F.size("open") > 0).select("rep", "places", F.explode("open").alias("id"))
    ids = pairs.select(F.explode(F.array("rep", "id")).alias("chunk_id")).distinct()
    few = ids.limit(most + 1).count() <= most
    full = df.select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<float>").alias("w"))
    full = stages.keep(full.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi"))
    scored = pairs.join(full.select(F.col("chunk_id").alias("rep"), F.col("w").alias("x")), "rep").join(full.select(F.col("chunk_id").alias("id"), F.col("w").alias("y")), "id")
    scored = scored.select("rep", "places", "id", (cosine(F.col("x"), F.col("y")) - 1).alias("score"))
    order = F.row_number().over(Window.partitionBy("rep").orderBy(F.round("score", 6).desc(), "id"))
    best = scored.withColumn("r", order).where("r <= places").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    return best.select("rep", F.col("best.id").alias("late"), F.col("best.score").cast("array<float>").alias("late_score"))


def expanded(results: DataFrame, k: int) -> DataFrame:
    """A row per id and neighbour of (id, ids, found, score): the k best of the other ids with an equal vector and of what was found, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            me = np.asarray(b.column(0))
            parts = []
            for i, column in enumerate((1, 2)):
                n = np.asarray(b.column(column).value_lengths())
                row = np.repeat(np.arange(len(me)), n)
                score = np.zeros(len(row)) if i == 0 else np.asarray(b.column(3).flatten()).astype(np.float64)
                parts.append((row, np.asarray(b.column(column).flatten()), np.round(score, 6)))
            row, found, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
            other = found != me[row]
            row, found, score = row[other], found[other], score[other]
            order = np.lexsort((found, -score, row))
            row, found, score = row[order], found[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            keep = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(me[row[keep]]), pa.array(found[keep]), pa.array(rank[keep], pa.int32()), pa.array(np.round(1 + score[keep], 5))], names=["id", "neighbour", "rank", "cosine"])

    return results.mapInArrow(run, "id long, neighbour long, rank int, cosine double")


def nearest(df: DataFrame, k: int = 10, dim: int = 64, settings: Settings = Settings(), least: float | None = None) -> DataFrame:
    """(id, neighbour, rank, cosine): the k most similar other vectors of every usable vector.

    ``df`` needs chunk_id and vector; other columns are ignored. Usable is a
    vector of ``dim`` finite elements that aren't all zero; others (null, of
    another length, with a null or NaN) are neither queries nor neighbours.
    Equal vectors are neighbours of each other and come first; ties go to the
    smaller id; an empty table gives an empty result. Cosines, and the order
    among the k, are those of 16 bits an element (within about 0.0001); which
    are the k of the lists searched is decided by the full vectors where that
    is too coarse. Approximate in the lists searched: see the README for recall. Of many equal vectors only the k + 1 smallest ids
    are carried along, which is all that any list of k can show.

    With ``least``, neighbours with a smaller cosine are looked for no further and mostly left out.
    """
    spark = df.sparkSession
    stages = Stages(spark, "neighbours")
    vectors = stages.keep(packed(spread(df.select(F.col("chunk_id").cast("long"), F.col("vector").cast("array<float>"))), dim))
    hashes = vectors.select("id", "h")
    repeated = hashes.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h", "rep")
    same = stages.keep(hashes.join(repeated, "h").select("id", "rep"))  # equal vectors; only their ids move
    few = same.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)  # cut before the shuffle, too
    lists = stages.keep(few.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    copies = same.where("id <> rep")
    single = vectors.join(copies.select("id"), "id", "left_anti").withColumnRenamed("id", "rep")
    classes = single.join(lists, "rep", "left").select("rep", F.coalesce("ids", F.array("rep")).alias("ids"), "v")
    total = vectors.count() - copies.count()
    if not total:
        return spark.createDataFrame([], "id long, neighbour long, rank int, cosine double")
    most = max(settings.sample, settings.sample_each * settings.lists(total))
    part = min(1.0, most / total)
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy(F.xxhash64("rep"), "rep").select("v").limit(2 * most).collect()
    if not drawn:
        drawn = classes.orderBy("rep").select("v").limit(64).collect()
    sample, _ = unpack(pa.array([bytes(r.v) for r in drawn], pa.binary()), dim)
    cores = max(2, spark.sparkContext.defaultParallelism // 2)
    ix = Index(sample, total, settings, cores, k) if least is None else CloseIndex(sample, total, settings, cores, k, least)
    index = spark.sparkContext.broadcast(ix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, stored = [], None
        for b in batches:
            n = int(np.searchsorted(np.asarray(b.column("role")), 1))  # what is stored comes first
            if n:
                rows.append(b.slice(0, n))
            if n < b.num_rows and rows:
                if stored is None:
                    stored = Stored(pa.Table.from_batches(rows), index.value, dim)
                    yield from stored.own_answers(k) if least is None else stored.close(k)
                yield from stored.answers(b.slice(n), k) if least is None else stored.close(k, b.slice(n))
        if rows and stored is None:
            stored = Stored(pa.Table.from_batches(rows), index.value, dim)
            yield from stored.own_answers(k) if least is None else stored.close(k)

    routed = route(spread(classes), index, dim).repartitionById(ix.tasks, "task").sortWithinPartitions("role", "home")
    partial = routed.mapInArrow(run, PARTIAL)
    if least is not None:  # equal vectors are neighbours even if nothing else was found
        partial = partial.unionByName(lists.selectExpr("rep", "ids", "cast(array() as array<bigint>) found", "cast(array() as array<float>) score", "cast(0 as float) doubt"))
    results = stages.keep(settled(partial, k))
    late = ranked_open(results, df)
    found = F.concat("found", F.coalesce("late", F.array().cast("array<long>")))
    score = F.concat("score", F.coalesce("late_score", F.array().cast("array<float>")))
    results = results.join(late, "rep", "left").select("rep", "ids", found.alias("found"), score.alias("score"))
    members = (classes if least is None else results).select(F.col("rep").alias("id"), "rep").unionByName(copies)
    return expanded(members.join(results, "rep").select("id", "ids", "found", "score"), k)


def close_pairs(neighbours: DataFrame, chunks: DataFrame, least: float = 0.90, doubt: float = 0.03, most: int = 100_000) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: neighbours whose cosine is at least ``least``.

    Cosines of shipped vectors are a little rounded; pairs within ``doubt`` of the
    threshold are computed again from the full vectors of ``chunks``. Their ids are
    broadcast if there are at most ``most`` of them, else joined.
    """
    stages = Stages(chunks.sparkSession, "close")
    near = neighbours.where(F.col("cosine") >= least - doubt).groupBy(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).agg(F.max("cosine").alias("cosine"))
    near = stages.keep(near)
    sure, open_ = near.where(F.col("cosine") >= least + doubt), near.where(F.col("cosine") < least + doubt)
    ids = open_.select(F.explode(F.array("chunk_id_a", "chunk_id_b")).alias("chunk_id")).distinct()
    few = ids.limit(most + 1).count() <= most
    full = chunks.select("chunk_id", F.transform("vector", lambda x: x.cast("double")).alias("w")).join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")
    full = stages.keep(full)
    a, b = full.select(F.col("chunk_id").alias("chunk_id_a"), F.col("w").alias("x")), full.select(F.col("chunk_id").alias("chunk_id_b"), F.col("w").alias("y"))
    checked = open_.join(a, "chunk_id_a").join(b, "chunk_id_b").where(cosine(F.col("x"), F.col("y")) >= least)
    return sure.select("chunk_id_a", "chunk_id_b").unionByName(checked.select("chunk_id_a", "chunk_id_b"))
