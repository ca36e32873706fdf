"""Train, validation and test splits that keep related records together.

Records that share a file, an anchor or a question, directly or through other
records, form one component. Components of identical size and label profile
(rows, positives, negatives) are bundled; a min-cost flow with a node a bundle decides how many rows of each go
to which split; the flow is rounded to whole components, and components take
their places in the order of a hash. Only the bundle table (its size is
bounded by ``max_bundles``) reaches the driver.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.lineage import Stages, spread

from .components import components

MOST_SPLITS = 64
NOTHING = {"", "none", "n/a"}  # fixed values: anchor ids that stand for nothing
MISS, OVER = 1, 8  # cost of a row beyond a split's share of a bundle, and beyond its quota


def normal_path(path: str | None) -> str | None:
    """The path up to outer spaces, case, kind and number of slashes, ``.`` segments and NFC; None if nothing is left."""
    if path is None:
        return None
    path = unicodedata.normalize("NFC", unicodedata.normalize("NFC", path.strip()).lower()).replace("\\", "/")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return ("/" if path.startswith("/") else "") + "/".join(parts) if parts else None


def normal_anchor(anchor: str | None) -> str | None:
    anchor = (anchor or "").strip().lower()
    return None if anchor in NOTHING else anchor


def normal_query(query: str | None) -> str | None:
    return " ".join((query or "").lower().split()).rstrip("?.! ") or None


def keyed(df: DataFrame) -> DataFrame:
    """(pair_id, label, p, a, q): digests of the normalised path, anchor and query, null where there is nothing."""

    def digest(kind: bytes, value: str | None) -> bytes | None:
        return None if value is None else hashlib.md5(kind + value.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, a, q = (b.column(i).to_pylist() for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([digest(k, f(x)) for x in xs], pa.binary()) for k, f, xs in ((b"p", normal_path, p), (b"a", normal_anchor, a), (b"q", normal_query, q)))], names=["pair_id", "label", "p", "a", "q"])

    rows = df.select(F.col("pair_id").cast("long"), F.col("label").cast("int"), *(F.col(c).cast("string") for c in ("path", "anchor_id", "query")))
    return rows.mapInArrow(run, "pair_id long, label int, p binary, a binary, q binary")


def relate(df: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Rows (pair_id, root) and components (root, group_id, n_rows, n_pos, n_neg, n_paths)."""
    first = rows = stages.keep(keyed(spread(df)))
    hub = F.coalesce("p", "a", "q")
    triples = rows.groupBy("p", "a", "q").agg(F.lit(1).alias("one"))
    links = triples.select(F.explode(F.array(F.struct(hub.alias("u"), F.col("a").alias("v")), F.struct(hub.alias("u"), F.col("q").alias("v")))).alias("e")).select("e.*")
    roots = components(links, stages)
    # a row follows its first key; a row without keys is a component of its own
    rows = rows.withColumn("node", F.coalesce(hub, F.concat(F.lit("row "), F.col("pair_id").cast("string")).cast("binary")))
    rows = stages.keep(rows.join(roots, "node", "left").select("pair_id", "label", "p", F.coalesce("root", "node").alias("root")))
    parts = rows.groupBy("root", "p").agg(F.min("pair_id").alias("low"), F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    groups = parts.groupBy("root").agg(F.min("low").alias("group_id"), F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count("p").alias("n_paths"))
    groups = stages.keep(groups)
    stages.drop(first)
    return rows.select("pair_id", "root"), groups


class Flow:
    """Min-cost flow of bundles into splits: source - bundle - split - sink.

    The arc from a bundle to a split is free up to the whole components that make
    up the split's share of the bundle (which keeps sizes and labels alike in all splits)
    and costs MISS a row beyond them; the arc of a split to the sink is free up to
    its quota and costs OVER a row beyond it. Bundles are sent one after the other
    along cheapest paths, found by Dijkstra's algorithm with potentials. A path may
    take back what earlier bundles sent; as every path alternates between bundles and splits,
    only the splits are kept in the heap, and for two splits the bundles that could move between them, by cost.
    """

    def __init__(self, bundles: list[dict], shares: dict[str, float]) -> None:
        self.splits = list(shares)
        self.free = {b["id"]: [min(b["n"], ceil(shares[s] * b["n"] - 1e-9)) * b["size"] for s in self.splits] for b in bundles}
        self.flow: dict[int, list[int]] = {}
        k = len(self.splits)
        rows = sum(b["n"] * b["size"] for b in bundles)
        self.room = [round(shares[s] * rows) for s in self.splits]
        self.potential = [0] * k
        self.movers = [[{-MISS: {}, 0: {}, MISS: {}} for _ in range(k)] for _ in range(k)]  # dicts as ordered sets
        self.cost_of: dict[tuple[int, int, int], int] = {}
        for b in sorted(bundles, key=lambda b: (-b["size"], b["id"])):
            self.flow[b["id"]] = [0] * k
            left = b["n"] * b["size"]
            while left:
                left -= self.augment(b["id"], left)

    def file(self, b: int) -> None:
        """Where a bundle's rows could move at which cost, after its flow has changed."""
        f, free = self.flow[b], self.free[b]
        for s in range(len(f)):
            for t in range(len(f)):
                if s != t:
                    cost = (0 if f[t] < free[t] else MISS) - (MISS if f[s] > free[s] else 0) if f[s] else None
                    old = self.cost_of.get((b, s, t))
                    if cost != old:
                        if old is not None:
                            del self.movers[s][t][old][b]
                        if cost is None:
                            del self.cost_of[b, s, t]
                        else:
                            self.movers[s][t][cost][b], self.cost_of[b, s, t] = None, cost

    def augment(self, b: int, most: int) -> int:
        """Sends up to ``most`` rows of a bundle along one cheapest path."""
        f, free, k = self.flow[b], self.free[b], len(self.splits)
        far = [(0 if f[s] < free[s] else MISS) - self.potential[s] for s in range(k)]
        via: list[tuple[int, int] | None] = [None] * k
        heap = [(far[s], -self.room[s], s) for s in range(k)]
        heapify(heap)
        done: set[int] = set()
        while heap:
            d, _, s = heappop(heap)
            if s in done:
                continue
            done.add(s)
            for t in range(k):
                cost = next((c for c, who in self.movers[s][t].items() if who), None) if t not in done else None
                if cost is not None and d + cost + self.potential[s] - self.potential[t] < far[t]:
                    far[t] = d + cost + self.potential[s] - self.potential[t]
                    via[t] = (s, next(iter(self.movers[s][t][cost])))
                    heappush(heap, (far[t], -self.room[t], t))
        self.potential = [p + d for p, d in zip(self.potential, far)]
        end = min(range(k), key=lambda s: (self.potential[s] + (0 if self.room[s] > 0 else OVER), -self.room[s]))
        steps, s = [], end
        while via[s] is not None:
            steps.append((via[s][1], via[s][0], s))
            s = via[s][0]
        push = min(most, self.room[end]) if self.room[end] > 0 else most
        if f[s] < free[s]:
            push = min(push, free[s] - f[s])
        for other, x, y in steps:
            g, h = self.flow[other], self.free[other]
            push = min(push, g[x] - h[x] if g[x] > h[x] else g[x])
            if g[y] < h[y]:
                push = min(push, h[y] - g[y])
        self.room[end] -= push
        f[s] += push
        for other, x, y in steps:
            self.flow[other][x] -= push
            self.flow[other][y] += push
        for other in {b, *(o for o, _, _ in steps)}:
            self.file(other)
        return push


def quotas(bundles: list[dict], shares: dict[str, float]) -> dict[int, dict[str, int]]:
    """Whole components of every bundle for every split: the flow, rounded.

    From the largest components on, what rounding gave a split too much or too little is made up
    for by all later bundles in proportion to their rows.
    """
    flow = Flow(bundles, shares).flow
    left = sum(b["n"] * b["size"] for b in bundles)
    owed = dict.fromkeys(shares, 0.0)
    out: dict[int, dict[str, int]] = {}
    for b in sorted(bundles, key=lambda b: (-b["size"], b["id"])):
        sent = dict(zip(shares, flow[b["id"]]))
        want = {s: max(0.0, sent[s] + owed[s] * b["n"] * b["size"] / left) for s in shares}
        take, n = dict.fromkeys(shares, 0), b["n"]
        for s in sorted(shares, key=lambda s: -want[s]):
            take[s] = min(n, int(want[s] / b["size"] + 1e-9))
            n -= take[s]
        for _ in range(n):
            take[max(shares, key=lambda s: (want[s] - take[s] * b["size"], shares[s]))] += 1
        for s in shares:
            owed[s] += sent[s] - take[s] * b["size"]
        left -= b["n"] * b["size"]
        out[b["id"]] = take
    return out


def assign_splits(df: DataFrame, targets: DataFrame, max_bundles: int = 20_000, places: int = 4096, seed: int = 0) -> DataFrame:
    """(pair_id, group_id, n_paths, split) for every row of ``df``.

    ``df`` needs pair_id, path, anchor_id, query and label; other columns are
    ignored. ``targets`` (split, share) is scaled to a sum of 1; without rows in
    it, split is null. Null, empty and placeholder keys relate nothing; repeated
    rows share all keys and so a split; an empty ``df`` gives an empty result.
    group_id is the least pair_id of the component, n_paths its distinct paths.
    The shares are met up to the size of the components that don't fit; equal
    components differ by a hash of group_id and ``seed`` only.
    """
    stages = Stages(df.sparkSession, "splits")
    rows, groups = relate(df, stages)
    shares = {r.split: float(r.share) for r in targets.where("split is not null and share > 0").groupBy("split").agg(F.max("share").alias("share")).limit(MOST_SPLITS + 1).collect()}
    if len(shares) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    shares = dict(sorted(shares.items()))
    profile = F.round(4 * F.col("n_pos") / F.col("n_rows"))
    exact = (F.col("n_rows").cast("double"), F.col("n_pos").cast("double"), F.col("n_neg").cast("double"))
    sizes = groups.select("n_rows", "n_pos", "n_neg").distinct()
    if sizes.limit(max_bundles + 1).count() > max_bundles:  # the greatest sizes stay exact, the others come in steps of a sixteenth of a power of two
        least = sizes.select("n_rows").orderBy(F.desc("n_rows")).limit(max_bundles // 2 + 1).agg(F.min("n_rows")).first()[0]
        classed = (-1 - F.floor(F.log2("n_rows") * 16).cast("double"), profile.cast("double"), F.lit(0.0))
        exact = tuple(F.when(F.col("n_rows") > least, x).otherwise(c) for x, c in zip(exact, classed))
    places_of = F.pmod(F.xxhash64("group_id", F.lit(seed)), F.lit(places)).cast("int")
    groups = groups.withColumns({"b0": exact[0], "b1": exact[1], "b2": exact[2], "place": places_of})
    if not shares:
        return rows.join(groups, "root").select("pair_id", "group_id", "n_paths", F.lit(None).cast("string").alias("split"))
    whole = sum(shares.values())
    shares = {s: x / whole for s, x in shares.items()}
    key = ["b0", "b1", "b2"]
    table = groups.groupBy(*key).agg(F.count("*").alias("n"), F.avg("n_rows").alias("size")).collect()
    bundles = [{"id": i, "n": r.n, "size": max(1, round(r["size"]))} for i, r in enumerate(table)]
    taken = quotas(bundles, shares)
    ends = []
    for i, r in enumerate(table):
        at = 0
        for s in sorted(shares):
            ends.append((r.b0, r.b1, r.b2, s, at, at + taken[i][s]))
            at += taken[i][s]
    spark = df.sparkSession
    cuts = spark.createDataFrame(ends, "b0 double, b1 double, b2 double, split string, first long, last long").where("last > first")
    # A component's rank in its bundle: components in earlier places, then its rank in its own place.
    per_place = groups.groupBy(*key, "place").agg(F.count("*").alias("here"))
    before = per_place.withColumn("before", F.sum("here").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
    # A place wholly inside one split needs no ranks; a window orders only the places that a cut goes through.
    spans = before.join(F.broadcast(cuts), key).withColumn("before", F.coalesce("before", F.lit(0))).where("before < last and before + here > first")
    spans = spans.groupBy(*key, "place").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("last", "split"))).alias("spans"))
    placed = groups.join(spans, [*key, "place"])
    whole_places = placed.where(F.size("spans") == 1).select("root", "group_id", "n_paths", F.col("spans")[0]["split"].alias("split"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*key, "place").orderBy(F.xxhash64("group_id", F.lit(seed + 1)), "group_id")) - 1
    cut_places = placed.where(F.size("spans") > 1).withColumn("rank", rank).select("root", "group_id", "n_paths", F.filter("spans", lambda s: F.col("rank") < s["last"])[0]["split"].alias("split"))
    return rows.join(whole_places.unionByName(cut_places), "root").select("pair_id", "group_id", "n_paths", "split")
