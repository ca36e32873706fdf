import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarnbeck.llm.splits import MISS, OVER, Flow, assign_splits, normal_path, normal_query, quotas

SCHEMA = "pair_id long, path string, anchor_id string, query string, label int"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p, a, q, _ in rows:
        find(i)
        a = (a or "").strip().lower()
        for key in (("p", normal_path(p)), ("a", None if a in ("", "none", "n/a") else a), ("q", normal_query(q))):
            if key[1]:
                parent[find(key)] = find(i)
    groups = defaultdict(list)
    for r in rows:
        groups[find(r[0])].append(r)
    return {r[0]: (min(x[0] for x in g), len({normal_path(x[1]) for x in g if normal_path(x[1])})) for g in groups.values() for r in g}


def table(n=400):
    rows = [(i, f"d/{i % 97}.md", f"a{i % 61}" if i % 3 else None, f"question {i % 211}?" if i % 5 else None, i % 2) for i in range(1, n)]
    rows += [(1000, " D\\\\0.MD ", "NONE", "", 1), (1001, "./d//./0.md", "n/a", "   ", None), (1002, None, None, None, 0), (1003, None, "none", "??", 1), (1004, "x/é.md", None, None, 1), (1005, "x/é.md", None, None, 1), (1006, None, " A7 ", None, 0)]
    rows += [(2000 + i, f"solo/{i}", None, None, i % 2) for i in range(200)]
    return rows


def run(spark, rows, targets, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"root": F.lit(1), "group_id": F.lit("clash"), "split": F.lit("x"), "n": F.lit(None)})
    return {r.pair_id: r for r in assign_splits(df, spark.createDataFrame(targets, "split string, share double"), **options).collect()}


TARGETS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


def test_groups_and_shares(spark):
    rows = table()
    got, want = run(spark, rows, TARGETS), brute(rows)
    assert {i: (r.group_id, r.n_paths) for i, r in got.items()} == want
    by_group = defaultdict(set)
    for r in got.values():
        by_group[r.group_id].add(r.split)
    assert all(len(s) == 1 for s in by_group.values())
    again = run(spark, rows, TARGETS)
    assert {i: r.split for i, r in got.items()} == {i: r.split for i, r in again.items()}


def test_shares_of_many_small_groups(spark):
    rows = [(i, f"f/{i // 3}", None, None, int(i % 4 == 0)) for i in range(3000)]
    for options in ({}, {"max_bundles": 1}, {"places": 8}):
        n = Counter(r.split for r in run(spark, rows, TARGETS, **options).values())
        assert abs(n["train"] - 2100) <= 6 and abs(n["val"] - 450) <= 6, (options, n)


def test_hot_group_goes_to_the_largest_share(spark):
    rows = [(i, "hot", None, None, 1) for i in range(400)] + [(1000 + i, f"f/{i}", None, None, 0) for i in range(600)]
    got = run(spark, rows, TARGETS)
    n = Counter(r.split for r in got.values())
    assert {got[i].split for i in range(400)} == {"train"} and n == {"train": 700, "val": 150, "test": 150}


@pytest.mark.parametrize("targets", [[], [("a", 1.0)], [("a", 0.5), ("a", 0.5), (None, 0.3), ("b", None), ("c", 0.5)]])
def test_odd_targets(spark, targets):
    got = run(spark, [(1, "p", None, None, 1), (2, "p", None, None, None), (3, None, None, None, 0)], targets)
    assert len(got) == 3 and {r.split for r in got.values()} <= ({s for s, x in targets if s and x} or {None})


def test_empty(spark):
    assert run(spark, [], TARGETS) == {}


def cost(flow, free, quota):
    over = sum(max(0, sum(f[s] for f in flow.values()) - q) for s, q in enumerate(quota))
    return OVER * over + MISS * sum(max(0, f[s] - free[b][s]) for b, f in flow.items() for s in range(len(f)))


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        shares = dict(zip("abc", [(0.6, 0.2, 0.2), (0.5, 0.3, 0.2), (0.34, 0.33, 0.33)][rng.randrange(3)]))
        bundles = [{"id": i, "n": rng.randint(1, 2), "size": rng.randint(1, 4)} for i in range(3)]
        found = Flow(bundles, shares)
        quota = [round(x * sum(b["n"] * b["size"] for b in bundles)) for x in shares.values()]
        ways = [[(x, y, b["n"] * b["size"] - x - y) for x in range(b["n"] * b["size"] + 1) for y in range(b["n"] * b["size"] + 1 - x)] for b in bundles]
        best = min(cost(dict(enumerate(w)), found.free, quota) for w in itertools.product(*ways))
        assert all(sum(found.flow[b["id"]]) == b["n"] * b["size"] for b in bundles)
        assert cost(found.flow, found.free, quota) == best


def test_rounding_keeps_quotas():
    assert quotas([{"id": 0, "n": 1, "size": 90}, {"id": 1, "n": 10, "size": 1}], {"a": 0.5, "b": 0.5}) == {0: {"a": 1, "b": 0}, 1: {"a": 0, "b": 10}}
    rng = random.Random(3)
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    bundles = [{"id": i, "n": rng.randint(1, 40), "size": i + 1} for i in range(3000)]
    taken = quotas(bundles, shares)
    rows = sum(b["n"] * b["size"] for b in bundles)
    assert all(sum(taken[b["id"]].values()) == b["n"] for b in bundles)
    for s, x in shares.items():
        assert abs(sum(taken[b["id"]][s] * b["size"] for b in bundles) - x * rows) <= 3


def test_too_many_splits_are_refused(spark):
    with pytest.raises(ValueError, match="more than 64 splits"):
        run(spark, [(1, "p", None, None, 1)], [(f"s{i}", 1.0) for i in range(65)])


def test_great_sizes_stay_exact(spark):
    rows = [(i, "a" if i < 606 else "b" if i < 1206 else f"f/{i}", None, None, 0) for i in range(1306)]
    n = Counter(r.split for r in run(spark, rows, [("x", 0.5), ("y", 0.5)], max_bundles=2).values())
    assert n == {"x": 653, "y": 653}
