import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnbeck.llm.common import words
from tarnbeck.llm.overlap import Shard, common_words, covered, find_overlaps, overlap_report

SCHEMA = "pair_id long, query string, label int, split string, style string"


def same(a, b):
    a, b = words(a), words(b)
    digits = lambda ws: Counter(w for w in ws if any(c.isdigit() for c in w))
    return bool(a and b) and digits(a) == digits(b) and 4 * (Counter(a) & Counter(b)).total() >= 3 * max(len(a), len(b))


def brute(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[2] == b[2] == 1 and (b[3] or "").strip().lower() == "train" and (a[3] or "").strip().lower() in ("val", "test") and same(a[1], b[1]):
                out.add((a[0], b[0]))
    return out


def table():
    texts = ["where is the red key of Anna", "where is the red key of Bob", "is red the where key of anna", "where is the key of Anna", "ref 123 of the key", "ref 124 of the key", "the key of REF 123!", "a a a b", "a a b b", "a b", "one", "One?", "", None, "?? !!", "ｏｎｅ", "x " * 900, "x " * 880 + "y", "the the the the", "the"]
    rows = []
    for i, t in enumerate(texts):
        for j, s in enumerate(["train", "val", "test", None, " Val "]):
            rows.append((100 * j + i, t, 1 if (i + j) % 7 else 0, s, ["Natural", "keyword+typo ", None][i % 3]))
    rows.append((999, "one", None, "train", "x"))
    return rows + rows[:3]


@pytest.mark.parametrize("options", [{}, {"shards": 1, "part_rows": 3}, {"shards": 50}])
def test_against_brute_force(spark, options):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "side": F.lit(2), "row_id": F.lit(3), "text": F.lit("t")})
    found = find_overlaps(df, **options).collect()
    assert {(r.eval_id, r.train_id) for r in found} == brute(rows)
    assert all(r.covered >= 0.75 * r.longer for r in found)


def test_report_counts_rows_and_pairs(spark):
    rows = [(1, "a b c d", 1, "train", "x"), (2, "a b c d", 1, "train", "x"), (3, "a b c d", 1, "val", "Natural+typo"), (4, "d c b a", 1, "val", "natural ")]
    report = overlap_report(find_overlaps(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [tuple(r) for r in report] == [("val", "natural", 4, 2)]


def test_empty(spark):
    assert find_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0
    assert find_overlaps(spark.createDataFrame([(1, "a", 1, "val", None)], SCHEMA)).count() == 0


def test_coverage_on_a_circle():
    assert covered([(0, 2), (1, 3)], 5) == 3 and covered([(4, 6), (0, 1)], 5) == 2 and covered([(2, 4), (0, 1)], 5) == 3 and covered([], 5) == 0


def test_intervals_cover_what_the_bound_says():
    """Links come from the merged intervals: the bound loses no pair of random sets, and without neighbours nothing is covered enough."""
    rng = random.Random(1)
    links = 0
    for _ in range(3000):
        n, share = rng.randint(1, 14), rng.choice([0.75, 0.8])
        left = rng.sample(range(40), n)
        right = set(rng.sample(left, rng.randint((n + 1) // 2, n))) | set(rng.sample(range(40), rng.randint(0, n // 2)))
        text = lambda ws: " ".join(f"w{i:02}" for i in sorted(ws))
        shard = Shard(share)
        shard.add(b"e", "", text(left))
        got = list(shard.matches("", text(right)))
        longer = max(n, len(right))
        want = len(right & set(left)) >= common_words(longer, share)
        assert bool(got) == want
        links += want
    assert links > 300
    shard = Shard(0.75)
    shard.add(b"e", "", "a b c d e f")
    assert list(shard.matches("", "a b c d e x")) == [(b"e", 5, 6)]
    shard.pairs = [frozenset()]
    assert list(shard.matches("", "a b c d e x")) == []
