import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm.common import Frequencies, hash_words, words
from tarnbeck.llm.neardup import Sketches, band_of, bits, near_duplicates, pieces, shingles

SCHEMA = "chunk_id long, text string"


def sets(rows, size):
    out = {}
    for i, t in rows:
        w = words(t)
        s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        if s:
            out[i] = s
    return out


def table(seed=3, n=250):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            w = words(rng.choice(rows)[1] or "") or ["a"]
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = rng.sample(vocabulary, rng.randint(0, 2))
                w = w or ["a"]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[k:] + w[:k]
        else:
            w = rng.choices(vocabulary, k=rng.randint(1, 70))
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, " "), (902, "two words"), (903, "a b c"), (904, "A, b; C!"), (905, "long " * 30_000), (906, "long " * 30_001), (907, " ".join(f"u{i}" for i in range(20_000))), (908, " ".join(f"u{i}" for i in range(100, 20_100)))]


@pytest.mark.parametrize(("size", "share", "spare", "per"), [(3, 0.5, 1.0, 65_536), (5, 0.8, 1.0, 65_536), (1, 0.6, 1.0, 8), (3, 0.5, 0.0, 8)])
def test_against_brute_force(spark, size, share, spare, per):
    """With ``spare`` 0 every set with two shingles in a piece goes the exact way."""
    rows = table()
    assert spare or any(s.joined(Frequencies(np.zeros(2, np.uint8)))[5].sum() > 20 for s in [Sketches([t for _, t in rows], size, share, spare, per)])
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row_id": F.lit(1), "n": F.lit(2), "class": F.lit("c"), "a": F.lit(0), "blocks": F.lit(None)})
    near = near_duplicates(df, "chunk_id", "text", size, share, spare, per)
    s = sets(rows, size)
    ids = sorted(s)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(s[a] & s[b]) >= share * len(s[a] | s[b]) - 1e-9}
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {i: i for i in ids}
    for _ in ids:
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.row_id: r.group_id for r in near.groups().collect()} == parent


def test_few_sets_are_spoiled():
    rng = random.Random(8)
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([4, 20, 60, 200, 900]))) for _ in range(3000)]
    assert Sketches(texts, 3, 0.5, 1.0).joined(Frequencies(np.zeros(2, np.uint8)))[5].sum() <= 2


def test_empty(spark):
    near = near_duplicates(spark.createDataFrame([], SCHEMA), "chunk_id", "text")
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_sketches_bound_the_difference():
    rng = random.Random(5)
    for _ in range(30):
        w = [str(rng.randrange(50)) for _ in range(rng.randint(3, 60))]
        v = w[:]
        v[rng.randrange(len(v))] = "new"
        rows, hashes = shingles([" ".join(w), " ".join(v)], 3)
        a, b = ({int(h) for h in hashes[rows == i]} for i in (0, 1))
        brow, value = pieces(rows, hashes, np.full(len(rows), band_of(np.array([60]))[0]))
        x, y = ({int(z) for z in value[brow == i]} for i in (0, 1))
        assert len(x - y) <= len(a ^ b) and len(y - x) <= len(a ^ b)
        sketch = bits(rows, hashes, 2)
        assert sum(bin(int(p) ^ int(q) & (1 << 64) - 1 if q >= 0 else (int(p) ^ int(q)) & (1 << 64) - 1).count("1") for p, q in zip(*sketch)) <= 64 * 2
        assert sum(bin((int(p) ^ int(q)) & ((1 << 64) - 1)).count("1") for p, q in zip(*sketch)) <= len(a ^ b)


def test_counts_cover_all_rows(spark):
    df = spark.createDataFrame([(f"w{i % 50} common",) for i in range(5000)], "text string").repartition(5)
    f = Frequencies.count(df, lambda b: hash_words([w for t in b.column("text").to_pylist() for w in t.split()]), bits=16)
    of = f.of(hash_words(["common", "w7", "never seen"]))
    assert of[0] > of[1] > 31 and of[2] in (0, of[1], of[0])
    assert np.array_equal(f.of(hash_words(["w7"])), f.of(hash_words(["w7"])))


def test_bands_split_pairs_nowhere(spark):
    """A pair whose sizes lie on both sides of a band's end is found in the band of the larger."""
    w = [f"x{i}" for i in range(40)]
    rows = [(n, " ".join(w[:n])) for n in range(3, 40)]
    s = sets(rows, 3)
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.5 * len(s[a] | s[b])}
    assert any(band_of(np.array([len(s[a])])) != band_of(np.array([len(s[b])])) for a, b in want)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), "chunk_id", "text", 3, 0.5).pairs().collect()} == want
