import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.llm.packing import fill_report, pack
from tarnbeck.llm.tokens import encoding, VOCABULARY


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tokens": F.lit("t"), "container": F.lit("c"), "cap": F.lit(1), "block": F.lit(2)})


def caps(spark, rows):
    return spark.createDataFrame(rows, "container string, capacity_tokens int")


def check(rows, capacities, placed):
    count = {i: len(encoding(VOCABULARY).encode_ordinary(t)) for i, t in rows if t}
    bins, per = defaultdict(list), defaultdict(list)
    for r in placed:
        bins[r.bin_id].append(r)
        per[r.container, r.doc_id].append(r)
    for b in bins.values():
        assert len({r.container for r in b}) == 1
        used = sum(r.tokens for r in b)
        assert used <= capacities[b[0].container] and {r.bin_tokens for r in b} == {used}
        assert all(abs(r.fill - used / capacities[r.container]) < 1e-6 for r in b)
    for c, cap in capacities.items():
        for i, n in count.items():
            pieces = sorted(per.pop((c, i), []), key=lambda r: r.piece)
            assert [r.piece for r in pieces] == list(range(len(pieces)))
            assert sum(r.tokens for r in pieces) == n
            assert len(pieces) == (1 if n <= cap else -(-n // cap)) if n else not pieces
            assert all(r.tokens == cap for r in pieces[:-1])
    assert not per
    return bins


def test_everything_fits_and_nothing_is_lost(spark):
    rows = [(i, "word " * ((i * 37) % 150 + (900 if i % 50 == 0 else 0))) for i in range(600)] + [(1000, None), (1001, ""), (1002, "x"), (1003, "漢字 " * 700), (1004, "a" * 30_000)]
    placed = pack(docs(spark, rows), caps(spark, [("s", 128), ("l", 512), ("l", 300), (None, 9), ("z", 0), ("n", None)]), block_docs=200)
    got = placed.collect()
    bins = check(rows, {"s": 128, "l": 512}, got)
    assert max(r.mean_fill for r in fill_report(placed).collect()) <= 1
    assert len(bins) < 2 * sum(r.tokens / {"s": 128, "l": 512}[r.container] for r in got)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.integers(1, 80))
def test_random_sizes(spark, sizes, cap):
    rows = [(i, "word " * n) for i, n in enumerate(sizes)]
    check(rows, {"c": cap}, pack(docs(spark, rows), caps(spark, [("c", cap)])).collect())


def test_empty(spark):
    assert pack(docs(spark, []), caps(spark, [("s", 10)])).count() == 0
    assert pack(docs(spark, [(1, "x")]), caps(spark, [])).count() == 0


def test_little_space_is_left(spark):
    """Documents of up to half the container, as in most corpora: bins are nearly full, and hardly more than the tokens need."""
    rng = random.Random(9)
    rows = [(i, "word " * int(min(250, rng.lognormvariate(3.6, 0.9)))) for i in range(4000)]
    report = fill_report(pack(docs(spark, rows), caps(spark, [("c", 512)]))).first()
    assert report.mean_fill >= 0.95 and report.n_bins <= 1.06 * report.tokens / 512 + 2
