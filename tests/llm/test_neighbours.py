import numpy as np
from pyspark.sql import functions as F

from tarnbeck.llm.neighbours import CloseIndex, Index, Settings, centroids_of, close_pairs, kmeans, nearest, packed, route

SCHEMA = "chunk_id long, vector array<float>"


def exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in np.lexsort((ids, -np.round(s[n], 6)))[:k]] for n, i in enumerate(ids)}


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if z is None else float(z) for z in v]) for i, v in rows], SCHEMA).withColumns({"id": F.lit(1), "v": F.lit(2), "rep": F.lit(3), "h": F.lit("h")})


def test_recall_with_many_lists(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(0, 12, 6000)] * 0.7 + rng.normal(size=(6000, 64))
    ids = rng.permutation(6000) + 1
    got = {}
    for r in nearest(frame(spark, zip(ids, x)), settings=Settings(list_size=50, most_lists=60, hood_lists=110, region_rows=1500)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = exact(ids, x, 10)
    assert all(len(got[i]) == 10 == len(set(got[i])) and i not in got[i] for i in want)
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9


def test_close_pairs_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64))
    near = x[:150] + rng.normal(size=(150, 64)) * np.linspace(0.2, 0.6, 150)[:, None]
    ids, every = np.arange(550), np.concatenate([x, near])
    df = frame(spark, zip(ids, every))
    want = exact(ids, every, 10)
    unit = every / np.linalg.norm(every, axis=1)[:, None]
    pairs = {(min(i, j), max(i, j)) for i, js in want.items() for j in js if unit[i] @ unit[j] >= 0.9}
    for most in (100_000, 0):
        assert {tuple(r) for r in close_pairs(nearest(df), df, most=most).collect()} == pairs


def test_unusable_and_equal_vectors(spark):
    base = list(np.eye(64)[0])
    rows = [(i, base) for i in range(30)] + [(100, [2 * z for z in base]), (101, np.eye(64)[1]), (200, None), (201, [1.0] * 32), (202, [0.0] * 64), (203, [float("nan")] + [1.0] * 63), (204, [float("inf")] + [1.0] * 63), (205, [None] + [1.0] * 63), (206, [])]
    got = {}
    for r in nearest(frame(spark, rows)).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.cosine))
    assert set(got) == set(range(30)) | {100, 101}
    assert [n for _, n, _ in sorted(got[0])] == list(range(1, 11))
    assert [n for _, n, _ in sorted(got[29])] == list(range(10))
    assert [n for _, n, _ in sorted(got[100])] == list(range(10)) and {c for *_, c in got[100]} == {1.0}
    assert [n for _, n, _ in sorted(got[101])] == list(range(10)) and {c for *_, c in got[101]} == {0.0}


def test_few_and_none(spark):
    assert nearest(frame(spark, [])).count() == 0
    assert nearest(frame(spark, [(1, np.eye(64)[0])])).count() == 0
    assert [tuple(r) for r in nearest(frame(spark, [(1, np.eye(64)[0]), (2, np.eye(64)[1])])).orderBy("id").collect()] == [(1, 2, 1, 0.0), (2, 1, 1, 0.0)]


def test_order_among_near_copies(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=64)
    for near in (0.155, 0.03, 0.004, 0.0005):  # median cosine about 0.988, 0.9995, 0.99999 and beyond six digits
        step = rng.normal(size=(1200, 64))
        copies = hot / np.linalg.norm(hot) + near * step / np.linalg.norm(step, axis=1)[:, None]
        x = np.concatenate([copies, rng.normal(size=(1200, 64))]).astype(np.float32)
        ids = rng.permutation(2400) + 1
        got = {}
        # every list is searched, so that only the order is tested
        for r in nearest(frame(spark, zip(ids, x)), settings=Settings(most_lists=256, least_lists=256, region_rows=800)).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        want = exact(ids, x.astype(np.float64), 10)
        missed = sum(len(set(want[i]) - got[i]) for i in want)
        assert missed == 0, (near, missed)


def test_tasks_grow_with_the_data_and_stay_bounded(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 12_000)] + rng.normal(size=(12_000, 64))).astype(np.float32)
    x[:4000] = centres[0] + 0.3 * rng.normal(size=(4000, 64))  # a third lies together
    x /= np.linalg.norm(x, axis=1)[:, None]
    settings = Settings(list_size=50, region_rows=800, task_queries=2000, most_lists=20, hood_lists=60)
    tasks = []
    for n in (3000, 12_000):
        part = x[rng.permutation(12_000)[:n]]
        ix = Index(part[::2], n, settings, 4, 10)
        classes = packed(frame(spark, enumerate(part)).select("chunk_id", "vector"), 64).selectExpr("id as rep", "array(id) as ids", "v")
        rows = route(classes, spark.sparkContext.broadcast(ix), 64).groupBy("task").agg(F.count_if(F.col("role") == 0).alias("stored"), F.count_if(F.col("home") >= 0).alias("queries")).collect()
        tasks.append(len(rows))
        assert max(r.stored for r in rows) <= 1.6 * settings.region_rows and max(r.queries for r in rows) <= 2 * settings.task_queries
        asked = route(classes, spark.sparkContext.broadcast(ix), 64).where("home >= 0").select("rep").distinct().count()
        assert asked == n
    assert tasks[1] >= 3 * tasks[0]


def test_two_levels_of_centroids_are_about_as_near():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 8000)] + 0.7 * rng.normal(size=(8000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    near = [(x @ c.T).max(axis=1).mean() for c in (kmeans(x, 300, rng), centroids_of(x, 300, rng, flat=50))]
    assert len(centroids_of(x, 300, rng, flat=50)) == 300 and near[1] >= 0.97 * near[0]


def pairs_of(ids, x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    at = {i: n for n, i in enumerate(ids)}
    return {(min(i, j), max(i, j)) for i, js in exact(ids, x, 10).items() for j in js if unit[at[i]] @ unit[at[j]] >= least}


def test_close_pairs_across_many_lists(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8, 64))[rng.integers(0, 8, 5000)] * 0.8 + rng.normal(size=(5000, 64))
    step = rng.normal(size=(2000, 64))
    x = np.concatenate([x, x[:2000] + step * (np.linspace(0.1, 0.48, 2000) * np.linalg.norm(x[:2000], axis=1) / np.linalg.norm(step, axis=1))[:, None]])
    groups = rng.normal(size=(40, 64))  # of 30 each, so that ten aren't all, and too small for a sample to show
    x = np.concatenate([x, (groups[:, None] + 0.25 * rng.normal(size=(40, 30, 64))).reshape(-1, 64)]).astype(np.float32)
    ids = rng.permutation(len(x)) + 1
    df, want = frame(spark, zip(ids, x)), pairs_of(ids, x.astype(np.float64))
    got = [tuple(r) for r in close_pairs(nearest(df, settings=Settings(list_size=20, region_rows=1000, sample=2000), least=0.9), df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_close_pairs_in_a_crowd(spark):
    rng = np.random.default_rng(9)
    for near in (0.4, 0.155, 0.004):
        step = rng.normal(size=(1200, 64))
        hot = rng.normal(size=64)
        x = np.concatenate([hot / np.linalg.norm(hot) + near * step / np.linalg.norm(step, axis=1)[:, None], rng.normal(size=(1200, 64))]).astype(np.float32)
        ids = rng.permutation(2400) + 1
        df, want = frame(spark, zip(ids, x)), pairs_of(ids, x.astype(np.float64))
        got = {tuple(r) for r in close_pairs(nearest(df, settings=Settings(most_lists=256, least_lists=256, region_rows=800), least=0.9), df).collect()}
        assert got == want, (near, len(want - got), len(got - want))


def test_close_pairs_of_equal_few_and_no_vectors(spark):
    base = list(np.eye(64)[0])
    df = frame(spark, [(i, base) for i in range(30)] + [(100, [2 * z for z in base]), (101, np.eye(64)[1]), (200, None), (202, [0.0] * 64)])
    x = np.array([base] * 31)
    assert {tuple(r) for r in close_pairs(nearest(df, least=0.9), df).collect()} == pairs_of([*range(30), 100], x)
    for rows, n in (([], 0), ([(1, base)], 0), ([(1, base), (2, base)], 1), ([(1, base), (2, np.eye(64)[1])], 0)):
        df = frame(spark, rows)
        assert close_pairs(nearest(df, least=0.9), df).count() == n


def test_nearest_list_is_never_missed():
    rng = np.random.default_rng(10)
    x = (rng.normal(size=(9, 64))[rng.integers(0, 9, 20_000)] * 0.5 + rng.normal(size=(20_000, 64))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ix = CloseIndex(x, 20_000, Settings(list_size=20), 4, 10, 0.9)
    assert (ix.walk(x[:3000]) == np.argmax(x[:3000] @ ix.centroids.T, axis=1)).all()
