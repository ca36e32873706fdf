import numpy as np
from pyspark.sql import functions as F

from tarnbeck.functions import models
from tarnbeck.functions.vector import Best, best_rows, top_cosines
from tarnbeck.operators import retrieval
from tarnbeck.operators.index import SearchIndex, refreshed
from tarnbeck.operators.retrieval import best_sums


def chunks(spark, n=60):
    rows = spark.createDataFrame([(i, f"f{i % 9}.md", i, f"name{i % 5}", f"word{i % 7} word{i % 11} common") for i in range(n)], "chunk_id long, path string, chunk_index int, name string, text string")
    return rows.withColumn("vector", models.embedder()(F.col("text")))


def test_any_number_of_queries_is_answered(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(z) for z in rng.normal(size=8)]) for i in range(60)], "row_id long, vector array<double>")
    asked = spark.createDataFrame([(i, [float(z) for z in rng.normal(size=8)]) for i in range(30)], "query_id long, vector array<double>")
    one = top_cosines(asked, rows, 5, 8).collect()
    assert len({r.query_id for r in one}) == 30 and sorted(top_cosines(asked, rows, 5, 8, block=4, most_blocks=2).collect()) == sorted(one)
    index = SearchIndex.build(chunks(spark), str(tmp_path / "index"), shard_rows=20)
    asked = spark.createDataFrame([(i, f"common word{i % 11} name{i}") for i in range(30)], "query_id long, query string")
    one = retrieval.bm25_top(asked, index).collect()
    assert len({r.query_id for r in one}) == 30 and sorted(retrieval.bm25_top(asked, index, most_queries=8).collect()) == sorted(one)


def test_shards_and_filters_change_no_score(spark, tmp_path):
    asked = spark.createDataFrame([(1, "word3 common nowhere"), (2, "name2"), (3, None), (4, "?!"), (5, "nothing known")], "query_id long, query string")
    found = [sorted(retrieval.text_list(asked, SearchIndex.build(chunks(spark), str(tmp_path / f"i{n}"), shard_rows=n)).collect()) for n in (7, 1000)]
    assert found[0] == found[1] and {r.query_id for r in found[0]} == {1, 2}
    index = SearchIndex(spark, str(tmp_path / "i7"))
    rows = asked.where("query_id = 1").select("query_id", F.array(F.lit("word3"), F.lit("common")).alias("w")).collect()
    totals = {r.field: (r.n, r.avgdl) for r in index.totals().collect()}
    few, many = (sorted(retrieval.bm25_of(rows, index, totals, retrieval.LIMITS, most_in_filter=m)[0].collect()) for m in (10, 0))
    assert few == many
    assert "PushedFilters: [In(term" in index.postings().where(F.col("term").isin("a", "b"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 64))
    rows = spark.createDataFrame([(i, "p", i, "n", "t", [float(z) for z in v]) for i, v in enumerate(x)] + [(5000, "p", 1, "n", "t", None), (5001, "p", 1, "n", "t", [0.0] * 64)], "chunk_id long, path string, chunk_index int, name string, text string, vector array<float>")
    index = SearchIndex.build(rows, str(tmp_path / "index"), least_cells=1000, part_rows=30)
    assert index.centroids().count() > 10 and index.vectors().count() == 3000
    asked = spark.createDataFrame([(i, [float(z) for z in x[i] + 0.1]) for i in range(0, 3000, 20)], "query_id long, vector array<float>")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.vector_list(asked, index).collect()}
    some = {(r.query_id, r.chunk_id) for r in retrieval.vector_list(asked, index, probes=8).collect()}
    every = {(r.query_id, r.chunk_id) for r in retrieval.vector_list(asked, index, probes=4096).collect()}
    assert every == exact and len(some & exact) >= 0.9 * len(exact)


def test_refresh_policy(spark, tmp_path):
    index = refreshed(None, chunks(spark), str(tmp_path / "a"))
    assert index.rows().count() == 60
    assert refreshed(index, chunks(spark, 80), str(tmp_path / "b"), upto=70) is index
    assert refreshed(index, chunks(spark, 70), str(tmp_path / "c"), upto=70).rows().count() == 70


def test_search_of_odd_queries(spark, tmp_path):
    index = SearchIndex.build(chunks(spark), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word3 common"), (2, ""), (3, None)], "query_id long, query string").withColumn("vector", models.embedder()(F.col("query")))
    hits = retrieval.search(asked, index).collect()
    assert {r.query_id for r in hits} == {1} and [r.ref for r in sorted(hits, key=lambda r: r.ref)] == list(range(1, 9))
    assert retrieval.search(asked.where("false"), index).count() == 0
    empty = SearchIndex.build(chunks(spark).where("false"), str(tmp_path / "none"))
    assert retrieval.search(asked, empty).count() == 0


def test_percents_round_halves_to_even(spark):
    shown = spark.range(10_001).select((F.col("id") / 10_000).alias("s")).select("s", retrieval.percent(F.col("s")).alias("p")).collect()
    assert [r.p for r in shown] == [f"{100 * r.s:.0f}%" for r in shown]


def test_skipped_places_change_no_sum():
    rng = np.random.default_rng(8)
    for k in (1, 5, 24):
        for _ in range(60):
            found = []
            for share in rng.choice([0.002, 0.01, 0.1, 0.9], rng.integers(1, 7)):
                at = np.flatnonzero(rng.random(4000) < share)
                w = np.round(rng.random(len(at)) * -np.log(share), int(rng.integers(1, 7))) + 1e-9  # rough weights tie
                found += [(at, w, w.max())] * bool(len(at))
            if found:
                sums = np.zeros(4000)
                for at, w, _ in found:
                    sums[at] += w
                hit = np.unique(np.concatenate([at for at, _, _ in found]))
                want = sorted(zip(-np.round(sums[hit], 6), hit))[:k]
                at, s = best_sums(found, k, 4000, few=0)
                assert [(-b, a) for a, b in zip(at, s)] == [(b, a) for b, a in want]


def test_screened_rows_change_no_cosine():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(np.concatenate([rng.normal(size=(1500, 8)), rng.integers(-1, 2, (3000, 8)) + [9, 0, 0, 0, 0, 0, 0, 0]]).astype(np.float64))
    q = unit(np.concatenate([rng.normal(size=(20, 8)), x[1500:1520], -x[1500:1510]]))
    ids = rng.permutation(len(x))
    best = Best(q, 7)
    for a in range(0, len(x), 700):
        best.look(x[a : a + 700], x[a : a + 700].astype(np.float32), ids[a : a + 700], first=50, step=200)
    assert all((a == b).all() for a, b in zip(best.merge(), best_rows(q, x, ids, 7)))


def test_texts_are_joined_to_the_pool_only(spark, tmp_path):
    index = SearchIndex.build(chunks(spark), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word3 common")], "query_id long, query string").withColumn("vector", models.embedder()(F.col("query")))
    fused = retrieval.with_scores(retrieval.fuse(retrieval.vector_list(asked, index), retrieval.text_list(asked, index)), asked, index)
    assert "text" not in fused.columns and fused.where("score is null").count() == 0
    assert fused.count() == fused.select("chunk_id").distinct().count() >= 24
