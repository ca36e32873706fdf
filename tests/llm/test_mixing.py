from math import log

import pytest
from pyspark.sql import functions as F

from tarnbeck.lineage import Stages
from tarnbeck.llm.mixing import budgets, mix


def entropy(shares):
    return -sum(w * log(w) for w in shares.values() if w > 0)


def drawn(spark, sizes, targets, limits, total):
    rows = spark.createDataFrame([(s, sizes.get(s, 0), t, limits[s]) for s, t in targets.items()], "source string, size long, target double, limit int")
    table, x = budgets(rows, total, Stages(spark, "test"))
    return {r.source: r.budget for r in table.collect()}, x


def test_targets_are_met_while_no_limit_binds(spark):
    sizes, targets, limits = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 2}
    assert drawn(spark, sizes, targets, limits, 180) == ({"a": 100, "b": 80, "c": 0}, 1.0)
    assert drawn(spark, {}, targets, limits, 10)[0] == {"a": 0, "b": 0, "c": 0}


def test_a_limit_lowers_the_exponent_and_that_gives_the_weights(spark):
    sizes, targets, limits = {"a": 1000, "b": 100, "c": 400}, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 9, "b": 3, "c": 9}
    got, x = drawn(spark, sizes, targets, limits, 1500)
    assert 0 < x < 1 and abs(sum(got.values()) - 1500) <= 2 and 298 <= got["b"] <= 300
    u = {s: (sizes[s] / 1500) ** (1 - x) * targets[s] ** x for s in sizes}
    assert got == {s: pytest.approx(1500 * u[s] / sum(u.values()), abs=1) for s in u}
    # the plain targets, with the short source at its limit, would give others
    assert abs(got["a"] - (1500 - 300) * 2 / 3) > 20


def test_more_than_there_is(spark):
    sizes, targets, limits = {"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}
    assert drawn(spark, sizes, targets, limits, 10**9)[0] == {"a": 1000, "b": 300}
    assert drawn(spark, sizes, targets, limits, 1200)[0] == {"a": 1000, "b": 200}


def test_any_number_of_sources(spark):
    rows = spark.range(30_000).selectExpr("cast(id as string) as source", "id % 7 + 1 as size", "1.0D + id % 5 as target", "cast(1 + id % 3 as int) as limit")
    table, x = budgets(rows, 100_000, Stages(spark, "test"))
    out = table.join(rows.select("source", "limit"), "source").agg(F.count("*").alias("n"), F.sum("budget").alias("total"), F.max(F.expr("budget - size * limit")).alias("over")).first()
    assert out.n == 30_000 and out.over <= 0 and 0 <= x <= 1 and abs(out.total - 100_000) < 15_000  # budgets of a few tokens are rounded


def frames(spark, sizes, targets):
    rows = [(k * 10_000 + i, "word " * (i % 9 + 1), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(-1, None, "a"), (-2, "", "a"), (-3, "x", None), (-4, "x", " "), (-5, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_tokens": F.lit("x"), "block": F.lit(1), "limit": F.lit(2)})
    return docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = frames(spark, {"a": 4000, " A/": 100, "B": 300, "c": 20}, [("a", 0.6, 1), ("b", 0.3, 4), ("c", 0.1, 3), ("gone", 0.2, 5), (None, 0.5, 1), ("b", 0.1, 9)])
    m = mix(docs, targets)
    shares = {r.source: r for r in m.shares.collect()}
    rows = m.documents.collect()
    assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"].tokens == 0
    assert 0 < m.exponent < 1 and {r.exponent for r in shares.values()} == {round(m.exponent, 6)}
    for s in ("a", "b", "c"):
        mine = [r for r in rows if r.source == s]
        assert max(r.repeats for r in mine) <= {"a": 1, "b": 4, "c": 3}[s] == shares[s].max_repeats
        assert max(r.repeats for r in mine) - min(r.repeats for r in mine) <= 1
        assert sum(r.n_tokens * r.repeats for r in mine) == shares[s].tokens
    assert len(rows) == len({r.doc_id for r in rows})
    exact = mix(docs, targets, total_tokens=800, block_docs=4)
    got = {r.source: r.actual_share for r in exact.shares.collect()}
    assert got["a"] == pytest.approx(0.6, abs=0.02) and got["b"] == pytest.approx(0.3, abs=0.02) and got["c"] == pytest.approx(0.1, abs=0.02)
    assert sorted(map(tuple, exact.documents.collect())) == sorted(map(tuple, mix(docs, targets, total_tokens=800, block_docs=4).documents.collect()))


def test_entropy_target(spark):
    docs, targets = frames(spark, {"a": 3000, "b": 300}, [("a", 0.0, 9), ("b", 0.0, 9)])
    got = {r.source: r.actual_share for r in mix(docs, targets, target_entropy=0.6, total_tokens=9000).shares.collect()}
    assert entropy(got) == pytest.approx(0.6, abs=0.01)


def test_odd_inputs(spark):
    docs, targets = frames(spark, {"a": 5}, [("a", None, None), ("b", -1.0, -2)])
    m = mix(docs, targets)
    assert m.documents.count() == 0 and {r.actual_share for r in m.shares.collect()} == {0.0}
    docs, targets = frames(spark, {}, [])
    assert mix(docs, targets).documents.count() == 0
    docs, targets = frames(spark, {"a": 5}, [("a", 1.0, None)])
    assert {r.repeats for r in mix(docs, targets).documents.collect()} == {1}
