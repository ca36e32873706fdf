"""Containment, percentiles, draws and nested rows against plain versions."""

import random
import re

from pyspark.sql import functions as F

from tarnbeck.operators import actions, curation, evaluation


def normal(t):
    return " ".join(t.lower().split())


def test_contained_in_both_directions(spark):
    long = "the quick brown fox jumps over the lazy dog by the river bank"
    train = ["before " + long + " after", long, "fox jumps over", "quick", "q", "x", "zz top", "unrelated words only", "pre" + long, long + "post", "  The   QUICK brown  ", "a" * 30 + "b" * 30 + " tail", "start " + "a" * 30 + "b" * 30, "", " ", None, "the river bank", "he lazy do", "river b"]
    held = [long, "a" * 30 + "b" * 30, "too short to count", "never seen anywhere but here, with no one who knows it", "word " + "a" * 30 + "b" * 30, None, "", "  " + long.upper() + "  "]
    a = spark.createDataFrame(list(enumerate(train)), "row_id long, text string")
    b = spark.createDataFrame(list(enumerate(held)), "item_id long, text string")
    want = {(i, j) for i, t in enumerate(train) if t and normal(t) for j, h in enumerate(held) if h and len(normal(h)) > 40 and (normal(h) in normal(t) or normal(t) in normal(h))}
    found = curation.contained(a, b)
    assert [tuple(r) for r in found.orderBy("row_id", "item_id").collect()] == sorted(want) and len(want) > 15
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert curation.contained(a, b.where("false")).count() == 0 and curation.contained(a.where("false"), b).count() == 0


def test_contained_in_random_texts(spark):
    rng = random.Random(6)
    words = ["ab", "abc", "b", "cab", "bca", "abcabc"]
    train = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)]
    held = [" ".join(rng.choices(words, k=rng.randint(10, 14))) for _ in range(20)]
    held += [t[k : k + 60] for t in train[:60] if len(t) > 80 for k in [rng.randrange(len(t) - 60)]]
    train += [h[k : k + rng.randint(1, 20)].strip() for h in held for k in [rng.randrange(len(h) - 20)]]
    a = spark.createDataFrame(list(enumerate(train)), "row_id long, text string")
    b = spark.createDataFrame(list(enumerate(held)), "item_id long, text string")
    want = {(i, j) for i, t in enumerate(train) if normal(t) for j, h in enumerate(held) if len(normal(h)) > 40 and (normal(h) in normal(t) or normal(t) in normal(h))}
    assert {tuple(r) for r in curation.contained(a, b).collect()} == want


def test_percentiles_of_skewed_groups(spark):
    rng = random.Random(7)
    rows = [("a", rng.choice([1.0, 2.0, 3.0])) for _ in range(500)] + [("b", rng.lognormvariate(0, 3)) for _ in range(700)] + [("c", 5.0), (None, 1.0), (None, 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.p): (r.value, r.n) for r in evaluation.percentile(df, ["g"], "v", [0, 50, 95, 100], cells=16).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        want |= {(g, float(p)): (v[round(p / 100 * (len(v) - 1))], len(v)) for p in (0, 50, 95, 100)}
    assert got == want
    calls = evaluation.latency(df.where("g = 'a'"), ["g"], "v").first()
    assert calls.n == 500 and calls.p99 == 3.0 and abs(calls.per_second - 1000 / calls["mean"]) < 1e-3


def test_draws_are_exact(spark):
    rows = spark.range(1000).selectExpr("id as pair_id", "concat('question number ', id div 2) as query", "'natural' as style")
    typos = curation.typo_rows(rows)
    assert typos.where("style <> 'natural+typo'").isEmpty() and curation.drawn(rows, "query", 0.3, 18).count() == 150
    assert 200 < typos.count() <= 300
    assert curation.augmented(rows, rows.select("pair_id", "query")).count() == 2000 + typos.count()


def test_nested_rows(spark):
    rows = [("q", (["a", "b", "c", "d", "e"], [0, 1, 0, 1, 0])), ("none", (["a"], [0])), ("bare", ([], [])), ("only", (["z"], [1]))]
    df = spark.createDataFrame(rows, "query string, passages struct<passage_text: array<string>, is_selected: array<int>>")
    assert sorted(map(tuple, curation.nested_pairs(df).collect())) == [("only", "z", 1), ("q", "a", 0), ("q", "b", 1), ("q", "c", 0)]


def test_no_content_is_shuffled(spark):
    files = spark.createDataFrame([(f"f{i}", i, 3, f"x{i % 4}z") for i in range(20)], "path string, at long, size long, content string").withColumn("mtime", F.timestamp_seconds("at"))
    plan = actions.duplicates(actions.digests(files))
    assert all("content" not in line for line in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line)
    assert {(r.keep, r.n_copies) for r in plan.collect()} == {(f"f{i}", 5) for i in range(4)}
    assert actions.trash_plan(files).count() == 16


def test_words_carry_no_text(spark):
    a = spark.createDataFrame([(1, "some text")], "row_id long, text string")
    b = spark.createDataFrame([(1, "some held-out text that is longer than forty characters")], "item_id long, text string")
    plan = curation.contained(a, b)._jdf.queryExecution().executedPlan().toString()
    exploded = [line for line in plan.split("\n") if "Generate explode" in line]
    assert exploded and not any(re.search(r"\[row_id#\d+L, t#", line) for line in exploded)
