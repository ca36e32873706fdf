from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.llm.common import words
from tarnbeck.llm.leaks import Patterns, find_leaks, word_spans

WORDS = [f"w{i}" for i in range(40)]
PASSAGE = " ".join(WORDS[:20])


def inside(small, big):
    return any(big[i : i + len(small)] == small for i in range(len(big) - len(small) + 1))


def brute(train, probes, run=12):
    out = set()
    for i, doc, query in train:
        for j, q, passage in probes:
            p, d = words(passage), words(doc)
            if any(inside(p[k : k + run], d) for k in range(len(p) - run + 1)) or (words(q) and inside(words(q), words(query))):
                out.add((i, j))
    return out


TRAIN = [
    (1, "x " + PASSAGE + " y", "nothing"),
    (2, " ".join(WORDS[3:15]).upper().replace(" ", " – "), None),
    (3, " ".join(WORDS[3:14]), "eleven words only"),
    (4, None, "So, WHERE is​ the  ke­y? now"),
    (5, "", ""),
    (6, "ｗ０ " + " ".join(WORDS[1:12]), "where is the key2"),
    (7, " ".join(WORDS) * 3, "is the where key"),
    (7, " ".join(WORDS[8:20]) + "_" + "w3", "is"),
    (8, "pad " * 50_000 + PASSAGE, None),
]
PROBES = [(1, "Where is the key?", PASSAGE), (2, None, None), (3, "", "short passage"), (4, "is", " ".join(WORDS[8:30])), (4, "is", " ".join(WORDS[8:30])), (5, "???", "…")]


def frames(spark, train=TRAIN, probes=PROBES):
    a = spark.createDataFrame(train, "pair_id long, doc string, query string").withColumns({"row_id": F.lit(9), "probe_id": F.lit(8), "text": F.lit("z")})
    return a, spark.createDataFrame(probes, "probe_id long, query string, passage string").withColumn("pair_id", F.lit(1))


def test_against_brute_force(spark):
    rows = find_leaks(*frames(spark)).collect()
    assert {(r.pair_id, r.probe_id) for r in rows} == brute(TRAIN, PROBES)
    for shard_chars in (60, 150):
        more = find_leaks(*frames(spark), shard_chars=shard_chars).collect()
        assert sorted(map(tuple, more)) == sorted(map(tuple, rows))


def test_offsets_point_at_the_words(spark):
    for r in find_leaks(*frames(spark)).collect():
        texts = [t for i, *t in TRAIN if i == r.pair_id]
        wanted = [words(x) for j, *p in PROBES if j == r.probe_id for x in p]
        assert any(inside(words(t[r.field == "query"][r.start : r.end]), w) and len(words(t[r.field == "query"][r.start : r.end])) == r.n_words for t in texts if t[r.field == "query"] for w in wanted)


def test_empty(spark):
    assert find_leaks(*frames(spark, [])).count() == 0
    assert find_leaks(*frames(spark, TRAIN, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 _-é́ﬁ①­​\n\t漢ΑΣİ", max_size=60))
def test_word_spans_cover_the_words(text):
    spans = word_spans(text)
    assert len(spans) == len(words(text))
    assert all(0 <= a < b <= len(text) for a, b in spans)


def test_more_shards_than_one_driver_would_hold(spark):
    rows = sorted(map(tuple, find_leaks(*frames(spark)).collect()))
    probes = PROBES + [(100 + i, f"filler question {i}", " ".join(f"f{i}x{k}" for k in range(30))) for i in range(60)]
    assert sorted(map(tuple, find_leaks(*frames(spark, TRAIN, probes), shard_chars=300).collect())) == rows


def test_automaton_grows_with_the_words():
    for n in (1000, 4000):
        held_out = Patterns([(1, "passage", " ".join(f"w{i % 700}" + "y" * (i // 700) for i in range(n)))], 12)
        assert len(held_out.search) <= n / 6 and held_out.search.get_stats()["nodes_count"] <= n + 1
    assert held_out.runs([f"w{i}" for i in range(5, 17)], "passage") == {1: [(0, 12)]}
    assert held_out.runs([f"w{i}" for i in range(5, 16)], "passage") == {}
