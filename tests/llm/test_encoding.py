"""Held-out accuracy: texts garbled by known pairs, and clean ones that look odd."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm.encoding import LEAVE, PAIRS, STAY, garble, repair, ungarble, viterbi

SENTENCES = {
    "fr": ["Où est passée la clé ? Peut-être chez {n}, côté cour.", "Il a été décidé que {n} règlera {d} € avant l’été.", "Le café de {n} s’améliore, ça l’a même étonné."],
    "de": ["Der Schlüssel für {n} liegt drüben im Büro, größer als gedacht.", "Für {d} Stück hätte {n} höchstens fünf Euro bezahlt.", "Schöne Grüße von {n}, es läuft übermäßig gut."],
    "pl": ["Źle działa książka, trzeba będzie wymienić całość.", "Dziękuję, że {n} przyniósł źródło aż pod drzwi.", "Opłata wynosi {d} zł, płatność przelewem do piątku."],
    "ru": ["Встреча перенесена на {d}:15, место прежнее.", "Завтра {n} заберёт ключ и оставит записку.", "Всё проверено: чайник работает, замена не нужна."],
    "el": ["Πλήρωσα {d} ευρώ για το φανάρι.", "Το κλειδί του {n} έμεινε στο γραφείο.", "Η εγγύηση λήγει σύντομα, ρώτησε τον {n}."],
    "ja": ["{n}さんの鍵は二階の棚に置いてあります。", "来月までに書類の点検を済ませること。", "打ち合わせは{d}時からに変更になりました。"],
    "en": ["Don’t forget the jalapeño jar, it’s {n}’s.", "{n} picked the thick wrench – “dusty” he said…", "Paid £{d} (≈ €{d}) at the Café of {n}."],
}
ODD = ["IRMÃS: MAÇÃ E PÃO NO CHÃO; MÃOS À OBRA.", "Tolerance ±0.4 µm, §7 ¶2, ½ cup, 19 °C.", "├── crates\n│   └── rugs", "Þórvaldgarð sagði að húsið væri tómt", "caf&eacute; and na\\u00efve"]
FOR = {"fr": [("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("utf_8", "cp437"), ("cp1252", "utf_8")], "de": [("utf_8", "latin_1"), ("utf_8", "cp850")], "pl": [("cp1250", "cp1252"), ("utf_8", "cp1252")], "ru": [("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("utf_8", "cp1251")], "el": [("iso8859_7", "cp1252")], "ja": [("euc_jp", "cp1252"), ("utf_8", "cp1252")], "en": [("utf_8", "cp1252"), ("utf_8", "cp1252", "utf_8", "cp1252")]}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(1400):
        lang = rng.choice(list(SENTENCES))
        text = " ".join(rng.choice(SENTENCES[lang]).format(n=rng.choice("Zorvib Kelmat Pudrin Xafgem".split()) + str(i), d=rng.randint(1, 900)) for _ in range(rng.randint(2, 5)))
        if i % 40 == 0:
            text = rng.choice(ODD) + " " + text
        elif i % 10 == 0:
            pair = rng.choice(FOR[lang])
            bad = garble(text, pair)
            if bad != text:
                truth[i] = (text, bad, pair)
                text = bad
        rows.append((i, text))
    return rows, truth


def test_found_and_restored(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame(rows + [(-1, None), (-2, ""), (-3, "plain"), (-4, "x" * 100_000)], "doc_id long, text string").withColumns({"encodings": F.lit(1), "recovered": F.lit(2)})
    got = {r.doc_id: r for r in repair(df).collect()}
    found = set(got)
    assert len(found & set(truth)) >= 0.95 * len(truth), [truth[i] for i in set(truth) - found][:3]
    assert len(found - set(truth)) <= 0.02 * len(truth) + 1, [rows[i] for i in found - set(truth)][:3]
    whole = [i for i, (text, bad, pair) in truth.items() if ungarble(bad, pair) == text]
    assert sum(got[i].text == truth[i][0] for i in whole if i in got) >= 0.9 * len(whole)


def test_round_trips():
    for pair in PAIRS:
        for text in ("plain ascii", "Café", "Źle działa", "Всё проверено"):
            try:
                text.encode(pair[0])
            except UnicodeError:
                continue
            back = ungarble(garble(text, pair), pair)
            assert back in (text, None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repair(df).count() == 0
    assert repair(spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string")).count() == 0


def test_escaped_afterwards(spark, corpus):
    rows, _ = corpus
    text = "Schöne Grüße von Zorvib, es läuft übermäßig gut. Der Schlüssel liegt drüben im Büro."
    bad = garble(text, ("utf_8", "cp1252"))
    cases = [(-1, "".join(c if c.isascii() else f"&#{ord(c)};" for c in bad)), (-2, "".join(c if c.isascii() else f"\\u{ord(c):04x}" for c in bad)), (-3, "".join(c if c.isascii() else f"&#{ord(c)};" for c in text)), (-4, "\\ud83d\\ude00 &#55357; &amp; &#38; &nosuch;")]
    got = {r.doc_id: r.text for r in repair(spark.createDataFrame(rows + cases, "doc_id long, text string")).where("doc_id < 0").collect()}
    assert got == {-1: text, -2: text}


def test_misread_as_utf16_and_odd_but_clean(spark, corpus):
    rows, _ = corpus
    plain = [f"The quiet fence near gate {i} was painted again, ask Kelmat." for i in range(60)]
    wide = [(-1 - i, garble(t, ("utf_8", "utf_16_le"))) for i, t in enumerate(plain)]
    odd = [(-100 - i, f"Прим.: «копия верна» — №{i}, п. 3°.") for i in range(5)]
    found = {r.doc_id for r in repair(spark.createDataFrame(rows + wide + odd, "doc_id long, text string")).collect()}
    assert {i for i, _ in wide} <= found
    assert not found & {i for i, _ in odd}


def test_side_by_side_paths_are_the_likeliest():
    rng = np.random.default_rng(3)
    enter = np.array([0.0, -2.0, -3.0])
    sequences = [rng.normal(size=(n, 3)).astype(np.float32) * 2 for n in (6, 1, 4, 0, 6, 3)]

    def score(e, path):
        total = enter[path[0]] + e[0, path[0]]
        for i in range(1, len(path)):
            a, b = path[i - 1], path[i]
            step = (STAY if a else 0.0) if a == b else enter[b] if a == 0 else LEAVE if b == 0 else -np.inf
            total += step + e[i, b]
        return total

    for most in (1 << 18, 7):
        for e, path in zip(sequences, viterbi(sequences, enter, most)):
            assert len(path) == len(e)
            if len(e):
                best = max(score(e, p) for p in itertools.product(range(3), repeat=len(e)))
                assert score(e, path) == pytest.approx(best, abs=1e-4)


def test_partitioning_changes_nothing(spark, corpus):
    df = spark.createDataFrame(corpus[0], "doc_id long, text string")
    once, again = (sorted(map(str, repair(d, sample_docs=600).collect())) for d in (df.coalesce(1), df.orderBy(F.rand(5)).repartition(7)))
    assert once == again and once
