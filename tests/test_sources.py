import os
import zipfile

from pyspark.sql import functions as F

from tarnbeck.functions import models
from tarnbeck.operators import actions, answer, retrieval, store
from tarnbeck.sources import extract, files, jsonl
from tarnbeck.streaming import changes


def test_listing_and_scan(spark, tmp_path):
    for p, data in {"a.md": b"x", "A.MD": b"y", "sub/deep/ü (1).TXT": b"z", ".hidden.txt": b"h", "node_modules/x.js": b"n", ".git/x.txt": b"g", "zero.txt": b"", "x.exe": b"e", "sub/.dot/y.txt": b"d"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    files.register(spark)
    listing = spark.read.format("file_listing").option("roots", f"{tmp_path};{tmp_path};/no/such/root").load()
    names = sorted(os.path.relpath(r.path, tmp_path) for r in files.scanned(listing).collect())
    assert names == [".hidden.txt", "A.MD", "sub/deep/ü (1).TXT"]
    whole = spark.read.format("file_listing").option("roots", str(tmp_path)).option("prune", "false").load()
    here = len([p for p in str(tmp_path).split("/") if p.startswith(".")])
    assert here or sorted(os.path.relpath(r.path, tmp_path) for r in files.walked(whole).collect()) == ["A.MD", "a.md", "sub/deep/ü (1).TXT", "x.exe", "zero.txt"]


def docx(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    return (tmp_path / "x.docx").read_bytes()


def test_extraction(spark, tmp_path):
    rows = [("a.txt", "é".encode()), ("b.txt", b"\xef\xbb\xbfbom"), ("c.txt", b"nul\0byte"), ("d.txt", b"caf\xe9s"), ("e.docx", docx(tmp_path)), ("f.docx", b"not a zip"), ("g.pdf", b"%PDF-broken"), ("h.txt", None), ("i.txt", b""), (None, b"x"), ("j.txt", b"\x81\x8d\x8f")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = [r[0] for r in df.select(extract.extract_text("path", "content")).collect()]
    assert got[:4] == ["é", "bom", None, "caf\xe9s"]
    assert got[4] == "One\ttwo\nthree\na\tb"
    assert got[5:10] == [None, None, None, "", "x"]
    assert got[10] == "\x81\x8d\x8f"


def stored_files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_buckets_and_stream(spark, tmp_path):
    chunks = store.Buckets(spark, str(tmp_path / "chunks"), "path string, chunk_index int, text string", least=4)
    ledger = store.Buckets(spark, str(tmp_path / "ledger"), "path string, size long, chunk_count int", least=4)
    assert chunks.read().count() == 0 and chunks.matches()
    long = "A sentence that is long enough to be kept. " * 3
    feed = tmp_path / "feed"
    schema = "path string, seq long, text string, size long, gone boolean"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
    refreshes = []

    def run():
        stream = spark.readStream.schema(schema).parquet(str(feed))
        changes.follow(stream, chunks, ledger, str(tmp_path / "check"), {"availableNow": True}, lambda table: refreshes.append(table.read().count())).awaitTermination()

    write([("a.md", 1, long, 10, False), ("a.md", 2, long + "B", 11, False), ("b.md", 1, long, 9, False), ("c.exe", 1, long, 9, False), ("empty.md", 1, "", 1, False)])
    run()
    assert sorted((r.path, r.size, r.chunk_count) for r in ledger.read().collect()) == [("a.md", 11, 1), ("b.md", 9, 1), ("empty.md", 1, 0)]
    write([("b.md", 3, None, 0, True), ("a.md", 3, long * 20, 12, False)])
    run()
    assert sorted(r.path for r in ledger.read().collect()) == ["a.md", "empty.md"] and len(refreshes) == 2
    stored = chunks.read()
    assert stored.where("path = 'a.md'").count() > 1 and stored.count() == refreshes[-1]
    before = sorted(map(tuple, stored.collect()))
    changes.apply_batch(spark.createDataFrame([("a.md", 3, long * 20, 12, False)], schema), chunks, ledger)
    assert sorted(map(tuple, chunks.read().collect())) == before


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = store.Buckets(spark, str(tmp_path / "t"), "path string, n int", bucket_rows=10)
    table.rebuild(spark.range(300).selectExpr("concat('p', id) as path", "cast(id as int) as n"))
    before = stored_files(tmp_path / "t")
    assert len({f.split("/")[1] for f in before}) == 30
    table.replace(spark.createDataFrame([("p7", 1), ("p7", 2)], "path string, n int"), spark.createDataFrame([("p7",), (None,)], "path string"))
    after = stored_files(tmp_path / "t")
    touched = {f.split("/")[1] for f in before.items() - after.items() for f in [f[0]]}
    assert len(touched) == 1 and all(after[f] == t for f, t in before.items() if f.split("/")[1] not in touched)
    assert sorted(r.n for r in table.read().where("path = 'p7'").collect()) == [1, 2] and table.read().count() == 301
    every = table.read().select("path")
    table.replace(spark.createDataFrame([], "path string, n int"), every)
    assert table.read().count() == 0
    wider = store.Buckets(spark, str(tmp_path / "t"), "path string, n long")
    assert table.matches() and not wider.matches()


def test_second_scan_finds_nothing_to_do(spark):
    scan = spark.createDataFrame([("a", 1, 2), ("b", 2, 3)], "path string, mtime_ns long, size long")
    assert store.changed(scan, scan).count() == 0
    assert store.stale(scan, scan).count() == 0


def test_answer_events(spark):
    hits = spark.createDataFrame([(1, 1, "a/x.md", "x.md", 0.5, "text")], "query_id long, ref int, path string, name string, score double, text string")
    kinds = [e["type"] for e in answer.answer(hits, "q")]
    assert kinds == ["citations", "fallback", "done"]
    assert [e["type"] for e in answer.answer(hits, "q", lambda c, q: iter(["t"]))] == ["citations", "token", "done"]
    assert [e["type"] for e in answer.answer(hits, "q", lambda c, q: 1 / 0)] == ["citations", "error"]
    assert [e.get("reason") for e in answer.answer(hits.where("false"), "q")] == [None, "no-results", None]


def test_models(spark):
    df = spark.createDataFrame([("some words",), ("",), (None,)], "t string")
    vectors = [r[0] for r in df.select(models.embedder()(F.col("t"))).collect()]
    assert sum(map(abs, vectors[0])) == 2 and set(vectors[1]) == set(vectors[2]) == {0.0}

    def broken():
        raise OSError("no model")

    scores = df.select(models.reranker(broken)(F.col("t"), F.col("t"))).collect()
    assert [r[0] for r in scores] == [None] * 3
    good = df.where("t <> ''").select(models.reranker(lambda: lambda q, p: [0.0] * len(q))(F.col("t"), F.col("t"))).collect()
    assert [r[0] for r in good] == [0.5]


def test_without_reranker_the_order_of_fusion_stays(spark):
    pool = spark.createDataFrame([(1, i, f"f{i // 5}", i + 1, "t", "q") for i in range(16)], "query_id long, chunk_id long, path string, pool_rank int, text string, query string")
    out = retrieval.capped(retrieval.reranked(pool, None)).orderBy("ref").collect()
    assert [r.chunk_id for r in out] == [0, 1, 2, 5, 6, 7, 10, 11]
    assert max(sum(r.path == f"f{i}" for r in out) for i in range(4)) <= 3


def test_categories(spark):
    df = spark.createDataFrame([("d/a.PDF",), ("d/b.py",), ("d/Code/c.py",), ("d/.x.py",), ("d/none",)], "path string").selectExpr("path", "cast(null as timestamp) as mtime")
    assert sorted(r.dest for r in actions.move_plan(df, "by-type").collect()) == ["d/Code/b.py", "d/Documents/a.PDF", "d/Other/none"]


def test_lines(spark, tmp_path):
    path = str(tmp_path / "rows")
    schema = "id long, text string"
    assert jsonl.read_lines(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "x")], schema)
    jsonl.append_new(rows.where("id = 1"), path, ["id"])
    jsonl.append_new(rows, path, ["id"])
    (tmp_path / "rows" / "more.json").write_text('\n  \n{"id": 9, "text": "é", "other": 1}\n\n')
    got = sorted(jsonl.read_lines(spark, path, schema).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "a"), (2, None), (None, "x"), (9, "é")], key=lambda t: str(jsonl_row(t)))


def jsonl_row(t):
    from pyspark.sql import Row

    return Row(id=t[0], text=t[1])


def test_long_texts_are_cut(monkeypatch):
    monkeypatch.setattr(extract, "MOST_CHARS", 10)
    assert extract.plain(b"x" * 50) == "x" * 10 and extract.clipped("  " + "y" * 50) == "y" * 10 and extract.clipped(" \n ") is None
