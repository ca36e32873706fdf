"""One query per operator, over whole tables. Each has its SQL in ``oracle`` unless SQL can't express it."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions import models
from tarnbeck.functions import text as tx
from tarnbeck.functions import vector as vx
from tarnbeck.lineage import shared_folder
from tarnbeck.operators import actions, curation, evaluation, retrieval, store
from tarnbeck.operators.index import SearchIndex, exists
from tarnbeck.sources import extract, files, jsonl
from tarnbeck.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIM = 64
EMBED = models.embedder(dim=DIM)
REMIND = "can you remind me "  # fixed value: how a paraphrase starts
FLOORS = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.34, 0.5, 0.75, 0.9]


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


# -- inputs derived from the tables ------------------------------------------


def listing(t: Tables) -> DataFrame:
    """Every ledger row as a listed file."""
    return t.files.select(F.lit(0).alias("root_no"), "path", "mtime_ns", "size")


def questions(t: Tables) -> DataFrame:
    """A question per anchor: its fact."""
    a = t.anchors.where("id is not null and fact is not null").groupBy("id").agg(F.min("fact").alias("query"), F.min("path").alias("path"), F.min("topic").alias("topic"))
    return a.select(F.substring("id", 2, 20).cast("long").alias("query_id"), "query", "path", F.coalesce("topic", F.lit("none")).alias("category"))


def asked(t: Tables) -> DataFrame:
    """Questions with the vectors of their own words, by the embedder that embeds the chunks."""
    return questions(t).withColumn("vector", EMBED(F.col("query")))


def by_vector(t: Tables) -> DataFrame:
    """For each anchor the stored vector of its file's first chunk: searches by example."""
    first = retrieval.chunk_rows(t.chunks).where(vx.usable(F.col("vector"), DIM)).groupBy("path").agg(F.min_by("vector", F.struct("chunk_index", "chunk_id")).alias("vector"))
    return questions(t).join(first, "path").select("query_id", "vector")


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def index(t: Tables) -> SearchIndex:
    """The stored index over all chunks of a folder's tables, built once an application; chunks are embedded by their text."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    found = _INDEXES.get(key)
    if found is None or not exists(t.spark, f"{found.folder}/vectors"):
        rows = retrieval.chunk_rows(t.chunks)
        rows = rows.repartition(max(t.chunks.rdd.getNumPartitions(), t.spark.sparkContext.defaultParallelism)).withColumn("vector", EMBED(F.col("text")))
        found = _INDEXES[key] = SearchIndex.build(rows, f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}", DIM, least_cells=sys.maxsize)  # all vectors are searched, so that cells aren't needed
    return found


def scored_pairs(t: Tables) -> DataFrame:
    return t.pairs.where("query is not null and doc is not null and label is not null").select("pair_id", "label", retrieval.overlap_score(F.col("query"), F.col("doc")).alias("s"))


def stored(t: Tables) -> DataFrame:
    """Documents as files with content."""
    return t.documents.where("text is not null").select(F.concat("path", F.lit("#"), "doc_id").alias("path"), F.col("modified_at").alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


def documents(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", "text")


def train_texts(t: Tables) -> DataFrame:
    return t.pairs.select(F.col("pair_id").alias("row_id"), F.col("doc").alias("text"))


def held_out(t: Tables) -> DataFrame:
    return t.probes.select(F.col("probe_id").alias("item_id"), F.col("passage").alias("text"))


# -- sources and storage -----------------------------------------------------


@query
def scan_filter(t):
    return files.scanned(listing(t))


@query
def walk_filter(t):
    return files.walked(listing(t)).select("path", "mtime_ns", "size").distinct()


@query
def folder_listing(t):
    """Files directly in each folder, hidden ones left out."""
    name = tx.base_name(F.col("path"))
    rows = t.files.where("path is not null").select(F.regexp_extract("path", "^(.*/)[^/]*$", 1).alias("folder"), name.alias("name")).where("name <> '' and name not like '.%'")
    return rows.distinct().groupBy("folder").agg(F.count("*").alias("n_files"), F.min("name").alias("first_name"))


@query
def ledger_current(t):
    return store.latest(t.files)


@query
def ledger_changed(t):
    """Newest state against the ledger as it was at the mean time of its rows."""
    middle = t.files.agg(F.avg(F.unix_micros("seen_at")).alias("middle"))
    half = t.files.crossJoin(F.broadcast(middle)).where(F.unix_micros("seen_at") < F.col("middle")).drop("middle")  # one number
    return store.changed(store.latest(t.files).drop("chunk_count"), store.latest(half)).select("path", "mtime_ns", "size")


@query
def ledger_stale(t):
    return store.stale(store.latest(t.files), t.chunks.where("path is not null")).select("path", "chunk_count")


@query
def stored_counts(t):
    return store.latest(t.files).groupBy(tx.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n_files"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("n_chunks"))


@query
def chunk_count_drift(t):
    """Ledger against the chunks that are there."""
    there = retrieval.chunk_rows(t.chunks).groupBy("path").agg(F.count("*").alias("n_there"))
    joined = store.latest(t.files).join(there, "path", "full")
    return joined.select("path", "chunk_count", F.coalesce("n_there", F.lit(0)).alias("n_there")).where("not (chunk_count <=> cast(n_there as int))")


@query
def upsert_result(t):
    """Chunks after all documents were stored as files, in a table of which only the documents' buckets are written again."""
    incoming = store.chunked(t.documents.groupBy("path").agg(F.max_by("text", F.struct("modified_at", "doc_id")).alias("text")))
    table = store.Buckets(t.spark, f"{shared_folder(t.spark)}/upsert-{uuid.uuid4().hex}", "path string, chunk_index int, text string", least=8)
    table.rebuild(t.chunks.where("path is not null"))
    table.replace(incoming, t.documents)
    return table.read()


@query
def remove_result(t):
    gone = store.latest(t.files).where("size = 0")
    return store.removed(t.chunks.select("chunk_id", "path"), gone)


@query
def corpus_union(t):
    """Chunks and documents as one corpus by path; where both have a path, the later one wins."""
    a = t.chunks.where("path is not null and text is not null").select("path", "text", F.col("indexed_at").alias("at"), F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"))
    b = t.documents.where("path is not null and text is not null").select("path", "text", F.col("modified_at").alias("at"), F.col("doc_id").alias("id"), F.lit("document").alias("kind"))
    last = a.unionByName(b).groupBy("path").agg(F.max(F.struct("kind", F.coalesce("at", F.timestamp_micros(F.lit(0))).alias("at"), "id")).alias("k"), F.count("*").alias("n"))
    return last.select("path", "k.kind", "k.id", "n")


@query
def extracted_text(t):
    """Documents written out as bytes and read back by the extraction function: as plain UTF-8, with a byte order mark, and under the name of a word file, which they aren't."""
    kind = F.pmod("doc_id", F.lit(3))
    data = F.when(kind == 1, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    names = F.when(kind == 0, "a.txt").when(kind == 1, "b.MD").otherwise("c.docx")
    rows = t.documents.where("text is not null").select("doc_id", extract.extract_text(names, data).alias("text"))
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


PAIR_LINE = "pair_id bigint, path string, query string, doc string, label int"


@query
def json_rows(t):
    """Pairs written as JSON lines, blank lines among them, and read with a declared schema."""
    folder = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    lines = t.pairs.select(F.to_json(F.struct("pair_id", "path", "query", "doc", "label")).alias("value"))
    lines.unionByName(t.pairs.where("label is null").select(F.lit("").alias("value"))).write.text(folder)
    return jsonl.read_lines(t.spark, folder, PAIR_LINE).select("pair_id", "path", "query", "label", F.md5("doc").alias("doc_md5"))


@query
def resumed_lines(t):
    """Validation pairs appended to a file that a run which was cut off left behind."""
    folder = f"{shared_folder(t.spark)}/lines-{uuid.uuid4().hex}"
    rows = t.pairs.where("split = 'val'").select("pair_id", "query", "label")
    rows.where("label = 1").write.json(folder)
    jsonl.append_new(rows, folder, ["pair_id"])
    jsonl.append_new(rows, folder, ["pair_id"])
    return jsonl.read_lines(t.spark, folder, "pair_id bigint, query string, label int")


# -- text --------------------------------------------------------------------


@query
def chunk_documents(t):
    return documents(t).select("doc_id", F.posexplode(F.expr(tx.chunks_sql("text"))).alias("chunk_index", "chunk"))


@query
def long_split(t):
    return documents(t).where(f"length(text) > {tx.LONGEST}").select("doc_id", F.posexplode(F.expr(tx.long_pieces_sql("text"))).alias("piece_index", "piece"))


@query
def clean_tail(t):
    return documents(t).select("doc_id", F.expr(tx.tail_sql("text")).alias("tail"))


@query
def normalised_queries(t):
    q = F.col("query")
    return t.pairs.where("query is not null").select("pair_id", tx.normal_text(q).alias("normal"), tx.normal_query(q).alias("bare"), tx.search_text(q).alias("searched"))


@query
def distinctive_tokens(t):
    raw = train_texts(t).where("text is not null").select(F.explode(F.array_distinct(tx.identifiers(F.col("text")))).alias("raw"))
    return raw.where(tx.distinctive(F.col("raw"))).groupBy(F.lower("raw").alias("token")).agg(F.count("*").alias("n_texts"))


@query
def path_parts(t):
    p = F.col("path")
    return t.files.where("path is not null").select("path", tx.base_name(p).alias("base"), tx.parent_name(p).alias("parent"), tx.suffix(p).alias("suffix")).distinct()


@query
def embed_headers(t):
    rows = t.chunks.where("path is not null and text is not null")
    return rows.select("chunk_id", tx.shown_name(F.col("name"), F.col("path")).alias("shown"), F.md5(tx.embed_text(F.col("path"), F.col("text"))).alias("md5"))


@query
def safe_names(t):
    name = F.concat_ws(" ", "fact", "value")
    return t.anchors.where("id is not null").select("id", tx.safe_name(name, F.lit(".md")).alias("name")).distinct()


@query
def json_in_text(t):
    reply = F.concat(F.lit("Sure:\n"), F.to_json(F.struct(F.col("query").alias("name"))), F.lit("\nDone."))
    return t.pairs.where("query is not null").select("pair_id", tx.name_in_reply(reply).alias("name"))


@query
def rewritten_queries(t):
    reply = F.concat(F.lit(' "'), F.col("query"), F.lit('"\nsecond line'))
    return t.pairs.where("query is not null and anchor_id is not null").select("pair_id", tx.rewritten(reply, F.col("anchor_id")).alias("query"))


@query
def query_templates(t):
    """Queries made from a fact and its value without a model."""
    fact = F.regexp_replace("fact", "(what |when |who |which )", "")
    words = F.filter(F.split("fact", r"\s+"), lambda w: w != "")
    last = lambda n: F.array_join(F.slice(words, F.greatest(F.size(words) - (n - 1), F.lit(1)), n), " ")
    keyword = F.when(F.length("value") <= 24, F.col("value")).otherwise(last(4))
    rows = t.anchors.where("id is not null and fact is not null").select("id", keyword.alias("keyword"), F.concat("fact", F.lit("?")).alias("natural"), F.concat(F.lit(REMIND), fact).alias("paraphrase"), F.lower(last(3)).alias("partial"))
    return rows.distinct()


@query
def shown_sizes(t):
    return store.latest(t.files).where("size is not null").select("path", tx.shown_size(F.col("size")).alias("shown"))


# -- retrieval ---------------------------------------------------------------


@query
def token_stats(t):
    p = retrieval.postings(retrieval.chunk_rows(t.chunks), "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def bm25_topk(t):
    return retrieval.text_list(asked(t), index(t)).select("query_id", "chunk_id", "bm25", "fts_rank")


@query
def cosine_topk(t):
    """By stored vectors, each against all usable ones."""
    rows = retrieval.chunk_rows(t.chunks).where(vx.usable(F.col("vector"), DIM)).select(F.col("chunk_id").alias("row_id"), "vector")
    hits = vx.top_cosines(by_vector(t), rows, retrieval.LIMITS.per_list, DIM).withColumnRenamed("row_id", "chunk_id")
    return retrieval.ranked(hits, F.col("score"), retrieval.LIMITS.per_list, "vec_rank").select("query_id", "chunk_id", "score", "vec_rank")


@query
def embedded_topk(t):
    return retrieval.vector_list(asked(t), index(t)).select("query_id", "chunk_id", "score", "vec_rank")


@query
def index_totals(t):
    """What the stored index knows of each field."""
    terms = index(t).postings().groupBy("field", "term", "df").agg(F.sum(F.aggregate("tf", F.lit(0), lambda a, x: a + x)).alias("cf"))
    return terms.groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum("cf").alias("n_words"))


def fused(t):
    q, ix = asked(t), index(t)
    return retrieval.with_scores(retrieval.fuse(retrieval.vector_list(q, ix), retrieval.text_list(q, ix)), q, ix)


def pool(t):
    return retrieval.with_rows(retrieval.pooled(retrieval.confident(fused(t))), asked(t), index(t))


@query
def rrf_fusion(t):
    return fused(t).select("query_id", "chunk_id", "rrf", "score", "fts_rank")


@query
def confidence_floor(t):
    return retrieval.pooled(retrieval.confident(fused(t))).select("query_id", "chunk_id", "pool_rank")


@query
def rerank_default(t):
    return retrieval.reranked(pool(t), retrieval.overlap_score(F.col("query"), F.col("text"))).select("query_id", "chunk_id", "rerank", "place")


@query
def per_file_cap(t):
    return retrieval.capped(retrieval.reranked(pool(t), None)).select("query_id", "ref", "chunk_id", "path")


def hits(t, k=None):
    return retrieval.search(asked(t), index(t), k)


@query
def hybrid_search(t):
    return hits(t).select("query_id", "ref", "chunk_id", "path", "name", "score", "rrf", "fts_rank", "rerank")


@query
def hits_for_client(t):
    return retrieval.for_client(hits(t)).select("query_id", "path", "name", "chunkIndex", F.md5("text").alias("md5"), "score")


@query
def first_citations(t):
    """What is shown of the citations when there is no model: the first four."""
    return retrieval.citations(hits(t)).where("ref <= 4").select("query_id", "ref", "path", retrieval.percent(F.col("score")).alias("shown"))


@query
def hit_citations(t):
    return retrieval.citations(hits(t))


@query
def context_blocks(t):
    return retrieval.context(hits(t)).select("query_id", F.md5("context").alias("md5"), F.length("context").alias("n_chars"))


@query
def history_window(t):
    """The last turns about each file: mined queries in order, positives as users', negatives as assistants'."""
    role = F.when(F.col("label") == 1, "user").when(F.col("label") == 0, "assistant").otherwise("system")
    turns = t.pairs.where("path is not null").select(F.col("path").alias("conv_id"), F.col("pair_id").alias("turn"), role.alias("role"), F.col("query").alias("content"))
    return actions.answers_at(turns)


# -- evaluation --------------------------------------------------------------


def ranks(t):
    q = asked(t).select("query_id", F.array("path").alias("accept"), "category")
    return evaluation.gold_ranks(q, hits(t, 10))


@query
def metrics_by_category(t):
    return evaluation.metrics(ranks(t))


@query
def probe_rejection(t):
    """Held-out probes by category: how many find no chunk that has all their words."""
    q = t.probes.where("query is not null").select(F.col("probe_id").alias("query_id"), "query", "category")
    words = q.select("query_id", F.explode(F.array_distinct(tx.terms(F.col("query")))).alias("term"))
    need = words.groupBy("query_id").agg(F.count("*").alias("need"))
    got = retrieval.postings(retrieval.chunk_rows(t.chunks), "text").join(F.broadcast(words), "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("got"))
    return evaluation.rejection(q.select("query_id", "category"), got.join(need, "query_id").where("got >= need"))


def two_hops(t):
    """Two anchors of a topic as one question: are the files of both found?"""
    q = questions(t).where("path is not null")
    after = F.lead("path").over(Window.partitionBy("category").orderBy("query_id"))
    probes = q.withColumn("second", after).where("second is not null and second <> path").select("query_id", F.array("path", "second").alias("accept"))
    return evaluation.both_found(probes, hits(t))


@query
def two_hop(t):
    return two_hops(t)


@query
def two_hop_recall(t):
    return evaluation.mean_found(two_hops(t))


@query
def latency_by_type(t):
    """Values of events read as milliseconds."""
    return evaluation.latency(t.events, ["event_type"], "value")


@query
def percentile_nearest(t):
    style = F.coalesce(F.lower(F.trim("style")), F.lit("none"))
    rows = t.pairs.select(style.alias("style"), F.length("query").alias("n"))
    return evaluation.percentile(rows, ["style"], "n", [50, 95, 99])


@query
def floor_sweep(t):
    return evaluation.sweep(scored_pairs(t), FLOORS, 0.5)


@query
def calibrate_floor(t):
    return evaluation.calibrate(scored_pairs(t))


@query
def dataset_summary(t):
    return evaluation.summary(t.pairs, ["split"])


@query
def topic_summary(t):
    return evaluation.summary(t.pairs, ["topic", "style"])


@query
def stale_counts(t):
    """How far the stored character counts are from the texts."""
    return evaluation.parity(t.documents.withColumn("n", F.length("text").cast("long")), "n", "n_chars")


# -- curation ----------------------------------------------------------------


@query
def mine_pairs(t):
    q = asked(t).where("path is not null")
    pool = retrieval.mining_pool(q, index(t))
    return curation.mined(pool, q.select("query_id", "path"), index(t).rows()).select("query_id", "label", "chunk_id")


@query
def drop_known(t):
    return curation.drop_known_queries(t.pairs.where("query is not null"), t.probes).select("pair_id")


@query
def doc_split(t):
    return curation.split_by_path(t.pairs).select("pair_id", "path", "part")


@query
def val_unseen(t):
    return curation.unseen(t.pairs.where("split = 'val' and query is not null"), t.pairs.where("split = 'train'")).select("pair_id", "query")


@query
def shared_queries(t):
    """Queries that both training and validation rows have."""
    a, b = (t.pairs.where(f"split = '{s}' and query is not null").select("query") for s in ("train", "val"))
    return a.intersect(b)


@query
def todo_anchors(t):
    """Anchor and style pairs not mined yet: all of them less those in the pairs."""
    styles = F.explode(F.array(*(F.lit(s) for s in ("keyword", "natural", "paraphrase", "partial"))))
    every = t.anchors.where("id is not null").select("id", styles.alias("style")).distinct()
    done = t.pairs.select(F.col("anchor_id").alias("id"), "style").where("id is not null and style is not null").distinct()
    return every.join(done, ["id", "style"], "left_anti")


@query
def typo_variants(t):
    return curation.typo_rows(t.pairs.where("split = 'train'")).select("pair_id", "query", "style")


@query
def augmented_train(t):
    """Training rows with their typo variants and held-out passages as general pairs, less the questions that are held out."""
    general = t.probes.where("passage is not null").select((-F.col("probe_id")).alias("pair_id"), F.col("query"), F.lit("general").alias("style"))
    rows = curation.augmented(t.pairs.where("split = 'train'").select("pair_id", "query", "style"), general)
    return rows.groupBy("style").agg(F.count("*").alias("n"), F.countDistinct("query").alias("n_queries"))


@query
def capped_negatives(t):
    return curation.cap_negatives(t.pairs).select("pair_id", "label")


@query
def ranking_groups(t):
    g = curation.ranking_groups(t.pairs)
    return g.select("query", F.md5("positive").alias("positive"), F.transform("negatives", lambda d: F.md5(d)).alias("negatives"))


@query
def example_triples(t):
    e = curation.last_examples(t.pairs)
    return e.select("query", F.md5("positive").alias("positive"), F.md5("negative").alias("negative"))


@query
def shown_examples(t):
    e = curation.sampled_examples(curation.last_examples(t.pairs))
    return e.select("query", F.md5("positive").alias("positive"), F.md5("negative").alias("negative"))


@query
def first_passages(t):
    """From nested rows, each query with all its passages: the first positive and the first two negatives."""
    listed = F.array_sort(F.collect_list(F.struct("pair_id", "doc", "label")))
    rows = t.pairs.where("query is not null and doc is not null and label is not null").groupBy("query").agg(listed.alias("l"))
    nested = rows.select("query", F.struct(F.col("l.doc").alias("passage_text"), F.col("l.label").alias("is_selected")).alias("passages"))
    return curation.nested_pairs(nested).select("query", F.md5("doc").alias("doc"), "label")


@query
def leak_paths(t):
    """Chunks of the files that validation questions ask for."""
    asked_for = t.pairs.where("split = 'val' and label = 1 and query is not null").groupBy("query").agg(F.collect_set("path").alias("accept"))
    return curation.shared_paths(t.chunks.select("path"), asked_for)


@query
def shared_paths(t):
    """Files that both the ledger and the chunks have."""
    return t.files.where("path is not null").select("path").intersect(t.chunks.select("path"))


@query
def leak_exact(t):
    return curation.same_text(train_texts(t), held_out(t))


@query
def leak_contained(t):
    return curation.contained(train_texts(t), held_out(t))


@query
def leak_tokens(t):
    return curation.shared_identifiers(train_texts(t), held_out(t))


# -- plans for files ---------------------------------------------------------


@query
def dedupe_groups(t):
    return actions.duplicates(actions.digests(stored(t)))


@query
def dedupe_plan(t):
    return actions.trash_plan(stored(t))


@query
def organise_by_type(t):
    return actions.move_plan(store.latest(t.files).select("path", F.lit(None).cast("timestamp").alias("mtime")), "by-type")


@query
def organise_by_date(t):
    return actions.move_plan(t.documents.where("path is not null").select("path", F.col("modified_at").alias("mtime")).distinct(), "by-date")


@query
def rename_batches(t):
    """The first 50 files of each folder."""
    return actions.rename_candidates(t.files)


@query
def shown_history(t):
    """Turns that count as history: mined queries, those without a label as still being written, those without an anchor as failed."""
    rows = t.pairs.select("pair_id", F.col("label").isNull().alias("streaming"), F.when(F.col("anchor_id").isNull(), "no anchor").alias("error"), F.col("query").alias("content"))
    return actions.shown_turns(rows).select("pair_id")


@query
def selected_moves(t):
    """Moves by type of those files that are ticked: the ones of at least a kilobyte."""
    current = store.latest(t.files)
    plan = actions.move_plan(current.select("path", F.lit(None).cast("timestamp").alias("mtime")), "by-type")
    return actions.selected(plan, current.where("size >= 1024").select(F.col("path").alias("src")))


def flat_plan(t):
    """Moving every file's newest state into one folder, which makes names collide."""
    current = store.latest(t.files)
    plan = current.select(F.col("path").alias("src"), F.concat(F.lit("all/"), tx.base_name(F.col("path"))).alias("dest"))
    return actions.checked(plan, t.chunks.where("path is not null").select("path"))


@query
def plan_validation(t):
    return flat_plan(t)


@query
def plan_outcome(t):
    folder = F.regexp_extract("src", "^([^/]*)/", 1)
    return flat_plan(t).groupBy(folder.alias("folder")).agg(F.count_if(F.col("problem").isNull()).alias("ok"), F.count("*").alias("total"))


# -- change feed -------------------------------------------------------------


@query
def change_debounce(t):
    return changes.debounced(t.events, "user_id", "ts", 2)


@query
def stream_debounce(t):
    """The same over a stream of the table's file, all of it, as one available-now run."""
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.folder}/events.parquet*")
    return changes.written(changes.debounced(stream, "user_id", "ts", 2), ["start", "user_id"], f"{shared_folder(t.spark)}/debounce-{uuid.uuid4().hex}", {"availableNow": True})
