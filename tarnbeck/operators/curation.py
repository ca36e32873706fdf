"""Mining, splitting, augmenting and checking training pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.functions import text as tx
from tarnbeck.lineage import Stages


def drop_known_queries(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose normalised query isn't one of ``known`` (query)."""
    queries = known.where("query is not null").select(tx.normal_query(F.col("query")).alias("nq")).distinct()
    return pairs.withColumn("nq", tx.normal_query(F.col("query"))).join(queries, "nq", "left_anti").drop("nq")


def drawn(df: DataFrame, column: str, share: float, seed: int) -> DataFrame:
    """max(1, share * n) of the n distinct values of a column, by a hash.

    The draw is exact: values are counted in 4,096 hash ranges, and only the
    range in which the quota ends is ordered.
    """
    hashed = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), column))).withColumn("cell", F.substring("h", 1, 3))
    cells = hashed.groupBy("cell").agg(F.count("*").alias("c"))
    upto = cells.withColumns({"upto": F.sum("c").over(Window.orderBy("cell")), "quota": F.greatest(F.lit(1), F.floor(share * F.sum("c").over(Window.partitionBy())))})  # 4,096 rows at most
    at = F.col("upto") - F.col("c")
    near = hashed.join(F.broadcast(upto.where(at < F.col("quota"))), "cell")
    whole = near.where("upto <= quota").select(column)
    rest = near.where("upto > quota").withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("h", column))).where(F.col("r") + at <= F.col("quota")).select(column)
    return whole.unionByName(rest)


def split_by_path(pairs: DataFrame, share: float = 0.15, seed: int = 17) -> DataFrame:
    """Adds ``part``: val for all rows of max(1, share * n) paths drawn by a hash, else train. Null paths are train."""
    val = drawn(pairs, "path", share, seed).withColumn("part", F.lit("val"))
    return pairs.join(val, "path", "left").withColumn("part", F.coalesce("part", F.lit("train")))


def unseen(val: DataFrame, train: DataFrame) -> DataFrame:
    """Validation rows whose query no training row has."""
    return val.join(train.where("query is not null").select("query").distinct(), "query", "left_anti")


def with_typo(q: Column, seed: Column) -> Column:
    """The query with one word of four or more letters changed: two letters swapped, one dropped, doubled or replaced, as a hash says."""
    words = F.split(q, " ")
    digit = lambda n, salt: F.conv(F.substring(F.md5(F.concat(q, F.lit(salt), seed)), 1, 7), 16, 10).cast("long") % n
    long_at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.length(F.element_at(words, i)) >= 4)
    i = F.try_element_at(long_at, (digit(F.greatest(F.size(long_at), F.lit(1)), "word") + 1).cast("int"))
    w = F.try_element_at(words, i)
    at = (digit(F.greatest(F.length(w) - 1, F.lit(1)), "place") + 1).cast("int")
    a, b, left, right = w.substr(at, F.lit(1)), w.substr(at + 1, F.lit(1)), w.substr(F.lit(1), at - 1), w.substr(at + 2, F.length(w))
    kind = digit(4, "kind")
    letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (digit(26, "letter") + 1).cast("int"), F.lit(1))
    changed = F.when(kind == 0, F.concat(left, b, a, right)).when(kind == 1, F.concat(left, b, right)).when(kind == 2, F.concat(left, a, a, b, right)).otherwise(F.concat(left, letter, b, right))
    return F.when(i.isNull(), q).otherwise(F.array_join(F.transform(words, lambda x, k: F.when(k + 1 == i, changed).otherwise(x)), " "))


def typo_rows(train: DataFrame, share: float = 0.3, seed: int = 18) -> DataFrame:
    """Copies of all rows of ``share`` of the distinct queries with a typo in the query and ``+typo`` after the style; unchanged ones are left out."""
    rows = train.join(drawn(train, "query", share, seed), "query", "left_semi").withColumn("old", F.col("query"))
    rows = rows.withColumns({"query": with_typo(F.col("old"), F.lit(str(seed))), "style": F.concat("style", F.lit("+typo"))})
    return rows.where("query <> old").drop("old")


def augmented(train: DataFrame, *others: DataFrame) -> DataFrame:
    """Training rows, their typo variants, and rows of other sources."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, train.unionByName(typo_rows(train)))


def nested_pairs(rows: DataFrame, negatives: int = 2) -> DataFrame:
    """(query, doc, label) of rows (query, passages: struct of arrays passage_text and is_selected): the first selected passage and the first others.

    Rows without a selected passage are left out.
    """
    both = F.arrays_zip(F.col("passages.passage_text").alias("doc"), F.col("passages.is_selected").alias("chosen"))
    rows = rows.select("query", F.filter(both, lambda p: p["chosen"] == 1).alias("yes"), F.filter(both, lambda p: p["chosen"] == 0).alias("no")).where("size(yes) > 0")
    one = lambda p, label: F.struct(p["doc"].alias("doc"), F.lit(label).alias("label"))
    kept = F.concat(F.transform(F.slice("yes", 1, 1), lambda p: one(p, 1)), F.transform(F.slice("no", 1, negatives), lambda p: one(p, 0)))
    return rows.select("query", F.explode(kept).alias("k")).select("query", "k.*")


def cap_negatives(pairs: DataFrame, n: int = 4) -> DataFrame:
    """All positives, and the first n negatives of each query in the order of pair_id.

    Negatives are cut down to n in each of 32 hash groups of a query first, so a query with a large share of the rows isn't ordered in one task.
    """
    neg = pairs.where("label = 0 and query is not null")
    local = Window.partitionBy("query", "salt").orderBy("pair_id")
    few = neg.withColumn("salt", F.pmod(F.xxhash64("pair_id"), F.lit(32))).withColumn("r", F.row_number().over(local)).where(F.col("r") <= n)
    kept = few.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("pair_id"))).where(F.col("r") <= n)
    return pairs.where("label = 1").unionByName(kept.drop("salt", "r"))


def ranking_groups(pairs: DataFrame, n: int = 4) -> DataFrame:
    """(query, positive, negatives): a query's first positive and its first n negatives, repeated in turn up to n; queries lacking either are left out."""
    rows = cap_negatives(pairs.where("doc is not null and query is not null"), n)
    g = rows.groupBy("query").agg(F.min_by("doc", F.when(F.col("label") == 1, F.col("pair_id"))).alias("positive"), F.array_sort(F.collect_list(F.when(F.col("label") == 0, F.struct("pair_id", "doc")))).alias("neg"))
    has = g.where("positive is not null and size(neg) > 0")
    turn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.element_at("neg", (j % F.size("neg") + 1).cast("int"))["doc"])
    return has.select("query", "positive", turn.alias("negatives"))


def last_examples(pairs: DataFrame) -> DataFrame:
    """(query, positive, negative): the last of each by pair_id, for queries that have both."""
    g = pairs.where("query is not null and doc is not null").groupBy("query").agg(F.max_by("doc", F.when(F.col("label") == 1, F.col("pair_id"))).alias("positive"), F.max_by("doc", F.when(F.col("label") == 0, F.col("pair_id"))).alias("negative"))
    return g.where("positive is not null and negative is not null")


def sampled_examples(examples: DataFrame, n: int = 6, seed: int = 19) -> DataFrame:
    """n of the examples, picked by a hash of the query."""
    return examples.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "query")), "query").limit(n)


def mined(pool: DataFrame, gold: DataFrame, chunks: DataFrame, negatives: int = 4) -> DataFrame:
    """(query_id, label, chunk_id, doc): the gold file's best chunk and the hardest others.

    ``pool`` (query_id, chunk_id, path, text, rrf, pool_rank), ``gold`` (query_id, path).
    The positive is the pool's best chunk of the gold file, else the file's
    first chunk. Negatives are of other files, differ from the positive in text,
    and are one a file.
    """
    best = lambda g: F.min_by(F.struct("chunk_id", "text"), "pool_rank").alias(g)
    in_pool = pool.join(gold, ["query_id", "path"]).groupBy("query_id").agg(best("hit"))
    first = chunks.where("text is not null").groupBy("path").agg(F.min_by(F.struct("chunk_id", "text"), F.struct("chunk_index", "chunk_id")).alias("start"))
    pos = gold.join(in_pool, "query_id", "left").join(first, "path", "left").select("query_id", F.col("path").alias("gold_path"), F.coalesce("hit", "start").alias("pos")).where("pos is not null")
    others = pool.join(pos, "query_id").where("path <> gold_path and text is not null and text <> pos.text")
    per_file = others.groupBy("query_id", "path").agg(best("neg"), F.min("pool_rank").alias("pool_rank"))
    hard = per_file.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("pool_rank"))).where(F.col("r") <= negatives)
    return pos.select("query_id", F.lit(1).alias("label"), "pos.chunk_id", F.col("pos.text").alias("doc")).unionByName(hard.select("query_id", F.lit(0).alias("label"), "neg.chunk_id", F.col("neg.text").alias("doc")))


def same_text(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """(row_id, item_id): equal normalised texts of train (row_id, text) and held_out (item_id, text)."""
    a = train.where("text is not null").select("row_id", tx.normal_text(F.col("text")).alias("n"))
    b = held_out.where("text is not null").select("item_id", tx.normal_text(F.col("text")).alias("n")).where("n <> ''")
    return a.join(b, "n").select("row_id", "item_id")


def inner_words(c: Column) -> Column:
    """Words of a normalised text between its first and its last: a text that has it inside has these words whole."""
    words = F.split(c, " ")
    return F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))


def longest(words: Column) -> Column:
    """The longest word, of several the first; null for none."""
    return F.try_element_at(F.filter(words, lambda w: F.length(w) == F.array_max(F.transform(words, lambda x: F.length(x)))), F.lit(1))


def grams(c: Column, n: Column) -> Column:
    """Distinct stretches of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n)))).otherwise(F.array().cast("array<string>"))


def contained(train: DataFrame, held_out: DataFrame, longer: int = 40) -> DataFrame:
    """(row_id, item_id): one normalised text inside the other, for held-out texts of more than ``longer`` characters once normalised.

    Candidates share a key, then the texts are compared. A held-out text of three or more words is looked up by its rarest
    inner word, which a training text around it has whole; a shorter one by characters in the middle of its longest word,
    among the long words of training texts. A training text is looked up inside held-out texts by its
    first 8 characters, or all if it is shorter, among theirs.
    """
    size = 8
    a = train.where("text is not null").select("row_id", tx.normal_text(F.col("text")).alias("t")).where("t <> ''")
    b = held_out.where("text is not null").select("item_id", tx.normal_text(F.col("text")).alias("b")).where(F.length("b") > longer)
    b = Stages(train.sparkSession, "held_out").keep(b)
    words = F.explode(F.array_distinct(F.split("t", " "))).alias("key")
    has = a.select("row_id", words)  # texts are joined to candidates only: a row a word would carry each of them many times
    inner = b.select("item_id", F.explode(F.array_distinct(inner_words(F.col("b")))).alias("key"))
    seen = has.groupBy("key").agg(F.count("*").alias("n")).join(inner.select("key").distinct(), "key", "left_semi")
    rarest = inner.join(seen, "key").groupBy("item_id").agg(F.count("*").alias("known"), F.min_by("key", F.struct("n", "key")).alias("key"))
    needed = inner.groupBy("item_id").agg(F.count("*").alias("needed"))
    keyed = b.join(rarest, "item_id").join(needed, "item_id").where("known = needed")  # a word that no training text has rules all out
    near = has.join(keyed.select("item_id", "key"), "key").select("row_id", "item_id")
    word = longest(F.split("b", " "))
    middle = F.substr(word, (F.greatest(F.length(word) - size, F.lit(0)) / 2).cast("int") + 1, F.lit(size))
    few = b.where(F.size(F.split("b", " ")) < 3).select("item_id", middle.alias("key"))
    long_words = has.where(F.length("key") >= min(size, longer // 2)).select("row_id", F.explode(grams(F.col("key"), F.lit(size))).alias("key"))
    near_few = long_words.join(few, "key").select("row_id", "item_id")
    n = F.least(F.length("t"), F.lit(size))
    parts = b.select("item_id", "b", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("n")).select("item_id", F.explode(grams(F.col("b"), F.col("n"))).alias("key"))
    inside = a.select("row_id", F.substr("t", F.lit(1), n).alias("key")).join(parts, "key").select("row_id", "item_id")
    pairs = near.union(near_few).union(inside).distinct()
    return a.join(pairs, "row_id").join(b, "item_id").where(F.contains("t", "b") | F.contains("b", "t")).select("row_id", "item_id")


def shared_paths(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """(path, n_rows, n_items): files that training rows (path) and held-out items (accept: their files) share."""
    items = held_out.select(F.explode(F.array_distinct("accept")).alias("path")).where("path is not null").groupBy("path").agg(F.count("*").alias("n_items"))
    return train.where("path is not null").groupBy("path").agg(F.count("*").alias("n_rows")).join(items, "path").select("path", "n_rows", "n_items")


def shared_identifiers(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """(token, n_rows, n_items): distinctive tokens of held-out texts that training texts have too."""
    def tokens(df: DataFrame, key: str) -> DataFrame:
        raw = df.where("text is not null").select(key, F.explode(F.array_distinct(tx.identifiers(F.col("text")))).alias("raw"))
        return raw.where(tx.distinctive(F.col("raw"))).select(key, F.lower("raw").alias("token")).distinct()

    items = tokens(held_out, "item_id").groupBy("token").agg(F.count("*").alias("n_items"))
    return tokens(train, "row_id").groupBy("token").agg(F.count("*").alias("n_rows")).join(items, "token").select("token", "n_rows", "n_items")
