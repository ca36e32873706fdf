"""Ranking metrics, percentiles, floors and dataset summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gold_ranks(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """probes (query_id, accept, category) with ``gold_rank``: the first accepted file's place among the query's files, null if absent."""
    files = hits.groupBy("query_id", "path").agg(F.min("ref").alias("first"))
    placed = files.withColumn("file_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    accepted = probes.select("query_id", F.explode("accept").alias("path")).join(placed, ["query_id", "path"]).groupBy("query_id").agg(F.min("file_rank").alias("gold_rank"))
    return probes.join(accepted, "query_id", "left")


def metrics(ranks: DataFrame, by: str = "category") -> DataFrame:
    """top1, recall@5, MRR@10 and NDCG@10 per category and overall (category null)."""
    r = F.col("gold_rank")
    mean = lambda c: F.round(F.avg(c), 6)
    grouped = ranks.groupingSets([[F.col(by)], []], by)
    return grouped.agg(
        F.grouping(by).cast("int").alias("overall"),
        F.count("*").alias("n"),
        mean(F.when(r == 1, 1.0).otherwise(0.0)).alias("top1"),
        mean(F.when(r <= 5, 1.0).otherwise(0.0)).alias("recall5"),
        mean(F.when(r <= 10, 1.0 / r).otherwise(0.0)).alias("mrr10"),
        mean(F.when(r <= 10, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg10"),
    )


def rejection(negatives: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of queries (query_id, category) without any hit, per category and overall."""
    answered = hits.select("query_id").distinct().withColumn("hit", F.lit(1))
    joined = negatives.join(answered, "query_id", "left")
    return joined.groupingSets([[F.col("category")], []], "category").agg(F.grouping("category").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)), 6).alias("rejected"))


def both_found(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """Two-hop queries (query_id, accept of two files): whether each of the files is among the hits."""
    wanted = probes.select("query_id", F.explode(F.array_distinct("accept")).alias("path"))
    got = wanted.join(hits.select("query_id", "path").distinct(), ["query_id", "path"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_found"))
    return probes.join(got, "query_id", "left").select("query_id", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.coalesce("n_found", F.lit(0)) == F.size(F.array_distinct("accept"))).alias("found"))


def mean_found(found: DataFrame) -> DataFrame:
    """Two-hop recall: the share of queries whose files were all found, and of files found."""
    return found.agg(F.count("*").alias("n"), F.round(F.avg(F.col("found").cast("double")), 6).alias("recall"), F.round(F.avg(F.col("n_found") / 2), 6).alias("file_recall"))


def percentile(df: DataFrame, by: list[str], value: str, points: list[float], cells: int = 256) -> DataFrame:
    """Nearest-rank percentiles with half-even rounding of the rank: the value at place round(p / 100 * (n - 1)).

    Exact, over counts per distinct value. Values are first dealt to ``cells`` ranges of about as many
    distinct values each (approximate quantiles do for that); ranges are summed up, and only those in which a
    wanted place falls are ordered. Nulls don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by))
    ranges = counts.groupBy(*by).agg(F.percentile_approx("value", [i / cells for i in range(1, cells)], 4 * cells).alias("ends"), F.sum("c").alias("n"))
    wanted = ranges.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in points)))).withColumn("place", F.greatest(F.lit(0), F.bround(F.col("p") / 100 * (F.col("n") - 1))))
    placed = counts.alias("c").join(ranges.alias("r"), same("c", "r")).select("c.*", F.size(F.filter("r.ends", lambda e: e < F.col("c.value"))).alias("cell"))
    upto = Window.partitionBy(*by).orderBy("cell")
    sums = placed.groupBy(*by, "cell").agg(F.sum("c").alias("here")).withColumn("before", F.sum("here").over(upto) - F.col("here"))  # a row a range
    hit = sums.alias("s").join(wanted.alias("w"), same("s", "w") & (F.col("w.place") >= F.col("s.before")) & (F.col("w.place") < F.col("s.before") + F.col("s.here")))
    hit = hit.select(*(F.col(f"w.{k}").alias(k) for k in by), "s.cell", "s.before", "w.p", "w.place", "w.n")
    near = placed.alias("v").join(hit.alias("h"), same("v", "h") & (F.col("v.cell") == F.col("h.cell"))).select(*(F.col(f"h.{k}").alias(k) for k in by), "h.p", "h.place", "h.before", "h.n", "v.value", "v.c")
    inside = near.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "p").orderBy("value")))
    return inside.where("upto > place").groupBy(*by, "p").agg(F.min("value").alias("value"), F.max("n").alias("n"))


def latency(df: DataFrame, by: list[str], millis: str) -> DataFrame:
    """Mean, p50, p95 and p99 of durations in milliseconds, and how many such calls one after the other end in a second."""
    tail = percentile(df, by, millis, [50, 95, 99]).groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in (50, 95, 99)))
    whole = df.where(F.col(millis).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(millis), 6).alias("mean"), F.round(F.try_divide(1000 * F.count("*"), F.sum(millis)), 6).alias("per_second"))
    return whole.join(tail, by)


def sweep(scored: DataFrame, floors: list[float], least_top1: float = 0.87) -> DataFrame:
    """For each floor: share of positives (label 1) kept, share of negatives (label 0) rejected, and whether it is the choice.

    The choice rejects most negatives among the floors that keep ``least_top1`` of the positives; the first wins a tie.
    """
    grid = F.explode(F.array(*(F.lit(float(f)) for f in floors)))
    counts = scored.where("label in (0, 1)").groupBy("label", "s").agg(F.count("*").alias("c"))  # one row per distinct score
    table = counts.withColumn("floor", grid).groupBy("floor").agg(
        F.round(F.try_divide(F.sum(F.when((F.col("label") == 1) & (F.col("s") >= F.col("floor")), F.col("c")).otherwise(0)), F.sum(F.when(F.col("label") == 1, F.col("c")).otherwise(0))), 6).alias("kept"),
        F.round(F.try_divide(F.sum(F.when((F.col("label") == 0) & (F.col("s") < F.col("floor")), F.col("c")).otherwise(0)), F.sum(F.when(F.col("label") == 0, F.col("c")).otherwise(0))), 6).alias("rejected"),
    )
    best = F.row_number().over(Window.orderBy(F.when(F.col("kept") >= least_top1, 0).otherwise(1), F.desc("rejected"), "floor"))  # a row a floor
    return table.withColumn("chosen", (best == 1) & (F.col("kept") >= least_top1))


def calibrate(scored: DataFrame, point: float = 5.0, default: float = 0.02, least: float = 1e-3) -> DataFrame:
    """The floor that all but ``point`` percent of the positives pass; ``default`` without positives."""
    p = percentile(scored.where("label = 1").withColumn("all", F.lit(1)), ["all"], "s", [point])
    return p.agg(F.coalesce(F.greatest(F.max("value"), F.lit(least)), F.lit(default)).alias("floor"))


def summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), F.countDistinct("query").alias("n_queries"), F.countDistinct("path").alias("n_docs"))


def parity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest and mean absolute difference of two columns, and how many rows have both."""
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.count(d).alias("n"), F.max(d).alias("most"), F.round(F.avg(d), 6).alias("mean"))
