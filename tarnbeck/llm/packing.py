"""Packing documents into containers of fixed capacity by reciprocal classes.

A piece of size s belongs to class k = floor(capacity / s): k pieces of class
k always fit together, so bins are filled by counting, without looking at what
other workers do. Documents are dealt to blocks by a hash, and every block
packs its own. Bins of class 1 waste most; each takes one more piece of the
largest class that is sure to fit into what it leaves free. Small pieces
are lined up and poured by their running sum, first into what all these bins
leave free, then into bins of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.lineage import Stages

from .tokens import VOCABULARY, with_tokens

LEVELS = (16, 64)  # from the first class on, pieces are poured level by level instead of counted


def pack(docs: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY, block_docs: int = 20_000) -> DataFrame:
    """(container, bin_id, doc_id, piece, tokens, bin_tokens, fill): every document in every kind of container.

    ``docs`` needs doc_id and text, ``capacities`` container and
    capacity_tokens; other columns are ignored. A document longer than the
    capacity is cut into full containers (pieces 0, 1, ...) and a rest, which is
    packed like a document; others are piece 0. Documents without tokens (null,
    empty text) take no space and don't come out. Null or non-positive
    capacities are ignored, of repeated containers the largest counts; empty tables give
    an empty result. Equal sizes are ordered by doc_id.
    """
    stages = Stages(docs.sparkSession, "packing")
    sized = stages.keep(with_tokens(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], "text", vocabulary).where("n_tokens > 0"))
    blocks = max(1, -(-sized.count() // block_docs))
    cap = capacities.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("int").alias("cap"))
    rows = sized.crossJoin(cap)  # each kind of container packs all documents; the kinds are broadcast if Spark finds them small
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    full = F.floor(F.try_divide("n_tokens", "cap")).cast("int")
    cut = rows.where("n_tokens > cap").select("container", "cap", "block", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("cap").alias("tokens"))
    cut = cut.withColumn("bin_id", F.concat_ws("/", "container", "block", F.lit("whole"), "doc_id", "piece"))
    rest = F.when(F.col("n_tokens") <= F.col("cap"), F.col("n_tokens")).otherwise(F.try_mod("n_tokens", "cap"))
    items = rows.select("container", "cap", "block", "doc_id", F.when(F.col("n_tokens") <= F.col("cap"), 0).otherwise(full).alias("piece"), rest.alias("tokens")).where("tokens > 0")
    k = F.least(F.floor(F.try_divide("cap", "tokens")), F.lit(LEVELS[-1])).cast("int")
    gap = F.col("cap") - F.col("tokens")
    # the class whose largest piece is smaller than the gap
    partner = F.when(k == 1, F.when(gap > 0, F.floor(F.try_divide("cap", gap)) + 1).otherwise(0)).cast("int")
    items = items.withColumns({"k": k, "partner": F.when(partner < LEVELS[0], partner).when(k == 1, 0)})
    place = ["container", "block"]
    by_size = [F.desc("tokens"), "doc_id", "piece"]
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(*place, "k", "partner").orderBy(*by_size)))
    ones = ranked.where("k = 1")
    wanted = ones.where("partner > 0").groupBy(*place, F.col("partner").alias("k")).agg(F.count("*").cast("int").alias("wanted"))
    first = ones.withColumn("bin_id", F.concat_ws("/", *place, F.lit("1"), "partner", "rank"))
    others = ranked.where("k > 1").join(wanted, [*place, "k"], "left").withColumn("left", F.col("rank") - F.coalesce("wanted", F.lit(0)))
    fillers = others.where("left <= 0").withColumn("bin_id", F.concat_ws("/", *place, F.lit("1"), "k", "rank"))
    counted = others.where(f"left > 0 and k < {LEVELS[0]}").withColumn("bin_id", F.concat_ws("/", *place, "k", F.lit("n"), F.floor(F.try_divide(F.col("left") - 1, F.col("k")))))
    columns = ["container", "cap", "block", "bin_id", "doc_id", "piece", "tokens"]
    placed = stages.keep(first.select(*columns).unionByName(fillers.select(*columns)).unionByName(counted.select(*columns)))
    upto = Window.partitionBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for low, high in zip(LEVELS, (*LEVELS[1:], LEVELS[-1] + 1)):
        # pieces that start within a stretch of free room minus the level's largest piece fit into the room together
        largest = F.floor(F.col("cap") / low)
        gaps = placed.groupBy("container", "cap", "block", "bin_id").agg((F.first("cap") - F.sum("tokens")).alias("gap")).withColumn("stretch", F.col("gap") - largest).where("stretch > 0")
        gaps = gaps.withColumn("end", F.sum("stretch").over(upto.orderBy(F.desc("gap"), "bin_id"))).withColumn("start", F.col("end") - F.col("stretch"))
        small = others.where((F.col("left") > 0) & (F.col("k") >= low) & (F.col("k") < high)).withColumn("start", F.sum("tokens").over(upto.orderBy("k", "rank")) - F.col("tokens"))
        line = gaps.select(*place, "start", "end", "bin_id", F.lit(0).alias("what")).unionByName(small.select(*place, "start", "cap", "doc_id", "piece", "tokens", F.lit(1).alias("what")), allowMissingColumns=True)
        line = line.withColumns({"into": F.last("bin_id", ignorenulls=True).over(upto.orderBy("start", "what")), "room": F.coalesce(F.max("end").over(Window.partitionBy(*place)), F.lit(0))}).where("what = 1")
        own = F.concat_ws("/", *place, F.lit(f"from {low}"), F.floor(F.try_divide(F.col("start") - F.col("room"), F.col("cap") - largest)))
        poured = line.withColumn("bin_id", F.when(F.col("start") < F.col("room"), F.col("into")).otherwise(own)).select(*columns)
        placed = stages.keep(placed.unionByName(poured))
    placed = placed.unionByName(cut.select(*columns))
    used = F.sum("tokens").over(Window.partitionBy("bin_id"))  # at most ``cap`` pieces a bin
    return placed.withColumn("bin_tokens", used.cast("int")).select("container", "bin_id", "doc_id", "piece", "tokens", "bin_tokens", F.round(F.try_divide("bin_tokens", "cap"), 6).alias("fill"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Bins, tokens and mean fill by container."""
    bins = packed.groupBy("container", "bin_id").agg(F.sum("tokens").alias("tokens"), F.max("fill").alias("fill"))
    return bins.groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("tokens").alias("tokens"), F.round(F.avg("fill"), 4).alias("mean_fill"))
