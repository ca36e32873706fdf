"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.lineage import Stages


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that isn't the least of its component.

    Each step replaces a node's links by links to its least neighbour, so the
    edge list shrinks towards one star per component in a logarithmic number
    of steps. Minima are combined before the shuffle; the joins that send them
    back are inner joins whose skew adaptive execution splits. Loops, repeated
    and null-ended edges are ignored. Nothing but two numbers reaches the driver.
    """
    links = edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).where("u is not null and v is not null and lo < hi").distinct()
    kept = stages.keep(links)
    while True:
        both = kept.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(kept.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("m")).select(F.col("n").alias("lo"), F.least("n", "m").alias("m"))
        large = kept.join(least, "lo").select(F.col("m").alias("lo"), "hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("lo"), "hi"), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e"))
        done = stages.keep(small.select("e.*").where("lo < hi").distinct())
        stages.drop(kept)
        kept = done
        # a star each: every node below has one link, and none of them is above another
        ends = kept.select(F.col("hi").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(kept.select("lo", F.lit(0), F.lit(1)))
        state = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).agg(F.max("below").alias("most"), F.count_if((F.col("below") > 0) & (F.col("above") > 0)).alias("both")).first()
        if state.both == 0 and (state.most or 1) == 1:
            return kept.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
