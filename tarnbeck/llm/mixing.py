"""Drawing a mixture of sources near target weights with capped repetition.

A source's weight is its own token share tempered toward its target share,
own ** (1 - x) * target ** x. The exponent x is bisected to the largest at which
no source would be repeated beyond its limit, 1 if the targets themselves break
none. Normalised weights become token budgets; a budget takes whole epochs of
its source and then blocks of a pseudo-random permutation until it is spent.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbeck.lineage import Stages

from .tokens import VOCABULARY, with_tokens

STEPS, ROUNDS = 32, 6  # points of a grid, and how often it is refined


def source_name(column: str) -> Column:
    """Sources up to outer white space, a closing slash and case; empty is null."""
    name = F.regexp_replace(F.lower(F.col(column).cast("string")), r"(?U)^\s+|[\s/]+$", "")
    return F.when(name != "", name)


def tempered(x: Column | float) -> Column:
    """own ** (1 - x) * want ** x, not normalised."""
    x = x if isinstance(x, Column) else F.lit(x)
    return F.exp((1 - x) * F.log("own") + x * F.log("want"))


def bisect(rows: DataFrame, measures: list[Column], fits: Callable[[Row], bool]) -> float | None:
    """The largest x in [0, 1] up to which ``fits`` holds, None if it doesn't at 0.

    ``fits`` gets the ``measures`` of all ``rows`` at an x. A whole grid of x is
    measured in one aggregation, then the step in which it stops holding.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        points = rows.withColumn("x", F.explode(F.array(*map(F.lit, grid)))).groupBy("x").agg(*measures)
        bad = [r.x for r in sorted(points.collect()) if not fits(r)]
        if not bad:
            return high
        if bad[0] == low:
            return None if low == 0 else low
        low, high = bad[0] - (high - low) / STEPS, bad[0]
    return low


def shared_out(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` as a share of its sum, over few rows (one a source)."""
    total = rows.agg(F.sum(column)).first()[0] or 1
    return rows.withColumn(name, F.col(column) / F.lit(float(total)))


def entropy_targets(rows: DataFrame, wanted: float) -> DataFrame:
    """``rows`` (source, size, ...) whose ``target`` is the own share, tempered toward the uniform one until the entropy is ``wanted``."""
    rows = shared_out(rows.where("size > 0"), "size", "own").withColumn("want", F.lit(1.0))
    u = tempered(F.col("x"))
    x = bisect(rows, [F.sum(u).alias("z"), F.sum(u * F.log(u)).alias("s")], lambda r: log(r.z) - r.s / r.z <= wanted) or 0.0
    return rows.withColumn("target", tempered(x)).drop("own", "want")


def budgets(rows: DataFrame, total: int, stages: Stages) -> tuple[DataFrame, float]:
    """(source, size, budget) of ``rows`` (source, size, target, limit), and the exponent of the weights.

    If not even the own shares (x = 0) fit into ``total``, sources too small for theirs get
    their limit, and the others the rest in the same way.
    """
    free = rows.where("target > 0 and size > 0 and limit > 0")
    given = rows.select("source", "size", F.lit(0).cast("long").alias("budget")).join(free.select("source"), "source", "left_anti")
    while True:
        known = free.agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("limit")).alias("room")).first()
        left = max(0, min(total, known.room or 0))
        if not left:
            return given.unionByName(free.select("source", "size", F.lit(0).cast("long").alias("budget"))), 1.0
        free = stages.keep(shared_out(shared_out(free, "size", "own"), "target", "want"))
        room, u = F.col("size") * F.col("limit"), tempered(F.col("x"))
        x = bisect(free, [F.sum(u).alias("z"), F.max(u / (room + 0.5)).alias("most")], lambda r: left * r.most <= r.z)
        if x is not None:
            z = free.agg(F.sum(tempered(x))).first()[0]
            budget = F.least(room, F.round(tempered(x) * F.lit(left / z))).cast("long")
            return given.unionByName(free.select("source", "size", budget.alias("budget"))), x
        short = F.col("own") * left > room + 0.5
        full = free.where(short).select("source", "size", room.cast("long").alias("budget"))
        given, total = given.unionByName(full), left - full.agg(F.sum("budget")).first()[0]
        free = free.where(~short).select("source", "size", "target", "limit")


class Mixture:
    """documents: (doc_id, source, n_tokens, repeats); shares: a row per target source."""

    def __init__(self, documents: DataFrame, shares: DataFrame, exponent: float) -> None:
        self.documents, self.shares, self.exponent = documents, shares, exponent


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, least_use: float = 0.5, target_entropy: float | None = None, block_docs: int = 20_000, seed: int = 0, vocabulary: str = VOCABULARY) -> Mixture:
    """Chosen repeats of every drawn document, and target and actual shares with the exponent.

    ``docs`` needs doc_id, text and source; ``targets`` source, target_share and
    max_repeats; other columns are ignored. Sources are compared up to case,
    outer space and a closing slash; documents of no target source, with null
    source or without tokens aren't drawn. Without ``total_tokens`` the mixture
    is as large as it can be with all targets met, but no less than
    ``least_use`` of the targeted sources' tokens; where a limit then binds, the
    exponent falls below 1, which moves all sources from their target toward
    their own share as far as the limit asks, and the report shows the gap. With
    ``target_entropy`` the targets are replaced by the sources' own shares at
    the temperature that has it. Null shares count as 0, null limits as 1, of
    repeated targets the largest share counts; a target source without documents has share 0; empty tables give an empty mixture.
    Sources and targets stay tables; the driver sees sums.
    """
    stages = Stages(docs.sparkSession, "mixing")
    plan = targets.select(source_name("source").alias("source"), F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0)).cast("double")).alias("target"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1)).cast("int")).alias("limit")).where("source is not null")
    plan = plan.groupBy("source").agg(F.max_by("limit", "target").alias("limit"), F.max("target").alias("target"))
    named = docs.select(F.col("doc_id").cast("long"), source_name("source").alias("source"), "text").join(plan.select("source"), "source", "left_semi")
    sized = stages.keep(with_tokens(named, ["doc_id", "source"], "text", vocabulary).where("n_tokens > 0"))
    blocks = max(1024, -(-sized.count() // block_docs))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int"))
    per_block = stages.keep(sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")))
    sizes = per_block.groupBy("source").agg(F.sum("n").alias("size"))
    known = stages.keep(plan.join(sizes, "source", "left").fillna(0, ["size"]).coalesce(1))
    aim = entropy_targets(known, target_entropy) if target_entropy is not None else known
    reached = shared_out(aim.where("target > 0 and size > 0 and limit > 0"), "target", "want")
    if total_tokens is None:
        most = reached.agg(F.min(F.col("limit") * F.col("size") / F.col("want")).alias("exact"), F.sum("size").alias("size")).first()
        total_tokens = round(max(most.exact or 0, least_use * (most["size"] or 0)))
    drawn, exponent = budgets(aim, total_tokens, stages)
    drawn = stages.keep(drawn.coalesce(1))
    budget = drawn.where("size > 0").select("source", F.expr("budget div size").cast("int").alias("epochs"), F.expr("budget % size").alias("rest"))
    # the rest of a budget: whole blocks in permuted order, then documents of the block where it ends
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = per_block.join(budget, "source").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    joined = sized.join(cuts.select("source", "block", "epochs", "rest", "before", "n"), ["source", "block"])
    inner = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id"))
    whole = joined.where("before + n <= rest or before >= rest").withColumn("last", (F.col("before") < F.col("rest")).cast("int"))
    ends = joined.where("before + n > rest and before < rest").withColumn("last", (inner - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    chosen = whole.unionByName(ends).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("last")).alias("repeats")).where("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    report = known.join(got, "source", "left").fillna(0, ["tokens", "most_repeats"])
    whole_tokens = F.sum("tokens").over(Window.partitionBy())  # one row a source
    report = report.select("source", F.col("target").alias("target_share"), F.col("limit").alias("max_repeats"), F.col("size").alias("available"), "tokens", "most_repeats", F.round(F.coalesce(F.try_divide("tokens", whole_tokens), F.lit(0.0)), 6).alias("actual_share"), F.lit(round(exponent, 6)).alias("exponent"))
    return Mixture(chosen, report, exponent)
