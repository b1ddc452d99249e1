"""Pareto frontier of any number of plans in one group.

What matters for a plan is the best cover among plans of less loss, and of at most as much. Both are running maxima over the
order of losses: each range partition takes its own running maximum (its local frontier), the maxima of the partitions before
it come from a table with one row a partition, and one filter follows. Limits moved by the tolerance are asked as
rows of their own in that order, so no partition needs to see its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scale import cut_lineage, frozen_ranges, null_safe_join


def running_max(df: DataFrame, groups: list[str], order: list[Column], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Add the largest non-null value of all rows of the group up to this one; no group has to fit into a task."""
    rows = frozen_ranges(df, [*[F.col(g) for g in groups], *order], partitions)
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*groups, "_chunk").agg(F.max(value).alias("_most"))
    chunks = chunks.select(*groups, "_chunk", F.max("_most").over(before).alias("_before"))
    inside = Window.partitionBy(*groups, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (null_safe_join(rows, chunks, [*groups, "_chunk"])
            .withColumn(name, F.greatest(F.max(value).over(inside), "_before")).drop("_chunk", "_before"))


def pareto_frontier(plans: DataFrame, groups: list[str], tolerance: float, loss: str = "weighted_squared_loss",
                    cover: str = "demand_coverage", partitions: int | None = None) -> DataFrame:
    """Add is_pareto: no other plan of the group has less loss and more cover, one of them beyond the tolerance.

    Plans of equal loss are one row of the order. A plan without loss or cover is not on the frontier.
    """
    plans = cut_lineage(plans)  # losses are matched by value, so both readings must be one
    best = plans.where(F.col(loss).isNotNull()).groupBy(*groups, loss).agg(F.max(cover).alias("_best"))
    e, at = F.lit(float(tolerance)), F.col(loss)
    # Asked before the plans at that loss (strictly less), and after them (at most as much).
    marks = F.array(F.struct(at.alias("_at"), F.lit(1).alias("_kind"), F.col("_best").alias("_cover")),
                    F.struct((at - e).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_cover")),
                    F.struct((at + e).alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast("double").alias("_cover")))
    asked = best.select(*groups, loss, F.inline(marks))
    found = running_max(asked, groups, [F.col("_at"), F.col("_kind")], "_cover", "_max", partitions)
    sides = (found.where(F.col("_kind") != 1).groupBy(*groups, loss)
             .agg(F.max(F.when(F.col("_kind") == 0, F.col("_max"))).alias("_less"),
                  F.max(F.when(F.col("_kind") == 2, F.col("_max"))).alias("_upto")))
    known = F.col(cover)
    dominated = F.coalesce(F.col("_less") >= known - e, F.lit(False)) | F.coalesce(F.col("_upto") > known + e, F.lit(False))
    return (null_safe_join(plans, sides, [*groups, loss], "left")
            .withColumn("is_pareto", ~dominated & F.col(loss).isNotNull() & known.isNotNull()).drop("_less", "_upto"))
