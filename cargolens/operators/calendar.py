"""Contiguous calendars: gaps, longest blocks and gap-preserving reindexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def blocks(daily: DataFrame, groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Runs of consecutive dates as start_date, end_date, days. ``daily`` has one row a day."""
    order = Window.partitionBy(*groups).orderBy("date")
    island = F.date_sub("date", F.row_number().over(order))
    return (daily.select(*groups, "date", island.alias("_island"))
            .groupBy(*groups, "_island")
            .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
                 F.count(F.lit(1)).alias("days"))
            .drop("_island"))


def longest_contiguous_block(daily: DataFrame, groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Longest run of each series; equally long runs keep the earliest."""
    best = F.min_by(F.struct("start_date", "end_date", "days"), F.struct(-F.col("days"), F.col("start_date")))
    return blocks(daily, groups).groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def within_longest_block(daily: DataFrame, groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    chosen = longest_contiguous_block(daily, groups).drop("days")
    return (daily.join(chosen, list(groups))
            .where(F.col("date").between(F.col("start_date"), F.col("end_date")))
            .drop("start_date", "end_date"))


def full_calendar(daily: DataFrame, groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    span = daily.groupBy(*groups).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(*groups, F.explode(F.sequence("a", "b")).alias("date"))


def calendar_gaps(daily: DataFrame, groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Dates between the first and last day that have no row; they are never filled with zero."""
    return full_calendar(daily, groups).join(daily.select(*groups, "date"), [*groups, "date"], "left_anti")


def gap_preserving_calendar(daily: DataFrame, groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Every calendar day; a day without rows keeps a null quantity."""
    return full_calendar(daily, groups).join(daily, [*groups, "date"], "left")
