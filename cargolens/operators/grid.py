"""Nearest of many centres by a grid index that is finer where centres are dense.

The square around the points is split into 4 x 4 cells again and again. A centre leaves a cell if one of a few others (those
nearest to its corners and its middle) is nearer at all four corners: it then is nearer everywhere in the cell, as the border
between two centres is a line. A cell with at most ``LISTED`` centres is ready, the others are split again with what they kept. Every point lies in one ready cell (of some level), finds it by an equi-join and
compares the few centres listed there: exact, and ties are kept. Points are shuffled only where the ready cells are too many to send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import all_of, euclid, is_finite
from ..functions.scale import cut_lineage

#: Centres of a cell that are compared for each of its points.
LISTED = 16
#: A cell at this level has the 4**-LEVELS part of the square's side; it is ready whatever it holds.
LEVELS = 12
#: Entries (centres listed in ready cells) that are sent to all tasks, some 40 bytes each; more are joined by shuffle.
SENT = 500_000


def _cell(v: str, low: str | Column, side: Column, level: Column) -> Column:
    """Number of the cell of a coordinate at a level; the last one holds the upper edge."""
    many = F.pow(F.lit(4.0), level)
    return F.least(F.greatest(F.floor((F.col(v) - low) / side * many), F.lit(0)), (many - 1).cast("bigint")).cast("bigint")


def ready_cells(centers: DataFrame, low_x: float, low_y: float, side: float) -> DataFrame:
    """k, level, ix, iy, listed (cluster, x, y): the centres that can be nearest to a point of each cell."""
    open_ = (centers.groupBy("k", "x_km", "y_km").agg(F.min("cluster").cast("int").alias("cluster"))  # of equal places the lower wins
             .withColumn("ix", F.lit(0).cast("bigint")).withColumn("iy", F.lit(0).cast("bigint")))
    out, level = None, 0
    while True:
        counted = open_.groupBy("k", "ix", "iy").agg(F.count(F.lit(1)).alias("_n"))
        dense = (F.col("_n") > LISTED) & F.lit(level < LEVELS)
        held = open_.join(counted, ["k", "ix", "iy"])
        ready = (held.where(~dense).groupBy("k", "ix", "iy")
                 .agg(F.collect_list(F.struct("cluster", F.col("x_km").alias("x"), F.col("y_km").alias("y"))).alias("listed"))
                 .select("k", F.lit(level).alias("level"), "ix", "iy", "listed"))
        out = ready if out is None else out.unionByName(ready)
        more = held.where(dense).drop("_n")
        if level == LEVELS or more.isEmpty():
            return cut_lineage(out)
        level += 1
        width = side / 4.0 ** level
        step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(4) for b in range(4)]))
        parts = (more.withColumn("_s", step).withColumn("ix", F.col("ix") * 4 + F.col("_s.a")).withColumn("iy", F.col("iy") * 4 + F.col("_s.b")))

        def squared(x: Column, y: Column, to: tuple[Column, Column]) -> Column:
            return (x - to[0]) * (x - to[0]) + (y - to[1]) * (y - to[1])

        corners = [(F.lit(low_x) + (F.col("ix") + a) * width, F.lit(low_y) + (F.col("iy") + b) * width)
                   for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5))]
        parts = parts.drop("_s").withColumn("_d", F.array(*[squared(F.col("x_km"), F.col("y_km"), c) for c in corners]))
        # The rival of each corner with its own distances to all corners.
        rivals = parts.groupBy("k", "ix", "iy").agg(F.array(*[
            F.min_by("_d", F.col("_d")[i]) for i in range(len(corners))]).alias("_rivals"))
        # A little more than equality is asked, so that rounding loses no tie.
        beaten = F.exists("_rivals", lambda r: all_of([r[i] + F.lit(1e-12) * (r[i] + F.col("_d")[i]) < F.col("_d")[i] for i in range(4)]))
        open_ = cut_lineage(parts.join(rivals, ["k", "ix", "iy"]).where(~beaten)
                            .select("k", "x_km", "y_km", "cluster", "ix", "iy"))


def nearest_of_many(points: DataFrame, centers: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, the columns of points, cluster and distance_km; ties go to the lower cluster.

    A point with a coordinate that is null or not finite has no nearest centre: it gets the lowest cluster and the distance to it.
    """
    centers = cut_lineage(centers.where(F.col("k").isin(list(ks))).select("k", F.col("cluster").cast("int"), "x_km", "y_km"))
    placed = all_of([F.coalesce(is_finite(c), F.lit(False)) for c in ("x_km", "y_km")])
    box = points.where(placed).agg(F.min("x_km"), F.max("x_km"), F.min("y_km"), F.max("y_km")).first()
    low_x, high_x, low_y, high_y = (float(v) if v is not None else 0.0 for v in box)
    side = max(high_x - low_x, high_y - low_y) * (1 + 1e-9) or 1.0
    cells = ready_cells(centers, low_x, low_y, side)
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # at most LEVELS + 1
    lowest = centers.groupBy("k").agg(F.min_by(F.array(F.struct("cluster", F.col("x_km").alias("x"), F.col("y_km").alias("y"))),
                                               "cluster").alias("listed"))
    lost = lowest.select("k", F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy"), "listed")
    cells = cells.unionByName(lost)
    entries = cells.agg(F.sum(F.size("listed"))).first()[0] or 0

    # A point asks at each level that has ready cells; one of them answers.
    at = F.when(placed, F.array(*[F.lit(v) for v in levels])).otherwise(F.array(F.lit(-1)))
    each = (points.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).withColumn("level", F.explode(at)))
    level = F.col("level")
    each = (each.withColumn("ix", F.when(level < 0, F.lit(0)).otherwise(_cell("x_km", F.lit(low_x), F.lit(side), level)).cast("bigint"))
            .withColumn("iy", F.when(level < 0, F.lit(0)).otherwise(_cell("y_km", F.lit(low_y), F.lit(side), level)).cast("bigint")))
    both = each.join(F.broadcast(cells) if entries <= SENT else cells.hint("merge"), ["k", "level", "ix", "iy"])
    found = F.array_min(F.transform("listed", lambda c: F.struct(
        euclid("x_km", "y_km", c["x"], c["y"]).alias("d"), c["cluster"].alias("cluster"))))
    return (both.withColumn("_n", found)
            .select("k", *points.columns, F.col("_n.cluster").alias("cluster"), F.col("_n.d").alias("distance_km")))
