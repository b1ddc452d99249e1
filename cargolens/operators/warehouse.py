"""Daily order/item statistics, ABC classes and slotting policies.

``groups`` names the key of one day's classification, e.g. ``["date"]`` or
``["warehouse", "date"]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scale import ordered_running

DAY = ["date"]
LIMITS = (0.80, 0.95)
# Fixed policy names, in reporting order.
POLICIES = ("fixed_two_day", "daily_previous_day", "hold_two_observations")


def order_sku_lines(orders: DataFrame, groups: list[str] = DAY) -> DataFrame:
    """Sum split lines to one row for each (day, order, sku)."""
    return (orders.groupBy(*groups, "order_id", "sku")
            .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("source_lines")))


def order_eiq(lines: DataFrame, groups: list[str] = DAY) -> DataFrame:
    """EQ = units, EN = distinct SKUs of each order. Lines are already unique by SKU."""
    return (lines.groupBy(*groups, "order_id")
            .agg(F.sum("quantity").alias("EQ"), F.count(F.lit(1)).alias("EN")))


def item_eiq(lines: DataFrame, groups: list[str] = DAY) -> DataFrame:
    """IQ = units, IK = distinct orders of each SKU."""
    return (lines.groupBy(*groups, "sku")
            .agg(F.sum("quantity").alias("IQ"), F.count(F.lit(1)).alias("IK")))


def eiq_control_totals(lines: DataFrame, orders: DataFrame, items: DataFrame,
                       groups: list[str] = DAY) -> DataFrame:
    """Each day's line, order and item totals with their differences."""
    l = lines.groupBy(*groups).agg(F.sum("quantity").alias("line_total"))
    o = orders.groupBy(*groups).agg(F.sum("EQ").alias("eq_total"))
    i = items.groupBy(*groups).agg(F.sum("IQ").alias("iq_total"))
    return (l.join(o, groups, "full_outer").join(i, groups, "full_outer")
            .withColumn("eq_diff", F.col("line_total") - F.col("eq_total"))
            .withColumn("iq_diff", F.col("line_total") - F.col("iq_total")))


def _label(limits: tuple[float, float]) -> Column:
    before = (F.col("running") - F.col("IQ")) / F.col("day_total")
    return (F.when(F.col("IQ") == 0, "ZERO").when(before < limits[0], "A")
            .when(before < limits[1], "B").otherwise("C"))


def abc_classify(items: DataFrame, groups: list[str] = DAY,
                 limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Inclusive cumulative share and ABC class by descending quantity, then SKU.

    The item that crosses a limit stays in the earlier class. ``limits`` maps output columns
    to limit pairs, so several pairs are classified in one pass. A day without quantity fails.
    """
    limits = limits or {"ABC": LIMITS}
    ranked = ordered_running(items, groups, [F.col("IQ").desc(), F.col("sku")],
                             sums={"running": F.col("IQ")}, totals={"day_total": F.col("IQ")})
    share = F.when(F.col("day_total") > 0, F.col("running") / F.col("day_total")).otherwise(
        F.raise_error(F.lit("ABC needs a positive total quantity in every group")))
    return ranked.select(*items.columns, share.alias("cum_share"),
                         *[_label(pair).alias(name) for name, pair in limits.items()])


def abc_threshold_sensitivity(items: DataFrame, groups: list[str] = DAY,
                              first: tuple[float, float] = LIMITS,
                              second: tuple[float, float] = (0.70, 0.90)) -> DataFrame:
    """Both classes side by side and whether the row changed."""
    both = abc_classify(items, groups, {"ABC": first, "ABC_70_90": second})
    return both.drop("cum_share").withColumn("changed", F.col("ABC") != F.col("ABC_70_90"))


def warehouse_summary(lines: DataFrame, sensitivity: DataFrame, groups: list[str] = DAY) -> DataFrame:
    """Days, source lines, normalised lines, total quantity and changed ABC rows as one row."""
    per_day = lines.groupBy(*groups).agg(
        F.sum("source_lines").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("q"))
    changed = sensitivity.groupBy(*groups).agg(F.count_if("changed").alias("c"))
    return per_day.join(changed, groups, "left").agg(
        F.count(F.lit(1)).alias("days"), F.sum("s").alias("source_lines"),
        F.sum("n").alias("normalized_order_sku_lines"), F.sum("q").alias("total_quantity"),
        F.sum("c").alias("threshold_changed_rows"))


def top_sku_by_day(items: DataFrame, groups: list[str] = DAY, quantity: str = "IQ") -> DataFrame:
    """Largest SKU of each day, equal quantities by SKU; combined map-side, no window."""
    order = F.struct(-F.col(quantity), F.col("sku"))
    return items.groupBy(*groups).agg(F.min_by("sku", order).alias("top_sku"),
                                      F.max(quantity).alias("top_quantity"),
                                      F.sum(quantity).alias("day_quantity"))


def slot_policy(demand: DataFrame, site: str = "warehouse", observation_days: int = 2) -> DataFrame:
    """The SKU each policy keeps in the near slot, decided from earlier days only.

    ``fixed_two_day`` keeps the top SKU of the observation days, ``daily_previous_day`` follows
    yesterday, ``hold_two_observations`` moves after two equal observations. Windows run over one
    row for each site and day.
    """
    by_day = Window.partitionBy(site).orderBy("date")
    tops = (top_sku_by_day(demand, [site, "date"], "quantity")
            .withColumn("day_no", F.row_number().over(by_day)))
    watched = (tops.where(F.col("day_no") <= observation_days).select(site, "date")
               .join(demand, [site, "date"])
               .groupBy(site, "sku").agg(F.sum("quantity").alias("quantity")))
    initial = watched.groupBy(site).agg(
        F.min_by("sku", F.struct(-F.col("quantity"), F.col("sku"))).alias("initial_sku"))
    seen = (tops.withColumn("last_observed_day", F.lag("date", 1).over(by_day))
            .withColumn("previous", F.lag("top_sku", 1).over(by_day))
            .withColumn("before_previous", F.lag("top_sku", 2).over(by_day))
            .where(F.col("day_no") > observation_days)
            .join(initial, site))
    repeated = F.when(F.col("previous") == F.col("before_previous"), F.col("previous"))
    held = F.last(repeated, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    seen = (seen.withColumn(POLICIES[0], F.col("initial_sku"))
            .withColumn(POLICIES[1], F.col("previous"))
            .withColumn(POLICIES[2], F.coalesce(held, F.col("initial_sku"))))
    for p in POLICIES:
        seen = seen.withColumn(f"moved_{p}", F.col(p) != F.coalesce(F.lag(p, 1).over(by_day),
                                                                    F.col("initial_sku")))
    rows = F.array(*[F.struct(F.lit(p).alias("strategy"), F.col(p).alias("near_sku"),
                              F.col(f"moved_{p}").alias("moved")) for p in POLICIES])
    return seen.select(site, "date", "last_observed_day", "day_quantity", F.inline(rows))


def slot_policy_operations(policy: DataFrame, demand: DataFrame, site: str = "warehouse",
                           near_m: float = 2.0, far_m: float = 10.0, swap_m: float = 60.0) -> DataFrame:
    """Walking metres of each policy and day: one round trip for each unit, plus the moves."""
    near = demand.select(site, "date", F.col("sku").alias("near_sku"), F.col("quantity").alias("near_quantity"))
    out = (policy.join(near, [site, "date", "near_sku"], "left")
           .withColumn("near_quantity", F.coalesce("near_quantity", F.lit(0.0))))
    pick = 2 * (F.col("near_quantity") * near_m + (F.col("day_quantity") - F.col("near_quantity")) * far_m)
    move = F.when(F.col("moved"), F.lit(swap_m)).otherwise(F.lit(0.0))
    return out.select(site, "strategy", "date", "last_observed_day", "near_sku",
                      pick.alias("pick_walk_m"), move.alias("move_walk_m"), (pick + move).alias("total_walk_m"))


def slot_policy_cost(operations: DataFrame, site: str = "warehouse") -> DataFrame:
    """Total metres of each site and policy."""
    return operations.groupBy(site, "strategy").agg(
        *[F.sum(c).alias(c) for c in ("pick_walk_m", "move_walk_m", "total_walk_m")])
