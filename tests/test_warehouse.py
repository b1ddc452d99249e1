import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolens.operators import verify as V, warehouse as W

D1, D2 = dt.date(2025, 1, 1), dt.date(2025, 1, 2)
#: Order 7 splits a line and comes again on the next day.
ORDERS = [(D1, "7", "tea", 10.0), (D1, "7", "cup", 1.0), (D1, "7", "tea", 0.5), (D1, "8", "cup", 6.0), (D1, "9", "tea", 2.0),
          (D2, "7", "cup", 3.0)]


def orders(spark, rows=ORDERS):
    return spark.createDataFrame(rows, "date date, order_id string, sku string, quantity double")


def items(spark, quantities, day=D1):
    return spark.createDataFrame([(day, f"S{i}", float(q), 1) for i, q in enumerate(quantities)],
                                 "date date, sku string, IQ double, IK int")


def test_split_lines_and_reused_order_numbers(spark):
    lines = W.order_sku_lines(orders(spark))
    assert lines.count() == 5
    eq = {(r.date, r.order_id): (r.EQ, r.EN) for r in W.order_eiq(lines).collect()}
    iq = {(r.date, r.sku): (r.IQ, r.IK) for r in W.item_eiq(lines).collect()}
    assert eq == {(D1, "7"): (11.5, 2), (D1, "8"): (6.0, 1), (D1, "9"): (2.0, 1), (D2, "7"): (3.0, 1)}
    assert iq == {(D1, "tea"): (12.5, 2), (D1, "cup"): (7.0, 2), (D2, "cup"): (3.0, 1)}
    totals = W.eiq_control_totals(lines, W.order_eiq(lines), W.item_eiq(lines)).collect()
    assert all(r.eq_diff == 0 and r.iq_diff == 0 for r in totals)


def test_abc_limits_crossing_items_and_zero_quantity(spark):
    rows = W.abc_classify(items(spark, [60, 20, 14, 5, 1, 0])).orderBy("sku").collect()
    assert [r.ABC for r in rows] == ["A", "A", "B", "B", "C", "ZERO"]
    assert [round(r.cum_share, 9) for r in rows] == [0.6, 0.8, 0.94, 0.99, 1.0, 1.0]
    assert [r.ABC for r in W.abc_classify(items(spark, [99, 1])).orderBy("sku").collect()] == ["A", "C"]


def test_a_null_day_is_a_day(spark):
    rows = W.abc_classify(items(spark, [3, 1]).unionByName(items(spark, [5, 5], None)))
    assert rows.count() == 4 and rows.where("date is null").count() == 2


def test_abc_refuses_a_day_without_quantity(spark):
    with pytest.raises(Exception, match="positive total"):
        W.abc_classify(items(spark, [0, 0])).collect()


def test_abc_of_two_days_is_the_union_of_single_days(spark):
    one, two = items(spark, [5, 5, 5, 1]), items(spark, [9, 1, 1], D2)
    both = W.abc_classify(one.unionByName(two))
    single = W.abc_classify(one).unionByName(W.abc_classify(two))
    assert both.exceptAll(single).count() == 0 and both.count() == 7


def test_slot_policies_walk_as_recorded(spark):
    # The published eight days and the metres recorded for them.
    rows = [("W", D1 + dt.timedelta(days=d), s, float(q)) for d in range(8)
            for s, q in zip("ABC", (20, 2, 4) if d % 2 == 0 else (2, 20, 4))]
    demand = spark.createDataFrame(rows, "warehouse string, date date, sku string, quantity double")
    ops = W.slot_policy_operations(W.slot_policy(demand), demand)
    total = {r.strategy: r.total_walk_m for r in W.slot_policy_cost(ops).collect()}
    assert total == {"fixed_two_day": 2064.0, "daily_previous_day": 3288.0, "hold_two_observations": 2064.0}
    # Demand of the evaluated day must not change that day's choice.
    last = D1 + dt.timedelta(days=7)
    changed = demand.withColumn("quantity", F.when(F.col("date") == last, F.col("quantity") * 50).otherwise(F.col("quantity")))
    cols = ["strategy", "date", "near_sku"]
    assert W.slot_policy(demand).select(cols).exceptAll(W.slot_policy(changed).select(cols)).count() == 0


def test_recompute_reports_only_the_seeded_fault(spark):
    raw = orders(spark)
    lines = W.order_sku_lines(raw)
    stored_items = W.abc_classify(W.item_eiq(lines), limits={"ABC": W.LIMITS, "ABC_70_90": (0.7, 0.9)})
    good = W.order_eiq(lines)
    assert V.recompute_eiq_abc(raw, good, stored_items).count() == 0
    bad = good.withColumn("EN", F.when(F.col("order_id") == "8", 5).otherwise(F.col("EN")))
    found = V.recompute_eiq_abc(raw, bad, stored_items).collect()
    assert [(r.key, r.field, r.status) for r in found] == [("2025-01-01|8", "EN", "differs")]
