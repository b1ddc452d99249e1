"""Registered warehouse queries."""

from ..functions.scale import cut_lineage
from ..operators import warehouse as W
from ..sources import bindings as B
from .registry import register, view

view("wh_orders", """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS order_id, l_partkey AS sku, l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("wh_lines", """
SELECT date, order_id, sku, sum(quantity) AS quantity, count(*) AS source_lines
FROM wh_orders GROUP BY date, order_id, sku""")
view("wh_order_eiq", """
SELECT date, order_id, sum(quantity) AS "EQ", count(DISTINCT sku) AS "EN" FROM wh_orders GROUP BY date, order_id""")
view("wh_items", """
SELECT date, sku, sum(quantity) AS "IQ", count(DISTINCT order_id) AS "IK" FROM wh_orders GROUP BY date, sku""")
view("wh_ranked", """
SELECT *, sum("IQ") OVER (PARTITION BY date ORDER BY "IQ" DESC, sku
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
       sum("IQ") OVER (PARTITION BY date) AS day_total FROM wh_items""")
view("wh_abc", """
SELECT date, sku, "IQ", "IK", running / day_total AS cum_share,
  CASE WHEN "IQ" = 0 THEN 'ZERO' WHEN (running - "IQ") / day_total < 0.80 THEN 'A'
       WHEN (running - "IQ") / day_total < 0.95 THEN 'B' ELSE 'C' END AS "ABC",
  CASE WHEN "IQ" = 0 THEN 'ZERO' WHEN (running - "IQ") / day_total < 0.70 THEN 'A'
       WHEN (running - "IQ") / day_total < 0.90 THEN 'B' ELSE 'C' END AS "ABC_70_90"
FROM wh_ranked""")
view("wh_demand", """
SELECT r_name AS warehouse, CAST(l_shipdate AS DATE) AS date, l_partkey AS sku, sum(l_quantity) AS quantity
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
view("wh_tops", """
SELECT warehouse, date, sku AS top_sku, quantity AS top_quantity,
       row_number() OVER (PARTITION BY warehouse ORDER BY date) AS day_no
FROM (SELECT *, row_number() OVER (PARTITION BY warehouse, date ORDER BY quantity DESC, sku) AS r FROM wh_demand)
WHERE r = 1""")
view("wh_initial", """
SELECT warehouse, sku AS initial_sku FROM (
  SELECT d.warehouse, d.sku, row_number() OVER (PARTITION BY d.warehouse ORDER BY sum(d.quantity) DESC, d.sku) AS r
  FROM wh_demand d JOIN wh_tops t ON d.warehouse = t.warehouse AND d.date = t.date AND t.day_no <= 2
  GROUP BY d.warehouse, d.sku) WHERE r = 1""")
view("wh_seen", """
SELECT t.*, initial_sku FROM (
  SELECT warehouse, date, day_no, lag(date) OVER w AS last_observed_day,
         lag(top_sku, 1) OVER w AS p1, lag(top_sku, 2) OVER w AS p2
  FROM wh_tops WINDOW w AS (PARTITION BY warehouse ORDER BY date)) t
JOIN wh_initial i ON t.warehouse = i.warehouse WHERE day_no > 2""")
view("wh_choices", """
SELECT warehouse, date, last_observed_day, initial_sku, 'fixed_two_day' AS strategy, initial_sku AS near_sku FROM wh_seen
UNION ALL SELECT warehouse, date, last_observed_day, initial_sku, 'daily_previous_day', p1 FROM wh_seen
UNION ALL SELECT warehouse, date, last_observed_day, initial_sku, 'hold_two_observations',
  coalesce(last_value(CASE WHEN p1 = p2 THEN p1 END IGNORE NULLS) OVER (
    PARTITION BY warehouse ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), initial_sku) FROM wh_seen""")
view("wh_policy", """
SELECT *, near_sku <> coalesce(lag(near_sku) OVER (PARTITION BY warehouse, strategy ORDER BY date), initial_sku) AS moved
FROM wh_choices""")
view("wh_operations", """
SELECT warehouse, strategy, date, last_observed_day, near_sku, pick_walk_m, move_walk_m,
       pick_walk_m + move_walk_m AS total_walk_m FROM (
  SELECT p.warehouse, p.strategy, p.date, p.last_observed_day, p.near_sku,
         sum(d.quantity * 2 * CASE WHEN d.sku = p.near_sku THEN 2.0 ELSE 10.0 END) AS pick_walk_m,
         CASE WHEN p.moved THEN 60.0 ELSE 0.0 END AS move_walk_m
  FROM wh_policy p JOIN wh_demand d ON p.warehouse = d.warehouse AND p.date = d.date
  GROUP BY p.warehouse, p.strategy, p.date, p.last_observed_day, p.near_sku, p.moved)""")


def lines(spark, folder):
    return W.order_sku_lines(B.warehouse_orders(spark, folder))


def items(spark, folder):
    return W.item_eiq(lines(spark, folder))


def _control(spark, folder):
    l = lines(spark, folder)
    return W.eiq_control_totals(l, W.order_eiq(l), W.item_eiq(l))


def _summary(spark, folder):
    l = lines(spark, folder)
    return W.warehouse_summary(l, W.abc_threshold_sensitivity(W.item_eiq(l)))


def operations(spark, folder):
    demand = cut_lineage(B.warehouse_demand(spark, folder))  # read by the policies and the costs
    return operations_of(demand)


def operations_of(demand):
    return W.slot_policy_operations(W.slot_policy(demand), demand)


register("order_sku_lines", "date:d order_id:i sku:i quantity:f source_lines:i", lines, "wh_lines")
register("order_eiq", "date:d order_id:i EQ:f EN:i", lambda s, d: W.order_eiq(lines(s, d)), "wh_order_eiq")
register("item_eiq", "date:d sku:i IQ:f IK:i", items, "wh_items")
register("eiq_control_totals", "date:d line_total:f eq_total:f iq_total:f eq_diff:f iq_diff:f", _control, """
SELECT l.date, line_total, eq_total, iq_total, line_total - eq_total AS eq_diff, line_total - iq_total AS iq_diff
FROM (SELECT date, sum(quantity) AS line_total FROM wh_lines GROUP BY date) l
JOIN (SELECT date, sum("EQ") AS eq_total FROM wh_order_eiq GROUP BY date) o ON l.date = o.date
JOIN (SELECT date, sum("IQ") AS iq_total FROM wh_items GROUP BY date) i ON l.date = i.date""")
register("abc_classify", "date:d sku:i IQ:f IK:i ABC:s", lambda s, d: W.abc_classify(items(s, d)), "wh_abc")
register("abc_cum_share", "date:d sku:i IQ:f cum_share:f", lambda s, d: W.abc_classify(items(s, d)), "wh_abc")
register("abc_threshold_sensitivity", "date:d sku:i IQ:f IK:i ABC:s ABC_70_90:s changed:b",
         lambda s, d: W.abc_threshold_sensitivity(items(s, d)),
         """SELECT *, "ABC" <> "ABC_70_90" AS changed FROM wh_abc""")
register("warehouse_summary", "days:i source_lines:i normalized_order_sku_lines:i total_quantity:f "
         "threshold_changed_rows:i", _summary, """
SELECT count(DISTINCT date) AS days, sum(source_lines) AS source_lines, count(*) AS normalized_order_sku_lines,
  sum(quantity) AS total_quantity,
  (SELECT count(*) FROM wh_abc WHERE "ABC" <> "ABC_70_90") AS threshold_changed_rows FROM wh_lines""")
register("top_sku_by_day", "warehouse:s date:d top_sku:i top_quantity:f",
         lambda s, d: W.top_sku_by_day(B.warehouse_demand(s, d), ["warehouse", "date"], "quantity"), "wh_tops")
register("slot_policy", "warehouse:s date:d strategy:s last_observed_day:d near_sku:i moved:b",
         lambda s, d: W.slot_policy(B.warehouse_demand(s, d)), "wh_policy")
register("slot_policy_operations", "warehouse:s strategy:s date:d near_sku:i pick_walk_m:f move_walk_m:f total_walk_m:f",
         operations, "wh_operations")
register("slot_policy_cost", "warehouse:s strategy:s pick_walk_m:f move_walk_m:f total_walk_m:f",
         lambda s, d: W.slot_policy_cost(operations(s, d)), """
SELECT warehouse, strategy, sum(pick_walk_m) AS pick_walk_m, sum(move_walk_m) AS move_walk_m,
  sum(total_walk_m) AS total_walk_m FROM wh_operations GROUP BY warehouse, strategy""")
