"""Registered verification queries.

The stored tables are the operators' own results with known faults written into some rows, so that
each check has something to find.
"""

from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import delivery as T, demand as D, location as L, segments as G, verify as V, warehouse as W
from ..sources import bindings as B
from . import delivery as pt, demand as pd_, location as pl, segments as ps, warehouse as pw
from .registry import register, view

DIFF = "table:s key:s field:s status:s stored:f fresh:f"


def diff_sql(stored, fresh, keys, values, exact=(), table="result"):
    """The same comparison written as a full join."""
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM f.{k}" for k in keys)
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST(coalesce(s.{k}, f.{k}) AS VARCHAR), 'null')" for k in keys) + ")"
    head = f"SELECT '{table}' AS \"table\", {key} AS key"
    join = f"FROM (SELECT *, 1 AS here FROM {stored}) s FULL JOIN (SELECT *, 1 AS here FROM {fresh}) f ON {on}"
    parts = [f"{head}, CAST(NULL AS VARCHAR) AS field, 'missing' AS status, CAST(NULL AS DOUBLE) AS stored, "
             f"CAST(NULL AS DOUBLE) AS fresh {join} WHERE s.here IS NULL",
             f"{head}, NULL, 'extra', NULL, NULL {join} WHERE f.here IS NULL"]
    for c in values:
        a, b = f'CAST(s."{c}" AS DOUBLE)', f'CAST(f."{c}" AS DOUBLE)'
        parts.append(f"{head}, '{c}', 'differs', {a}, {b} {join} WHERE s.here = 1 AND f.here = 1 AND NOT coalesce("
                     f"abs({a} - {b}) <= greatest(1e-7 * greatest(abs({a}), abs({b})), 2e-6), {a} IS NULL AND {b} IS NULL)")
    for c in exact:
        parts.append(f"{head}, '{c}', 'differs', NULL, NULL {join} WHERE s.here = 1 AND f.here = 1 "
                     f"AND s.\"{c}\" IS DISTINCT FROM f.\"{c}\"")
    return " UNION ALL ".join(parts)


def faulty(df, column, when, delta=1.0):
    return df.withColumn(column, F.when(when, F.col(column) + F.lit(delta)).otherwise(F.col(column)))


# Order statistics ----------------------------------------------------------------------------

def _stored_orders(lines):
    """One unit too many where an order has seven SKUs; orders with nine SKUs left out."""
    return faulty(W.order_eiq(lines).where("EN <> 9"), "EQ", F.col("EN") == 7)


def _tolerant(s, d):
    lines = cut_lineage(pw.lines(s, d))
    return V.tolerant_diff(_stored_orders(lines), W.order_eiq(lines), ["date", "order_id"], ["EQ", "EN"], table="order_eiq")


view("vf_orders", 'SELECT date, order_id, "EQ" + CASE WHEN "EN" = 7 THEN 1 ELSE 0 END AS "EQ", "EN" FROM wh_order_eiq WHERE "EN" <> 9')
register("tolerant_diff", DIFF, _tolerant,
    diff_sql("vf_orders", "wh_order_eiq", ["date", "order_id"], ["EQ", "EN"], table="order_eiq"))


def _stored_items(lines):
    items = W.abc_classify(W.item_eiq(lines), limits={"ABC": W.LIMITS, "ABC_70_90": (0.70, 0.90)})
    return items.withColumn("ABC", F.when(F.col("IK") == 2, F.lit("B")).otherwise(F.col("ABC")))


view("vf_items", """SELECT date, sku, "IQ", "IK", cum_share, CASE WHEN "IK" = 2 THEN 'B' ELSE "ABC" END AS "ABC", "ABC_70_90" FROM wh_abc""")


def _eiq_check(s, d):
    """The order lines are summed and written once; the stored tables and the check both read them."""
    lines = cut_lineage(pw.lines(s, d))
    return V.recompute_eiq_abc(lines, _stored_orders(lines), _stored_items(lines))


register("recompute_eiq_abc", DIFF, _eiq_check,
    diff_sql("vf_orders", "wh_order_eiq", ["date", "order_id"], ["EQ", "EN"], table="order_eiq") + " UNION ALL "
    + diff_sql("vf_items", "wh_abc", ["date", "sku"], ["IQ", "IK", "cum_share"], ["ABC", "ABC_70_90"], "item_eiq_abc"))


def _stored_operations(demand):
    return faulty(pw.operations_of(demand), "pick_walk_m", (F.dayofmonth("date") == 13) & (F.col("strategy") == "daily_previous_day"), 4.0)


def _slotting_check(s, d):
    """The demand is summed and written once; the stored table and the check both read it."""
    demand = cut_lineage(B.warehouse_demand(s, d))
    return V.recompute_slotting(demand, _stored_operations(demand))


view("vf_operations", """
SELECT warehouse, strategy, date, near_sku, move_walk_m, total_walk_m, pick_walk_m
  + CASE WHEN day(date) = 13 AND strategy = 'daily_previous_day' THEN 4 ELSE 0 END AS pick_walk_m FROM wh_operations""")
register("recompute_slotting", DIFF, _slotting_check,
         diff_sql("vf_operations", "wh_operations", ["warehouse", "strategy", "date"],
                  ["pick_walk_m", "move_walk_m", "total_walk_m"], ["near_sku"], "warehouse_operations"))

# Forecasts -----------------------------------------------------------------------------------

view("vf_predictions", """
SELECT series_id, cutoff, date, model, prediction, actual + CASE WHEN day(date) = 31 THEN 2 ELSE 0 END AS actual
FROM dm_backtest""")
view("vf_rebuilt", """
SELECT series_id, cutoff, model, min(date) AS valid_start, avg(abs(actual - prediction)) AS mae,
  sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse FROM vf_predictions GROUP BY 1, 2, 3""")
view("vf_board", "SELECT series_id, model, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse FROM dm_metrics GROUP BY 1, 2")
view("vf_board_rebuilt", "SELECT series_id, model, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse FROM vf_rebuilt GROUP BY 1, 2")


def _stored_forecasts(s, d):
    """The series, predictions with wrong actuals on the 31st, and metrics of the right ones."""
    series = pd_.series(s, d)
    right = cut_lineage(D.rolling_backtest(series))
    metrics = D.forecast_metrics(right)
    return series, faulty(right, "actual", F.dayofmonth("date") == 31, 2.0), metrics


def _metrics_check(s, d):
    series, predictions, metrics = _stored_forecasts(s, d)
    return V.recompute_metrics(series, predictions, metrics, D.method_leaderboard(metrics))


register("recompute_metrics", DIFF, _metrics_check, " UNION ALL ".join([
    diff_sql("vf_predictions", "dm_backtest", ["series_id", "cutoff", "date", "model"], ["actual"], table="predictions"),
    diff_sql("dm_metrics", "vf_rebuilt", ["series_id", "cutoff", "model"], ["mae", "rmse"], ["valid_start"], "metrics"),
    diff_sql("vf_board", "vf_board_rebuilt", ["series_id", "model"], ["mean_mae", "mean_rmse"], table="leaderboard")]))


def _shape(s, d):
    """Ridge rows of the 15th and mean rows of windows with an April day left out."""
    rows = D.rolling_backtest(pd_.series(s, d))
    ridge = (F.col("model") == "calendar_ridge") & (F.dayofmonth("date") == 15)
    april = rows.where("month(date) = 4").select("series_id", "cutoff").distinct().withColumn("april", F.lit(True))
    rows = rows.where(~ridge).join(april, ["series_id", "cutoff"], "left")
    rows = rows.where(~((F.col("model") == "recent_mean") & F.coalesce("april", F.lit(False))))
    return V.window_shape_check(rows, 14, D.METHODS)


register("window_shape_check", "series_id:s cutoff:i model:s problem:s", _shape, """
WITH a AS (SELECT DISTINCT series_id, cutoff FROM dm_backtest WHERE month(date) = 4),
r AS (SELECT b.*, a.cutoff IS NOT NULL AS april FROM dm_backtest b LEFT JOIN a ON a.series_id = b.series_id AND a.cutoff = b.cutoff)
SELECT series_id, cutoff, model, 'wrong_length' AS problem FROM r WHERE model = 'calendar_ridge'
GROUP BY 1, 2, 3 HAVING count(*) FILTER (day(date) <> 15) <> 14
UNION ALL SELECT DISTINCT series_id, cutoff, 'recent_mean', 'missing_method' FROM r WHERE april""")

# Location ------------------------------------------------------------------------------------


def _coverage_check(s, d):
    points, centers = pl.points(s, d), cut_lineage(pl.centers(s, d))
    near = L.nearest_center(points, centers, pl.KS)
    stored = near.select("k", "point_id", F.when((F.col("k") == 4) & (F.col("cluster") == 1), 0)
                         .otherwise(F.col("cluster")).alias("cluster"), "distance_km")
    cover = faulty(L.coverage(near, pl.RADII), "city_coverage", F.col("k") == 2, 0.001)
    return V.recompute_coverage(points, centers, stored, cover, pl.KS, pl.RADII)


view("vf_cover", """
SELECT k, radius_km, city_coverage + CASE WHEN k = 2 THEN 0.001 ELSE 0 END AS city_coverage, demand_coverage,
  weighted_distance_km FROM lc_coverage""")
register("recompute_coverage", DIFF, _coverage_check, """
SELECT * FROM (SELECT 'allocations' AS "table", n.k || '|' || n.point_id AS key, 'cluster' AS field, 'not_nearest' AS status,
  sqrt((p.x_km - c.x_km) * (p.x_km - c.x_km) + (p.y_km - c.y_km) * (p.y_km - c.y_km)) AS stored, n.distance_km AS fresh
FROM lc_near n JOIN lc_points p ON n.point_id = p.point_id JOIN lc_centers c ON c.k = n.k AND c.cluster = 0
WHERE n.k = 4 AND n.cluster = 1)
WHERE NOT abs(stored - fresh) <= greatest(1e-7 * greatest(stored, fresh), 2e-6)
UNION ALL """ + diff_sql("vf_cover", "lc_coverage", ["k", "radius_km"],
                         ["city_coverage", "demand_coverage", "weighted_distance_km"], table="coverage"))


def _sites_check(s, d):
    points, sites = cut_lineage(pl.points(s, d)), cut_lineage(pl.sites(s, d))
    stored = L.selected_plans(cut_lineage(L.evaluate_sites(points, sites, 3, pl.PLAN_RADII)))
    wrong = F.col("policy") == "max_city_coverage"
    stored = stored.withColumn("centers", F.when(wrong, F.concat(
        F.substring_index("centers", "|", 2), F.lit("|N99"))).otherwise(F.col("centers")))
    return V.recompute_sites(points, sites, 3, pl.PLAN_RADII, stored)


register("recompute_sites", DIFF, _sites_check, """
SELECT 'selected_plans' AS "table", policy || '|' || CAST(radius_km AS VARCHAR) || '|-1.0' AS key, 'centers' AS field, status,
  CAST(NULL AS DOUBLE) AS stored, CAST(NULL AS DOUBLE) AS fresh
FROM lc_max_city, LATERAL (VALUES ('differs'), ('unknown_site')) v(status)""")

# Customers -----------------------------------------------------------------------------------


def _segments_check(s, d):
    table = cut_lineage(ps.periods(s, d))
    ruled = cut_lineage(G.volume_terciles(G.standardize(table)))
    labels = ruled.select("period", "customer_id", F.when(F.col("recency_days") <= 90, 0).otherwise(1).alias("cluster"))
    labelled = cut_lineage(ruled.join(labels, ["period", "customer_id"]))
    rules = faulty(ruled, "volume_rule", F.col("orders") == 3, 1).select("period", "customer_id", "volume_rule")
    scores = faulty(G.silhouette(labelled.select("period", *ps.Z, "cluster"), ps.Z, ["period"]), "silhouette",
                    F.col("period") == "later", 0.01)
    profiles = faulty(G.segment_profiles(labelled, ["period"]), "customer_count", F.col("cluster") == 1, 1)
    ari = G.adjusted_rand(labelled, "cluster", "volume_rule", ["period"])
    return V.recompute_segments(table, rules, scores, profiles, ari, labels)


view("vs_points", "SELECT s.*, CASE WHEN recency_days <= 90 THEN 0 ELSE 1 END AS cluster FROM cs_scaled s")
view("vs_score", ps.silhouette_sql("vs_points", ["period"], "customer_id", ps.Z))
register("recompute_segments", DIFF, _segments_check, """
SELECT 'volume_rule' AS "table", period || '|' || customer_id AS key, 'volume_rule' AS field, 'differs' AS status,
  volume_refit + 1 AS stored, volume_refit AS fresh FROM cs_rule WHERE orders = 3
UNION ALL SELECT 'scores', period, 'silhouette', 'differs', silhouette + 0.01, silhouette FROM vs_score WHERE period = 'later'
UNION ALL SELECT 'profiles', period || '|1', 'customer_count', 'differs', count(*) + 1, count(*)
FROM vs_points WHERE cluster = 1 GROUP BY period""")

METHODS = ("centers_fixed", "volume_fixed", "volume_refit")


def _drift_tables(s, d):
    """Right labels and their measures; some labels, one customer of a seed and a summary value are then made wrong."""
    wide = cut_lineage(ps.with_rules(s, d))
    right = G.assignment_long(wide, list(METHODS))
    orders = wide.select("period", "customer_id", "orders")
    stored = right.join(orders, ["period", "customer_id"])
    swapped = (F.col("period") == "later") & (F.col("method") == "volume_fixed") & (F.col("orders") % 7 == 0)
    stored = (stored.where(~((F.col("method") == "centers_fixed") & (F.col("orders") == 11)))
              .withColumn("cluster", F.when(swapped, (F.col("cluster") + 1) % 3).otherwise(F.col("cluster"))).drop("orders"))
    metrics = G.labelled_drift(wide, ps.Z, "first", list(METHODS)).withColumn("k", F.lit(3))
    first = wide.where("period = 'first'")
    seeds = first.select("customer_id", F.inline(F.array(
        F.struct(F.lit(1).alias("seed"), ((F.col("centers_fixed") + 1) % 3).alias("cluster")),
        F.struct(F.lit(2).alias("seed"), F.when(F.col("orders") % 5 == 0, 0).otherwise(F.col("centers_fixed")).alias("cluster")))),
        "orders").where("NOT (seed = 2 AND orders = 9)").drop("orders")
    summary = s.createDataFrame([("single_initialization_minimum_ari", 2.0), ("first_customer_silhouette", 2.0),
                                 ("customer_fixed_model_time_ari", 2.0)], "name string, value double")
    return wide.select("period", "customer_id", *G.FEATURES), cut_lineage(stored), metrics, cut_lineage(seeds), summary


view("vt_long", """
SELECT l.period, l.customer_id, l.method, CASE WHEN l.period = 'later' AND l.method = 'volume_fixed' AND orders % 7 = 0
  THEN (l.cluster + 1) % 3 ELSE l.cluster END AS cluster
FROM cs_long l JOIN cs_rule r ON r.period = l.period AND r.customer_id = l.customer_id
WHERE NOT (l.method = 'centers_fixed' AND orders = 11)""")
view("vt_points", "SELECT l.period || '|' || l.method AS pm, l.customer_id, l.cluster, "
     + ", ".join(f"s.{z}" for z in ps.Z) + " FROM vt_long l JOIN cs_scaled_first s ON l.period = s.period AND l.customer_id = s.customer_id")
view("vt_sil", ps.silhouette_sql("vt_points", ["pm"], "customer_id", ps.Z))
view("vt_labels", """
SELECT l.period || '|' || l.method AS pm, l.cluster, f.cluster AS first_cluster
FROM vt_long l JOIN vt_long f ON f.period = 'first' AND f.method = l.method AND f.customer_id = l.customer_id""")
view("vt_ruled", """
SELECT l.period || '|' || l.method AS pm, l.cluster, r.cluster AS rule_cluster
FROM vt_long l JOIN vt_long r ON r.period = l.period AND r.method = 'volume_refit' AND r.customer_id = l.customer_id""")
view("vt_first", ps.ari_sql("vt_labels", "first_cluster", "cluster", ["pm"]))
view("vt_rule", ps.ari_sql("vt_ruled", "rule_cluster", "cluster", ["pm"]))
view("vt_fresh", """
SELECT split_part(s.pm, '|', 1) AS period, split_part(s.pm, '|', 2) AS method, k, s.silhouette,
  f.ari AS ari_to_first_period, r.ari AS ari_to_volume_refit
FROM vt_sil s JOIN vt_first f ON s.pm = f.pm JOIN vt_rule r ON s.pm = r.pm
JOIN (SELECT pm, count(DISTINCT cluster) AS k FROM vt_points GROUP BY pm) n ON n.pm = s.pm""")
view("vt_stored", """
SELECT split_part(s.pm, '|', 1) AS period, split_part(s.pm, '|', 2) AS method, 3 AS k, s.silhouette,
  f.ari AS ari_to_first_period, r.ari AS ari_to_volume_refit
FROM cs_drift_sil s JOIN cs_drift_first f ON s.pm = f.pm JOIN cs_drift_rule r ON s.pm = r.pm""")
view("vt_all", "SELECT period, customer_id, v.method, CASE v.method WHEN 'volume_fixed' THEN volume_fixed WHEN 'volume_refit' THEN volume_refit END AS cluster "
     "FROM cs_rule, LATERAL (VALUES ('centers_fixed'), ('volume_fixed'), ('volume_refit')) v(method)")
view("vt_seeds", """
SELECT v.seed, l.customer_id, l.cluster AS base, CASE v.seed WHEN 1 THEN (l.cluster + 1) % 3 ELSE CASE WHEN orders % 5 = 0 THEN 0 ELSE l.cluster END END AS cluster
FROM cs_long l JOIN cs_rule r ON r.period = 'first' AND r.customer_id = l.customer_id, LATERAL (VALUES (1), (2)) v(seed)
WHERE l.period = 'first' AND l.method = 'centers_fixed' AND NOT (v.seed = 2 AND orders = 9)""")
view("vt_seed_ari", ps.ari_sql("(SELECT * FROM vt_seeds WHERE customer_id IN (SELECT customer_id FROM vt_long WHERE period = 'first' "
                               "AND method = 'centers_fixed'))", "base", "cluster", ["seed"]))
view("vt_wrong", "SELECT * FROM (VALUES ('single_initialization_minimum_ari', 2.0), ('first_customer_silhouette', 2.0), "
     "('customer_fixed_model_time_ari', 2.0)) v(name, value)")
view("vt_summary", """
SELECT 'single_initialization_minimum_ari' AS name, min(ari) AS value FROM vt_seed_ari
UNION ALL SELECT 'first_customer_silhouette', silhouette FROM vt_fresh WHERE period = 'first' AND method = 'centers_fixed'
UNION ALL SELECT 'customer_fixed_model_time_ari', ari_to_first_period FROM vt_fresh WHERE period = 'later' AND method = 'centers_fixed'""")
KEYS = ["period", "customer_id", "method"]
register("recompute_drift", DIFF, lambda s, d: V.recompute_drift(*_drift_tables(s, d), "first", "centers_fixed", METHODS), " UNION ALL ".join([
    diff_sql("(SELECT * FROM vt_long WHERE method <> 'centers_fixed')", "(SELECT * FROM vt_all WHERE method <> 'centers_fixed')",
             KEYS, ["cluster"], table="assignments"),
    diff_sql("(SELECT * FROM vt_long WHERE method = 'centers_fixed')", "(SELECT * FROM vt_all WHERE method = 'centers_fixed')",
             KEYS, [], table="assignments"),
    diff_sql("vt_stored", "vt_fresh", ["period", "method"], ["k", "silhouette", "ari_to_first_period", "ari_to_volume_refit"], table="metrics"),
    diff_sql("vt_seeds", "(SELECT customer_id, v.seed FROM cs_rule, LATERAL (VALUES (1), (2)) v(seed) WHERE period = 'first')",
             ["seed", "customer_id"], [], table="seeds"),
    diff_sql("vt_wrong", "vt_summary", ["name"], ["value"], table="summary")]))

# Delivery time -------------------------------------------------------------------------------


def _pairs(s, d):
    """The hour method lost its records accepted at 05h."""
    rows = pt.predictions(s, d, numbered=True)
    return V.paired_methods_check(rows.where(~((F.col("method") == "hour_median") & (F.col("accept_hour") == 5))))


register("paired_methods_check", "window_start:d sample_index:i accept_hour:i accept_date:d actual_minutes:f only_in:s",
         _pairs, """
SELECT window_start, sample_index, accept_hour, accept_date, actual_minutes, 'global_median' AS only_in
FROM dl_test WHERE accept_hour = 5""")


def _duration_check(s, d):
    rows = cut_lineage(pt.predictions(s, d))
    metrics = faulty(T.duration_metrics(rows), "mae_minutes", F.col("method") == "hour_median", 0.5)
    diagnostics = T.duration_diagnostics(rows).where("group <> 'up_to_360'")
    return V.recompute_duration(rows, metrics, diagnostics, T.record_weighted_mae(T.duration_metrics(rows)))


register("recompute_duration", DIFF, _duration_check, """
SELECT 'duration_metrics' AS "table", window_start || '|' || method AS key, 'mae_minutes' AS field, 'differs' AS status,
  mae_minutes + 0.5 AS stored, mae_minutes AS fresh FROM dl_metrics WHERE method = 'hour_median'
UNION ALL SELECT DISTINCT 'duration_diagnostics', 'duration_band|up_to_360|' || method, NULL, 'missing',
  CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM dl_predictions WHERE actual_minutes <= 360""")



def _duration_tables(s, d):
    """A fault of each kind in the stored predictions and metrics."""
    rows = cut_lineage(pt.predictions(s, d, numbered=True))
    hour, day, index = F.col("accept_hour"), F.dayofmonth("accept_date"), F.col("sample_index")
    by_hour = F.col("method") == "hour_median"
    metrics = T.duration_metrics(rows).withColumn("window_end", F.date_add("window_start", pt.HORIZON - 1 + by_hour.cast("int")))
    metrics = faulty(metrics, "known_training_records", by_hour, 1)
    stored = (rows.withColumn("actual_minutes", F.when(hour == 3, float("nan")).otherwise(F.col("actual_minutes")))
              .withColumn("prediction_minutes", F.when(hour == 4, -1.0).otherwise(F.col("prediction_minutes")))
              .withColumn("accept_date", F.when(day == 9, F.date_sub("window_start", 1)).otherwise(F.col("accept_date")))
              .withColumn("sample_index", F.when((index == 1) & by_hour, 0).otherwise(index))
              .withColumn("accept_hour", F.when(hour == 6, 24).otherwise(hour)))
    return V.duration_tables_check(stored, metrics.where(~((F.col("method") == "global_median") & (F.dayofmonth("window_start") > 20))), pt.HORIZON)


view("vw_rows", """
SELECT *, window_start || '|' || method || '|' || CASE WHEN sample_index = 1 AND method = 'hour_median' THEN 0 ELSE sample_index END AS key
FROM dl_predictions""")
register("duration_tables_check", DIFF, _duration_tables, f"""
WITH m AS (SELECT * FROM dl_metrics WHERE NOT (method = 'global_median' AND day(window_start) > 20))
SELECT 'duration_predictions' AS "table", key, 'actual_minutes' AS field, 'not_finite' AS status, CAST(NULL AS DOUBLE) AS stored,
  CAST(NULL AS DOUBLE) AS fresh FROM vw_rows WHERE accept_hour = 3
UNION ALL SELECT 'duration_predictions', key, 'prediction_minutes', 'negative', -1, NULL FROM vw_rows WHERE accept_hour = 4
UNION ALL SELECT 'duration_predictions', key, 'accept_hour', 'not_an_hour', 24, NULL FROM vw_rows WHERE accept_hour = 6
UNION ALL SELECT 'duration_predictions', key, 'accept_date', 'outside_window', NULL, NULL FROM vw_rows WHERE day(accept_date) = 9
UNION ALL SELECT 'duration_predictions', key, 'sample_index', 'repeated', count(*), NULL FROM vw_rows GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'duration_metrics', window_start || '|' || method, 'window_end', 'wrong_end', NULL, NULL FROM m WHERE method = 'hour_median'
UNION ALL SELECT 'duration_metrics', CAST(window_start AS VARCHAR), 'known_training_records', 'unequal_training',
  max(known_training_records), max(known_training_records) + 1 FROM m GROUP BY window_start HAVING count(*) > 1
UNION ALL SELECT 'duration_metrics', window_start || '|' || method, 'method', 'missing_method', NULL, NULL FROM dl_metrics
WHERE method = 'global_median' AND day(window_start) > 20""")

# Claims and links ----------------------------------------------------------------------------


def _claims(s, d):
    """Each region and SKU total is a claim; some published numbers are wrong, missing or unknown."""
    totals = D.regional_summary(B.demand(s, d))
    result = totals.select(F.concat_ws("|", "region", "sku").alias("id"), "region", "sku",
                           F.col("total_quantity").alias("result_value"),
                           F.col("total_quantity").cast("bigint").cast("string").alias("text"))
    result = cut_lineage(result)
    claims = result.select("id", "sku", F.when(F.col("sku") == "Brand#11", F.col("result_value") + 1)
                           .otherwise(F.col("result_value")).alias("value"), F.col("text").alias("display_value"))
    published = result.select(F.when((F.col("region") == "ASIA") & (F.col("sku") == "Brand#22"), "ASIA|unknown")
                              .otherwise(F.col("id")).alias("id"),
                              F.when(F.col("region") == "EUROPE", F.concat("text", F.lit(".0")))
                              .otherwise(F.col("text")).alias("shown"))
    return V.claim_trace(claims, published, result.select("id", "result_value"))


register("claim_trace", "id:s status:s", _claims, """
WITH r AS (SELECT region, sku, region || '|' || sku AS id, sum(quantity) AS v FROM dm_demand GROUP BY 1, 2)
SELECT id, 'display_differs' AS status FROM r WHERE sku = 'Brand#11'
UNION ALL SELECT id, 'result_differs' FROM r WHERE sku = 'Brand#11'
UNION ALL SELECT id, 'shown_differs' FROM r WHERE region = 'EUROPE'
UNION ALL SELECT id, 'not_published' FROM r WHERE region = 'ASIA' AND sku = 'Brand#22'
UNION ALL SELECT 'ASIA|unknown', 'unregistered' FROM r WHERE region = 'ASIA' AND sku = 'Brand#22'""")


def _links(s, d):
    """Each region and SKU total links its region's file from a report one folder below; some links are wrong."""
    totals = D.regional_summary(B.demand(s, d)).select(F.concat_ws("|", "region", "sku").alias("id"), "region", "sku")
    totals = cut_lineage(totals.withColumn("file", F.concat(F.lit("results/"), F.translate("region", " ", "_"), F.lit("/sum.json"))))
    name = F.translate("region", " ", "_")
    target = (F.when(F.col("sku") == "Brand#11", F.concat(F.lit("../"), name, F.lit("/sum.json")))
              .when(F.col("sku") == "Brand#22", F.concat(F.lit("/results/"), name, F.lit("/sum.json")))
              .when(F.col("sku") == "Brand#33", F.concat(name, F.lit("/sum.json#total")))
              .otherwise(F.concat(F.lit("./x/../"), name, F.lit("/sum.json"))))
    link = F.when(F.col("sku") == "Brand#44", "sum.json").otherwise(F.concat(F.lit("[sum]("), target, F.lit(")")))
    published = totals.where("NOT (region = 'ASIA' AND sku = 'Brand#55')").select("id", link.alias("link"))
    return V.claim_links(totals.select("id", "file"), published, "results")


register("claim_links", "id:s status:s target:s", _links, """
WITH r AS (SELECT DISTINCT region, sku, region || '|' || sku AS id, replace(region, ' ', '_') AS name FROM dm_demand)
SELECT id, 'leads_elsewhere' AS status, '../' || name || '/sum.json' AS target FROM r WHERE sku = 'Brand#11'
UNION ALL SELECT id, 'not_relative', '/results/' || name || '/sum.json' FROM r WHERE sku = 'Brand#22'
UNION ALL SELECT id, 'not_relative', name || '/sum.json#total' FROM r WHERE sku = 'Brand#33'
UNION ALL SELECT id, 'not_a_link', '' FROM r WHERE sku = 'Brand#44'
UNION ALL SELECT id, 'not_published', NULL FROM r WHERE region = 'ASIA' AND sku = 'Brand#55'""")


def _evidence(s, d):
    """Each region's totals are one JSON document; some claims name another file, key, number or no kind."""
    totals = cut_lineage(D.regional_summary(B.demand(s, d)))
    documents = totals.groupBy(F.concat("region", F.lit(".json")).alias("file")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(
            "sku", F.col("total_quantity").cast("bigint"))) ).alias("total"))).alias("content"))
    asia = F.col("region") == "ASIA"
    claims = totals.select(
        F.concat_ws("|", "region", "sku").alias("id"),
        F.when(asia & (F.col("sku") == "Brand#22"), "gone.json").otherwise(F.concat("region", F.lit(".json"))).alias("file"),
        F.array(F.lit("total"), F.when(F.col("sku") == "Brand#33", "Brand").otherwise(F.col("sku"))).alias("keys"),
        (F.col("total_quantity") + F.when(F.col("sku") == "Brand#11", 1).otherwise(0)).alias("value"),
        F.when(F.col("region") != "EUROPE", "synthetic").alias("data_kind"))
    return V.claim_evidence(claims, documents)


register("claim_evidence", "id:s status:s", _evidence, """
WITH r AS (SELECT DISTINCT region, sku, region || '|' || sku AS id FROM dm_demand),
f AS (SELECT *, region = 'ASIA' AND sku = 'Brand#22' AS gone FROM r)
SELECT id, 'file_missing' AS status FROM f WHERE gone
UNION ALL SELECT id, 'keys_lead_nowhere' FROM f WHERE sku = 'Brand#33' AND NOT gone
UNION ALL SELECT id, 'evidence_differs' FROM f WHERE sku = 'Brand#11' AND NOT gone
UNION ALL SELECT id, 'kind_missing' FROM f WHERE region = 'EUROPE'""")


def attribute_sql(raw: str) -> str:
    """Quotes off, character references read once."""
    bare = f"""CASE WHEN regexp_matches({raw}, '^["'']') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"""
    body = r"regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);', 1)"
    code = (f"CASE WHEN regexp_matches({body}, '^#[xX]') THEN CAST('0x' || substr({body}, 3) AS BIGINT) "
            f"WHEN {body}[1] = '#' THEN CAST(substr({body}, 2) AS BIGINT) END")
    char = (f"CASE {body} WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '\"' WHEN 'apos' THEN chr(39) "
            f"ELSE CASE WHEN ({code}) > 0 AND ({code}) <= 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 "
            f"THEN chr(CAST({code} AS INTEGER)) END END")
    pieces = f"list_transform(string_split({bare}, '&')[2:], lambda p: coalesce({char} || substr(p, length({body}) + 2), '&' || p))"
    return f"trim(string_split({bare}, '&')[1] || coalesce(array_to_string({pieces}, ''), ''), ' ')"


def folder_sql(path: str) -> str:
    return f"coalesce(nullif(regexp_extract({path}, '^(.*/)[^/]*$', 1), ''), '/')"


SITE, SCHEME = "'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)'", "'^[A-Za-z][A-Za-z0-9+.-]*:'"
view("vl_pages", f"""
SELECT page_id, regexp_extract(url, {SITE}, 1) AS site, {folder_sql(f"regexp_replace(regexp_replace(url, '[?#].*$', ''), {SITE}, '')")} AS page,
  regexp_extract(html, '{V.BASE.replace("'", "''")}', 1) AS raw_base,
  regexp_extract_all(regexp_replace(html, '(?i)<base\\s[^>]*>', '', 'g'), '{V.LINK.replace("'", "''")}', 1) AS raws FROM pages""")
view("vl_based", f"SELECT page_id, site, page, raws, regexp_replace({attribute_sql('raw_base')}, '[?#].*$', '') AS base FROM vl_pages")
view("vl_links", f"""
SELECT page_id, site, CASE WHEN base = '' THEN page WHEN regexp_matches(base, {SCHEME}) OR base[1] = '/'
    THEN {folder_sql(f"regexp_replace(base, {SITE}, '')")} ELSE {folder_sql("(page || base)")} END AS folder, unnest(raws) AS raw
FROM vl_based WHERE base NOT LIKE '//%' AND (NOT regexp_matches(base, {SCHEME}) OR regexp_extract(base, {SITE}, 1) = site)""")
view("vl_paths", f"SELECT page_id, site, folder, regexp_replace({attribute_sql('raw')}, '[?#].*$', '') AS path FROM vl_links")
register("broken_links", "page_id:i target:s", lambda s, d: V.broken_links(B.table(s, d, "pages")), rf"""
SELECT DISTINCT page_id, target FROM (
  SELECT page_id, CASE WHEN regexp_matches(t, '^([^%]|%[0-9A-Fa-f]{{2}})*$') THEN url_decode(t) ELSE t END AS target FROM (
    SELECT page_id, site || array_to_string(list_reduce(
        list_transform(string_split(CASE WHEN path[1] = '/' THEN path ELSE folder || path END, '/'), lambda x: [x]),
        lambda a, b: CASE WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END
                          WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END), '/') AS t
    FROM vl_paths WHERE path <> '' AND path NOT LIKE '//%' AND NOT regexp_matches(path, {SCHEME})))
WHERE target NOT IN (SELECT CASE WHEN regexp_matches(p, '^([^%]|%[0-9A-Fa-f]{{2}})*$') THEN url_decode(p) ELSE p END
                     FROM (SELECT regexp_replace(url, '[?#].*$', '') AS p FROM pages))""")
