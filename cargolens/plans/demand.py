"""Registered demand queries. Series are the regions' longest contiguous blocks."""

from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import calendar as C, demand as D
from ..sources import bindings as B
from .registry import register, view

AS_OF = "2001-06-01"

view("dm_demand", """
SELECT CAST(l_shipdate AS DATE) AS date, r_name AS region, p_brand AS sku, sum(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
view("dm_daily", "SELECT region AS series_id, date, sum(quantity) AS quantity FROM dm_demand GROUP BY 1, 2")
view("dm_islands", """
SELECT series_id, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM (
  SELECT series_id, date, date - CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS island
  FROM dm_daily) GROUP BY series_id, island""")
view("dm_block", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY days DESC, start_date) AS r FROM dm_islands)
WHERE r = 1""")
view("dm_series", """
SELECT d.series_id, d.date, d.quantity FROM dm_daily d JOIN dm_block b
ON d.series_id = b.series_id AND d.date BETWEEN b.start_date AND b.end_date""")
view("dm_total", "SELECT 'total' AS series_id, date, sum(quantity) AS quantity FROM dm_demand GROUP BY date")


def forecast_views(prefix: str, series: str, horizon: int = 14) -> None:
    """SQL steps of the forecasts, built directly from each origin's own history rows."""
    h, p = horizon, prefix
    view(f"{p}_pos", f"""
    SELECT series_id, date, quantity, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos,
           count(*) OVER (PARTITION BY series_id) AS n_days FROM {series}""")
    # Origins at 28, 28+h, … and at the last day; 56, 70, … are among them.
    view(f"{p}_origins", f"""
    SELECT series_id, pos + 1 AS cutoff, date AS last_date, n_days FROM {p}_pos
    WHERE pos + 1 >= 28 AND ((pos + 1 - 28) % {h} = 0 OR pos + 1 = n_days OR (n_days - pos - 1) % {h} = 0)""")
    view(f"{p}_weekday", f"""
    SELECT o.series_id, o.cutoff, isodow(p.date) - 1 AS wd, CAST(count(*) AS DOUBLE) AS n, sum(p.quantity) AS y,
      CAST(sum(p.pos) AS DOUBLE) AS t, sum(p.pos * p.quantity) AS ty, CAST(sum(p.pos * p.pos) AS DOUBLE) AS tt,
      avg(p.quantity) FILTER (p.pos >= o.cutoff - 28) AS mean_28,
      sum(p.quantity) FILTER (p.pos >= o.cutoff - 7) AS sum_7
    FROM {p}_origins o JOIN {p}_pos p ON o.series_id = p.series_id AND p.pos < o.cutoff GROUP BY 1, 2, 3""")
    view(f"{p}_system", f"""
    SELECT series_id, cutoff, sum(sum_7) / 7 AS mean_7, sum(0.1 / (n + 0.1) * n) AS m11, sum(0.1 / (n + 0.1) * t) AS m12,
      sum(tt) - sum(t * t / (n + 0.1)) + 0.1 AS m22, sum(0.1 / (n + 0.1) * y) AS r1,
      sum(ty) - sum(t * y / (n + 0.1)) AS r2 FROM {p}_weekday GROUP BY 1, 2""")
    view(f"{p}_line", f"""
    SELECT series_id, cutoff, mean_7, (r1 * m22 - r2 * m12) / (m11 * m22 - m12 * m12) AS a,
      (r2 * m11 - r1 * m12) / (m11 * m22 - m12 * m12) AS b FROM {p}_system""")
    view(f"{p}_wide", f"""
    SELECT o.series_id, o.cutoff, o.last_date, o.n_days, o.last_date + CAST(step AS INTEGER) AS date, step,
      l.mean_7 AS recent_mean, w.mean_28 AS weekday_mean,
      greatest(0.0, l.a + l.b * (o.cutoff - 1 + step) + (w.y - w.n * l.a - w.t * l.b) / (w.n + 0.1)) AS calendar_ridge
    FROM {p}_origins o CROSS JOIN range(1, {h + 1}) s(step)
    JOIN {p}_line l ON l.series_id = o.series_id AND l.cutoff = o.cutoff
    JOIN {p}_weekday w ON w.series_id = o.series_id AND w.cutoff = o.cutoff
      AND w.wd = isodow(o.last_date + CAST(step AS INTEGER)) - 1""")
    view(f"{p}_long", f"""
    SELECT series_id, cutoff, n_days, date, 'recent_mean' AS model, 1 AS rank, recent_mean AS prediction FROM {p}_wide
    UNION ALL SELECT series_id, cutoff, n_days, date, 'weekday_mean', 2, weekday_mean FROM {p}_wide
    UNION ALL SELECT series_id, cutoff, n_days, date, 'calendar_ridge', 3, calendar_ridge FROM {p}_wide""")
    view(f"{p}_scored", f"""
    SELECT f.*, s.quantity AS actual FROM {p}_long f
    JOIN {series} s ON f.series_id = s.series_id AND f.date = s.date WHERE cutoff + {h} <= n_days""")
    view(f"{p}_all_metrics", f"""
    SELECT series_id, cutoff, model, rank, min(date) AS valid_start, max(date) AS valid_end, count(*) AS days,
      avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse
    FROM {p}_scored GROUP BY 1, 2, 3, 4""")


def decision_views(prefix: str, decisions: str, horizon: int = 14) -> None:
    """SQL steps of the choice by past windows; ``decisions`` filters the origins."""
    h, p = horizon, prefix
    view(f"{p}_decisions", f"""
    SELECT series_id, cutoff, last_date AS last_observed_date, last_date + 1 AS decision_date
    FROM {p}_origins WHERE {decisions}""")
    view(f"{p}_past", f"""
    SELECT * FROM (
      SELECT d.*, m.cutoff AS window_cutoff, m.valid_start AS window_start, m.valid_end AS window_end, m.model, m.rank,
        m.mae, m.valid_end + 1 AS known_at_date,
        dense_rank() OVER (PARTITION BY d.series_id, d.cutoff ORDER BY m.cutoff DESC) AS age
      FROM {p}_decisions d JOIN {p}_all_metrics m ON d.series_id = m.series_id AND m.cutoff + {h} <= d.cutoff
        AND (m.cutoff - 28) % {h} = 0) WHERE age <= 2""")
    view(f"{p}_choice", f"""
    SELECT series_id, cutoff, decision_date, last_observed_date,
      first(model ORDER BY past_mae, rank) AS selected_model,
      max(past_mae) FILTER (model = 'recent_mean') AS past_mae_recent_mean,
      max(past_mae) FILTER (model = 'weekday_mean') AS past_mae_weekday_mean,
      max(past_mae) FILTER (model = 'calendar_ridge') AS past_mae_calendar_ridge,
      max(window_end) AS latest_completed_window_end, max(used) AS used_window_cutoffs
    FROM (SELECT series_id, cutoff, decision_date, last_observed_date, model, rank, avg(mae) AS past_mae,
            max(window_end) AS window_end, string_agg(window_cutoff, '|' ORDER BY window_cutoff) AS used
          FROM {p}_past GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4""")
    view(f"{p}_sequential", f"""
    SELECT s.series_id, s.cutoff, s.date, s.model AS method, s.model AS selected_model, s.actual, s.prediction
    FROM {p}_scored s JOIN {p}_choice c ON s.series_id = c.series_id AND s.cutoff = c.cutoff
    UNION ALL
    SELECT s.series_id, s.cutoff, s.date, 'sequential_select', s.model, s.actual, s.prediction
    FROM {p}_scored s JOIN {p}_choice c ON s.series_id = c.series_id AND s.cutoff = c.cutoff
      AND s.model = c.selected_model""")


REGULAR = "cutoff >= 56 AND (cutoff - 56) % 14 = 0 AND cutoff + 14 <= n_days"
forecast_views("dm", "dm_series")
decision_views("dm", REGULAR)
view("dm_backtest", f"SELECT * FROM dm_scored WHERE {REGULAR}")
view("dm_metrics", "SELECT * FROM dm_all_metrics WHERE cutoff >= 56 AND (cutoff - 56) % 14 = 0")


def series(spark, folder):
    """One row for each region and day, written once: forecasts, actuals and choices all read it."""
    return cut_lineage(C.within_longest_block(cut_lineage(B.regional_daily(spark, folder))))


def _forecasts(spark, folder):
    wide = D.forecast_at_origin(D.origin_states(series(spark, folder)), D.regular_origins())
    return D.long_forecasts(wide)


def _one_method(model):
    return lambda s, d: _forecasts(s, d).where(F.col("model") == model)


def _metrics(spark, folder):
    return D.forecast_metrics(D.rolling_backtest(series(spark, folder)))


register("regional_summary", "region:s sku:s total_quantity:f mean_daily_quantity:f std_daily_quantity:f",
         lambda s, d: D.regional_summary(B.demand(s, d)), """
SELECT region, sku, sum(quantity) AS total_quantity, avg(quantity) AS mean_daily_quantity,
  stddev_samp(quantity) AS std_daily_quantity FROM dm_demand GROUP BY region, sku""")
register("daily_total", "series_id:s date:d quantity:f", lambda s, d: D.daily_total(B.demand(s, d)), "dm_total")
register("series_status", "series_id:s rows:i days:i first_date:d last_date:d reason:s",
         lambda s, d: D.series_status(B.regional_daily(s, d)), """
SELECT *, CASE WHEN days <> last_date - first_date + 1 THEN 'calendar_gap' WHEN bad > 0 THEN 'bad_quantity'
  WHEN days < 28 THEN 'short_history' END AS reason
FROM (SELECT series_id, count(*) AS rows, count(DISTINCT date) AS days, min(date) AS first_date,
  max(date) AS last_date, count(*) FILTER (quantity < 0) AS bad FROM dm_daily GROUP BY series_id)""")
register("calendar_features", "series_id:s date:d days_since_origin:i weekday:i is_future:b",
         lambda s, d: D.calendar_features(series(s, d)), """
SELECT series_id, date, date - min(date) OVER (PARTITION BY series_id) AS days_since_origin,
  isodow(date) - 1 AS weekday, is_future
FROM (SELECT series_id, date, false AS is_future FROM dm_series
      UNION ALL SELECT series_id, max(date) + CAST(step AS INTEGER), true
      FROM dm_series CROSS JOIN range(1, 15) r(step) GROUP BY series_id, step)""")
for _method in D.METHODS:
    register(f"forecast_{_method}", "series_id:s cutoff:i date:d prediction:f", _one_method(_method),
             f"SELECT * FROM dm_long WHERE {REGULAR} AND model = '{_method}'")
register("forecast_at_origin", "series_id:s cutoff:i date:d model:s prediction:f", _forecasts,
         f"SELECT * FROM dm_long WHERE {REGULAR}")
register("rolling_backtest", "series_id:s cutoff:i date:d model:s actual:f prediction:f",
         lambda s, d: D.rolling_backtest(series(s, d)), "dm_backtest")
register("forecast_metrics", "series_id:s cutoff:i model:s valid_start:d days:i mae:f rmse:f", _metrics, "dm_metrics")
register("method_leaderboard", "series_id:s model:s windows:i mean_mae:f mean_rmse:f",
         lambda s, d: D.method_leaderboard(_metrics(s, d)), """
SELECT series_id, model, count(*) AS windows, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse
FROM dm_metrics GROUP BY series_id, model""")
register("completed_window_scores", "series_id:s window_cutoff:i window_start:d window_end:d model:s mae:f",
         lambda s, d: D.completed_window_scores(series(s, d)), """
SELECT series_id, cutoff AS window_cutoff, valid_start AS window_start, valid_end AS window_end, model, mae
FROM dm_all_metrics WHERE (cutoff - 28) % 14 = 0""")
register("select_method", "series_id:s cutoff:i selected_model:s past_mae_recent_mean:f past_mae_weekday_mean:f "
         "past_mae_calendar_ridge:f", lambda s, d: D.select_method(D.past_scores(series(s, d))), "dm_choice")
register("sequential_forecast", "series_id:s cutoff:i date:d method:s selected_model:s actual:f prediction:f",
         lambda s, d: D.sequential_forecast(series(s, d)), "dm_sequential")
register("past_scores", "series_id:s cutoff:i decision_date:d window_cutoff:i window_start:d window_end:d "
         "known_at_date:d model:s mae:f", lambda s, d: D.past_scores(series(s, d)), "dm_past")
register("decision_log", "series_id:s cutoff:i decision_date:d last_observed_date:d used_window_cutoffs:s "
         "latest_completed_window_end:d selected_model:s past_mae_recent_mean:f past_mae_weekday_mean:f "
         "past_mae_calendar_ridge:f future_window_end:d future_mae_known_at_date:d future_mae:f",
         lambda s, d: D.decision_log(series(s, d)), """
SELECT c.*, m.valid_end AS future_window_end, m.valid_end + 1 AS future_mae_known_at_date, m.mae AS future_mae
FROM dm_choice c LEFT JOIN dm_all_metrics m
ON c.series_id = m.series_id AND c.cutoff = m.cutoff AND c.selected_model = m.model""")

# Scenario overlays on the national total.
view("sc_weekly", "SELECT * FROM (VALUES (0, 0.0), (1, 8.0), (2, 4.0), (3, 12.0), (4, 28.0), (5, 60.0), (6, 40.0)) v(wd, effect)")
view("sc_base", """
SELECT s.series_id, date, quantity, pos, effect FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM dm_series) s
JOIN sc_weekly ON wd = isodow(date) - 1""")
view("sc_decline", """
SELECT series_id, date, pos, effect, CASE WHEN pos < 56 THEN quantity ELSE greatest(5.0, round_even(
  avg(quantity) FILTER (pos BETWEEN 49 AND 55) OVER (PARTITION BY series_id) - CAST(152 AS DOUBLE) / 7
  - 2.0 * (pos - 55) + effect, 0)) END AS quantity FROM sc_base""")
view("sc_regrowth", """
SELECT series_id, date, CASE WHEN pos < 84 THEN quantity ELSE greatest(5.0, round_even(
  max(quantity - effect) FILTER (pos = 83) OVER (PARTITION BY series_id) + 3.0 * (pos - 83) + effect, 0)) END AS quantity
FROM sc_decline""")
view("sc_all", """
SELECT 'original' AS scenario, 'original|' || series_id AS series_id, date, quantity FROM dm_series
UNION ALL SELECT 'decline', 'decline|' || series_id, date, quantity FROM sc_decline
UNION ALL SELECT 'regrowth', 'regrowth|' || series_id, date, quantity FROM sc_regrowth""")
forecast_views("sc", "sc_all")


def _scenarios(spark, folder):
    return D.stress_scenarios(series(spark, folder))


def _scenario_metrics(spark, folder):
    metrics = D.forecast_metrics(D.rolling_backtest(_scenarios(spark, folder).drop("scenario")))
    return metrics.withColumn("scenario", F.substring_index("series_id", "|", 1))


register("scenario_overlay", "scenario:s series_id:s date:d quantity:f", _scenarios, "sc_all")
register("scenario_compare", "scenario:s recent_mean:f weekday_mean:f calendar_ridge:f best_method:s",
         lambda s, d: D.scenario_compare(_scenario_metrics(s, d)), """
SELECT scenario, max(mean_mae) FILTER (model = 'recent_mean') AS recent_mean,
  max(mean_mae) FILTER (model = 'weekday_mean') AS weekday_mean,
  max(mean_mae) FILTER (model = 'calendar_ridge') AS calendar_ridge,
  first(model ORDER BY mean_mae, rank) AS best_method
FROM (SELECT split_part(series_id, '|', 1) AS scenario, model, rank, avg(mae) AS mean_mae FROM sc_all_metrics
      WHERE cutoff >= 56 AND (cutoff - 56) % 14 = 0 GROUP BY 1, 2, 3) GROUP BY scenario""")

view("fx_history", f"SELECT * FROM dm_total WHERE date < DATE '{AS_OF}'")
view("fx_ok", f"""
SELECT h.* FROM fx_history h JOIN (SELECT series_id FROM fx_history GROUP BY series_id
  HAVING count(*) = max(date) - min(date) + 1 AND count(*) >= 28 AND min(quantity) >= 0
    AND max(date) = DATE '{AS_OF}' - 1) g ON h.series_id = g.series_id""")
forecast_views("fx", "fx_ok")
register("future_forecast_export", "series_id:s cutoff:i date:d model:s prediction:f",
         lambda s, d: D.future_forecast_export(B.demand(s, d), AS_OF),
         "SELECT * FROM fx_long WHERE cutoff = n_days")
