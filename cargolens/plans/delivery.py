"""Registered delivery-time queries: a click is accepted, the next purchase completes it."""

from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import calendar as C, contracts as K, delivery as T, demand as D
from ..sources import bindings as B
from .demand import decision_views, forecast_views
from .registry import register, view

#: The last window still waits for labels at the end of the observation; the first two are complete.
STARTS = ["2024-01-05", "2024-01-12", "2024-01-24"]
HORIZON = 7
OBSERVED = "2024-01-26"
OBSERVED_LABELS = "2024-01-30"

view("dl_done", """
SELECT *, date_sub('second', accept_time, delivery_time) / 60.0 AS minutes FROM dl_clicks
WHERE delivery_time IS NOT NULL""")
view("dl_windows", "SELECT CAST(d AS DATE) AS window_start FROM (VALUES "
     + ", ".join(f"('{s}')" for s in STARTS) + ") v(d)")
view("dl_daily", "SELECT CAST(delivery_time AS DATE) AS date, count(*) AS quantity FROM dl_done GROUP BY 1")
view("dl_history", """
SELECT window_start, r.*, hour(accept_time) AS accept_hour FROM dl_windows JOIN dl_done r
ON accept_time < window_start AND delivery_time < window_start""")
view("dl_global", """
SELECT window_start, count(*) AS known_training_records, median(minutes) AS global_median
FROM dl_history GROUP BY window_start""")
view("dl_hours", """
SELECT g.window_start, h.hr AS accept_hour, known_training_records, global_median,
  coalesce(m.n, 0) AS hour_records, coalesce(CASE WHEN m.n >= 30 THEN m.med END, global_median) AS hour_median
FROM dl_global g CROSS JOIN range(0, 24) h(hr) LEFT JOIN (
  SELECT window_start, accept_hour, count(*) AS n, median(minutes) AS med FROM dl_history GROUP BY 1, 2) m
ON m.window_start = g.window_start AND m.accept_hour = h.hr""")
view("dl_test", f"""
SELECT window_start, order_id, accept_time, hour(accept_time) AS accept_hour, CAST(accept_time AS DATE) AS accept_date,
  minutes AS actual_minutes,
  row_number() OVER (PARTITION BY window_start ORDER BY accept_time, order_id) - 1 AS sample_index
FROM (SELECT window_start FROM dl_maturity WHERE pending_records = 0) JOIN dl_done
ON accept_time >= window_start AND accept_time < window_start + INTERVAL {HORIZON} DAY""")
view("dl_predictions", """
SELECT t.*, h.known_training_records, v.method, v.prediction_minutes
FROM dl_test t JOIN dl_hours h ON t.window_start = h.window_start AND t.accept_hour = h.accept_hour,
LATERAL (VALUES ('global_median', h.global_median), ('hour_median', h.hour_median)) v(method, prediction_minutes)""")
view("dl_metrics", """
SELECT window_start, method, max(known_training_records) AS known_training_records, count(*) AS test_records,
  avg(abs(actual_minutes - prediction_minutes)) AS mae_minutes,
  count(*) FILTER (actual_minutes > 360) AS records_over_360_minutes,
  avg(abs(actual_minutes - prediction_minutes)) FILTER (actual_minutes > 360) AS mae_over_360_minutes
FROM dl_predictions GROUP BY window_start, method""")
view("dl_overall", """
SELECT method, count(*) AS test_records, avg(abs(actual_minutes - prediction_minutes)) AS mae_minutes
FROM dl_predictions GROUP BY method""")
view("dl_maturity", f"""
SELECT w.window_start, w.window_start + {HORIZON - 1} AS window_end, count(order_id) AS accepted_records,
  count(order_id) FILTER (NOT pending) AS mature_records, count(order_id) FILTER (pending) AS pending_records,
  count(order_id) FILTER (pending) = 0 AS all_labels_mature,
  CASE WHEN count(order_id) = count(delivery_time) THEN max(delivery_time) END AS all_test_labels_known_after
FROM dl_windows w LEFT JOIN (
  SELECT *, delivery_time IS NULL OR delivery_time >= DATE '{OBSERVED_LABELS}' + 1 AS pending FROM dl_clicks) r
ON accept_time >= window_start AND accept_time < window_start + INTERVAL {HORIZON} DAY GROUP BY w.window_start""")
view("dl_ship", """
SELECT l_orderkey AS order_id, l_linenumber AS line, o_orderdate AS accept_time, l_shipdate AS delivery_time,
  date_sub('second', o_orderdate, l_shipdate) / 60.0 AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
view("oc_daily", "SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS quantity "
     "FROM orders GROUP BY 2")
view("oc_islands", """
SELECT series_id, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM (
  SELECT series_id, date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM oc_daily)
GROUP BY series_id, island""")
view("oc_block", "SELECT * FROM oc_islands ORDER BY days DESC, start_date LIMIT 1")
view("vb_series", """
SELECT d.* FROM oc_daily d JOIN oc_block b ON d.date BETWEEN b.start_date AND b.end_date WHERE b.days >= 28 + 14 * 5""")
forecast_views("vb", "vb_series")
decision_views("vb", "(n_days - cutoff) % 14 = 0 AND n_days - cutoff BETWEEN 14 AND 56")


def clicks(spark, folder):
    return B.click_to_purchase(spark, folder)


def completed(spark, folder):
    return T.duration_minutes(T.completed_asof(clicks(spark, folder), None))


def stored(spark, folder):
    """The completed records written once: the medians and the scores read them several times."""
    return cut_lineage(completed(spark, folder))


def order_block(spark, folder):
    return cut_lineage(C.within_longest_block(cut_lineage(B.order_counts_daily(spark, folder))))


def predictions(spark, folder, numbered=False):
    records = cut_lineage(T.duration_minutes(clicks(spark, folder)))
    return T.duration_predictions(records, STARTS, HORIZON, OBSERVED_LABELS, numbered=numbered)


def _raw_text(spark, folder):
    """The records as text without a year, the form delivery files come in."""
    done = T.completed_asof(clicks(spark, folder), None)
    return done.select("order_id", "ds", *[F.date_format(c, "MM-dd HH:mm:ss").alias(c)
                                           for c in ("accept_time", "delivery_time")])


def _with_ds(spark, folder):
    return cut_lineage(clicks(spark, folder).withColumn("ds", F.to_date("accept_time")))


def _volume_metrics(spark, folder):
    rows = T.volume_backtest(order_block(spark, folder))
    return D.method_leaderboard(D.forecast_metrics(rows, "method"), "method")


register("parse_delivery_times", "order_id:i ds:d accept_time:t delivery_time:t",
         lambda s, d: T.parse_delivery_times(_raw_text(s, d), 2024),
         "SELECT order_id, CAST(accept_time AS DATE) AS ds, accept_time, delivery_time FROM dl_done")
register("unparsed_times", "order_id:i field:s text:s",
         # Read with the year before the leap year, where 29 February does not exist.
         lambda s, d: T.unparsed_times(_shifted_text(s, d), 2023), """
SELECT order_id, field, '2023-02-' || strftime(t, '%d %H:%M:%S') AS text FROM dl_done,
LATERAL (VALUES ('accept_time', accept_time), ('delivery_time', delivery_time)) v(field, t)
WHERE day(t) > 28""")


def _shifted_text(spark, folder):
    done = T.completed_asof(clicks(spark, folder), None)
    return done.select("order_id", F.lit("228").alias("ds"),
                       *[F.concat(F.lit("02-"), F.date_format(c, "dd HH:mm:ss")).alias(c)
                         for c in ("accept_time", "delivery_time")])


register("duration_minutes", "order_id:i minutes:f", completed, "dl_done")
register("negative_duration", "order_id:i line:i minutes:f",
         lambda s, d: K.negative_duration(T.duration_minutes(B.order_shipments(s, d))),
         "SELECT * FROM dl_ship WHERE minutes < 0")
register("completed_asof", "order_id:i delivery_time:t", lambda s, d: T.completed_asof(clicks(s, d), OBSERVED),
         f"SELECT * FROM dl_done WHERE delivery_time < DATE '{OBSERVED}' + 1")
register("daily_completions", "date:d quantity:i",
         lambda s, d: T.daily_completions(completed(s, d)), "SELECT * FROM dl_daily")
register("longest_contiguous_block", "series_id:s start_date:d end_date:d days:i",
         lambda s, d: C.longest_contiguous_block(B.order_counts_daily(s, d)), "SELECT * FROM oc_block")
register("backtest_window_starts", "series_id:s cutoff:i window_start:d window_end:d",
         lambda s, d: T.backtest_window_starts(C.longest_contiguous_block(B.order_counts_daily(s, d)), 4, 14), """
SELECT series_id, days - 14 * i AS cutoff, start_date + CAST(days - 14 * i AS INTEGER) AS window_start,
  start_date + CAST(days - 14 * i + 13 AS INTEGER) AS window_end
FROM oc_block CROSS JOIN range(1, 5) r(i) WHERE days >= 28 + 14 * 5""")
register("data_audit", "metric:s value:s", lambda s, d: T.data_audit(_with_ds(s, d), OBSERVED), f"""
WITH r AS (SELECT *, CAST(accept_time AS DATE) AS day FROM dl_clicks),
o AS (SELECT * FROM r WHERE delivery_time < DATE '{OBSERVED}' + 1),
d AS (SELECT DISTINCT CAST(delivery_time AS DATE) AS date FROM o),
b AS (SELECT min(date) AS a, max(date) AS z, count(*) AS n FROM (
  SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS k FROM d) GROUP BY k ORDER BY n DESC, a LIMIT 1)
SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM r
UNION ALL SELECT 'unique_orders', CAST(count(DISTINCT order_id) AS VARCHAR) FROM r
UNION ALL SELECT 'ds_days', CAST(count(DISTINCT day) AS VARCHAR) FROM r
UNION ALL SELECT 'null_ds', '0'
UNION ALL SELECT 'null_accept_time', '0'
UNION ALL SELECT 'null_delivery_time', CAST(count(*) FILTER (delivery_time IS NULL) AS VARCHAR) FROM r
UNION ALL SELECT 'observed_completed_rows', CAST(count(*) AS VARCHAR) FROM o
UNION ALL SELECT 'ds_finish_day_disagreements', CAST(count(*) FILTER (day <> CAST(delivery_time AS DATE)) AS VARCHAR) FROM o
UNION ALL SELECT 'ds_accept_day_disagreements', '0'
UNION ALL SELECT 'missing_dates', CAST(max(date) - min(date) + 1 - count(*) AS VARCHAR) FROM d
UNION ALL SELECT 'block_start', CAST(a AS VARCHAR) FROM b
UNION ALL SELECT 'block_end', CAST(z AS VARCHAR) FROM b
UNION ALL SELECT 'block_days', CAST(n AS VARCHAR) FROM b""")
register("duration_quantiles", "fraction:f minutes:f", lambda s, d: T.duration_quantiles(stored(s, d)),
         " UNION ALL ".join(f"SELECT {f} AS fraction, quantile_cont(minutes, {f}) AS minutes FROM dl_done"
                            for f in ("0.0", "0.5", "0.9", "0.99", "1.0")))
register("label_maturity", "window_start:d window_end:d accepted_records:i mature_records:i pending_records:i "
         "all_labels_mature:b all_test_labels_known_after:t",
         lambda s, d: T.label_maturity(clicks(s, d), STARTS, HORIZON, OBSERVED_LABELS), "dl_maturity")
register("maturity_gate", "window_start:d accepted_records:i pending_records:i",
         lambda s, d: T.maturity_gate(T.label_maturity(clicks(s, d), STARTS, HORIZON, OBSERVED_LABELS)),
         "SELECT * FROM dl_maturity WHERE pending_records > 0")
register("score_status", "window_start:d accepted_records:i pending_records:i status:s",
         lambda s, d: T.score_status(T.duration_minutes(clicks(s, d)), STARTS, HORIZON, OBSERVED_LABELS), """
SELECT window_start, accepted_records, pending_records, CASE WHEN accepted_records = 0 THEN 'no test records'
  WHEN pending_records > 0 THEN 'labels pending' WHEN window_start NOT IN (SELECT window_start FROM dl_history)
  THEN 'no mature history' ELSE 'scored' END AS status FROM dl_maturity""")
register("mature_history", "window_start:d order_id:i minutes:f",
         lambda s, d: T.mature_history(completed(s, d), STARTS), "dl_history")
register("duration_global_median", "window_start:d known_training_records:i global_median:f",
         lambda s, d: T.duration_global_median(stored(s, d), STARTS), "dl_global")
register("duration_hour_median", "window_start:d accept_hour:i hour_records:i hour_median:f",
         lambda s, d: T.duration_hour_median(stored(s, d), STARTS), "dl_hours")
register("duration_predictions", "window_start:d method:s sample_index:i accept_hour:i accept_date:d "
         "actual_minutes:f prediction_minutes:f", lambda s, d: predictions(s, d, True), "dl_predictions")
register("duration_metrics", "window_start:d method:s known_training_records:i test_records:i mae_minutes:f "
         "records_over_360_minutes:i mae_over_360_minutes:f",
         lambda s, d: T.duration_metrics(predictions(s, d)), "dl_metrics")
register("record_weighted_mae", "method:s test_records:i mae_minutes:f",
         lambda s, d: T.record_weighted_mae(T.duration_metrics(predictions(s, d))), "dl_overall")
register("duration_diagnostics", "by:s group:s method:s test_records:i mae_minutes:f",
         lambda s, d: T.duration_diagnostics(predictions(s, d)), """
SELECT v."by", v."group", method, count(*) AS test_records, avg(abs(actual_minutes - prediction_minutes)) AS mae_minutes
FROM dl_predictions, LATERAL (VALUES ('accept_hour', CAST(accept_hour AS VARCHAR)),
  ('accept_date', CAST(accept_date AS VARCHAR)),
  ('duration_band', CASE WHEN actual_minutes > 360 THEN 'over_360' ELSE 'up_to_360' END)) v("by", "group")
GROUP BY 1, 2, 3""")
register("volume_backtest", "series_id:s cutoff:i date:d method:s selected_model:s actual:f prediction:f",
         lambda s, d: T.volume_backtest(order_block(s, d)), "vb_sequential")
register("volume_choices", "cutoff:i decision_date:d last_observed_date:d latest_completed_window_end:d "
         "selected_model:s past_mae_recent_mean:f past_mae_weekday_mean:f past_mae_calendar_ridge:f",
         lambda s, d: T.volume_choices(order_block(s, d)), "vb_choice")
register("volume_leaderboard", "method:s windows:i mean_mae:f mean_rmse:f", _volume_metrics, """
SELECT method, count(*) AS windows, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse FROM (
  SELECT cutoff, method, avg(abs(actual - prediction)) AS mae,
    sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse FROM vb_sequential GROUP BY 1, 2) GROUP BY method""")
register("improvement_pct", "global_median:f hour_median:f improvement_pct:f",
         lambda s, d: T.improvement_pct(T.record_weighted_mae(T.duration_metrics(predictions(s, d)))), """
SELECT g AS global_median, h AS hour_median, 100 * (g - h) / nullif(g, 0) AS improvement_pct FROM (
  SELECT max(mae_minutes) FILTER (method = 'global_median') AS g, max(mae_minutes) FILTER (method = 'hour_median') AS h
  FROM dl_overall)""")
register("tail_mae", "method:s tail_records:i tail_mae_minutes:f", lambda s, d: T.tail_mae(predictions(s, d)), """
SELECT method, count(*) FILTER (actual_minutes > 360) AS tail_records,
  avg(abs(actual_minutes - prediction_minutes)) FILTER (actual_minutes > 360) AS tail_mae_minutes
FROM dl_predictions GROUP BY method""")
register("gap_preserving_calendar", "date:d quantity:f",
         lambda s, d: C.gap_preserving_calendar(B.order_counts_daily(s, d)), """
SELECT c.date, quantity FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
  FROM oc_daily) c LEFT JOIN oc_daily d ON c.date = d.date""")
