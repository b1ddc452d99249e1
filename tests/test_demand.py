import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import calendar as C, demand as D, verify as V

START = dt.date(2025, 1, 1)


def series(spark, values, name="s", start=START):
    rows = [(name, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, quantity double")


def wave(n, shift=0):
    return [100 + (i * 7 + shift) % 13 + 9 * (i % 7) + 0.5 * i for i in range(n)]


def test_error_measures_of_the_hand_example(spark):
    rows = [("s", 1, START, "m", a, p) for a, p in ((0.0, 0.0), (10.0, 0.0), (10.0, 20.0))]
    df = spark.createDataFrame(rows, "series_id string, cutoff int, date date, model string, actual double, prediction double")
    r = D.forecast_metrics(df).first()
    assert math.isclose(r.mae, 20 / 3) and math.isclose(r.rmse, math.sqrt(200 / 3))


def test_three_methods_equal_direct_formulas(spark):
    values = wave(60)
    wide = D.forecast_at_origin(D.origin_states(series(spark, values)), F.col("cutoff") == 56, 14)
    got = {r.step: r for r in wide.collect()}
    history = np.array(values[:56])
    wd = [(START + dt.timedelta(days=i)).weekday() for i in range(70)]
    x = np.array([[i, *np.eye(7)[wd[i]]] for i in range(70)], float)
    train = x[:56]
    xc, yc = train - train.mean(axis=0), history - history.mean()
    beta = np.linalg.solve(xc.T @ xc + 0.1 * np.eye(8), xc.T @ yc)
    for step, row in got.items():
        day = 55 + step
        same = [history[i] for i in range(28, 56) if wd[i] == wd[day]]
        assert math.isclose(row.recent_mean, history[-7:].mean())
        assert math.isclose(row.weekday_mean, np.mean(same))
        want = max(0.0, history.mean() + (x[day] - train.mean(axis=0)) @ beta)
        assert math.isclose(row.calendar_ridge, want, rel_tol=1e-10)


def test_later_days_cannot_change_a_forecast_or_a_choice(spark):
    values = wave(112)
    tail = values[70:]
    others = {"base": tail, "zeros": [0] * 42, "ramp": [1e4 * i for i in range(42)], "reversed": tail[::-1]}
    df = None
    for name, rest in others.items():
        one = series(spark, values[:70] + rest, name)
        df = one if df is None else df.unionByName(one)
    at = F.col("cutoff").isin(70, 77)
    seen = {}
    for r in D.long_forecasts(D.forecast_at_origin(D.origin_states(df), at)).collect():
        seen.setdefault((r.series_id, r.cutoff), set()).add((r.date, r.model, r.prediction))
    assert all(len(v) == 42 for v in seen.values())
    for name in ("zeros", "ramp", "reversed"):
        assert seen[name, 70] == seen["base", 70]
        assert seen[name, 77] != seen["base", 77]  # a leaking origin is noticed
    chosen = D.select_method(D.past_scores(df, origins=F.col("cutoff") == 70)).collect()
    assert len({(r.selected_model, r.past_mae_calendar_ridge) for r in chosen}) == 1 and len(chosen) == 4


def test_completed_windows_and_choice_boundaries(spark):
    s = series(spark, wave(69))
    cutoffs = {r.window_cutoff for r in D.completed_window_scores(s).select("window_cutoff").distinct().collect()}
    assert cutoffs == {28, 42}
    log = D.decision_log(series(spark, wave(112))).orderBy("cutoff").collect()
    assert [r.used_window_cutoffs for r in log] == ["28|42", "42|56", "56|70", "70|84"]
    assert all(r.latest_completed_window_end < r.decision_date for r in log)
    with pytest.raises(ValueError):
        D.past_scores(s, lookback=0)


def test_sequential_rows_follow_the_chosen_method(spark):
    s = series(spark, wave(84))
    rows = D.sequential_forecast(s)
    chosen = D.select_method(D.past_scores(s)).select("cutoff", F.col("selected_model").alias("c"))
    follows = rows.where("method = 'sequential_select'").join(chosen, "cutoff")
    assert follows.count() == 28 and follows.where("selected_model <> c").count() == 0


def test_two_series_equal_two_single_runs(spark):
    a, b = series(spark, wave(84), "a"), series(spark, wave(70, 5), "b", START + dt.timedelta(days=9))
    both = D.rolling_backtest(a.unionByName(b))
    single = D.rolling_backtest(a).unionByName(D.rolling_backtest(b))
    assert both.exceptAll(single).count() == 0 and both.count() == single.count() == 2 * 42 + 42


def test_broken_series_are_named_not_repaired(spark):
    gap = series(spark, wave(40), "gap").where(F.dayofmonth("date") != 9)
    neg = series(spark, [1.0] * 30 + [-1.0], "neg")
    ok, short = series(spark, wave(30), "ok"), series(spark, wave(9), "short")
    df = gap.unionByName(neg).unionByName(ok).unionByName(short)
    assert {r.series_id: r.reason for r in D.series_status(df).collect()} == {
        "gap": "calendar_gap", "neg": "bad_quantity", "ok": None, "short": "short_history"}
    assert [r.date for r in C.calendar_gaps(gap).orderBy("date").collect()] == [dt.date(2025, 1, 9)]
    assert C.longest_contiguous_block(gap).first().days == 30


def test_export_ignores_later_rows(spark):
    rows = series(spark, wave(60)).drop("series_id")
    later = rows.withColumn("quantity", F.when(F.col("date") >= "2025-02-15", 9e9).otherwise(F.col("quantity")))
    a, b = D.future_forecast_export(rows, "2025-02-15", 5), D.future_forecast_export(later, "2025-02-15", 5)
    assert a.count() == 15 and a.exceptAll(b).count() == 0


def test_overlay_keeps_the_past_and_rounds_half_to_even(spark):
    s = series(spark, [50.0] * 70)
    out = [r.quantity for r in D.scenario_overlay(s, 56, 2.0).orderBy("date").collect()]
    assert out[:56] == [50.0] * 56
    for i in range(56, 70):
        effect = D.WEEKLY_PATTERN[(START + dt.timedelta(days=i)).weekday()]
        assert out[i] == max(5, round(50 - 152 / 7 - 2 * (i - 55) + effect))


def test_recomputed_metrics_find_a_changed_actual(spark):
    s = series(spark, wave(84))
    rows = D.rolling_backtest(s)
    metrics = D.forecast_metrics(rows)
    board = D.method_leaderboard(metrics)
    assert V.recompute_metrics(s, rows, metrics, board).count() == 0
    assert V.window_shape_check(rows, 14, D.METHODS).count() == 0
    bad = rows.withColumn("actual", F.when(F.col("date") == "2025-03-01", 0.0).otherwise(F.col("actual")))
    tables = {r.table for r in V.recompute_metrics(s, bad, metrics, board).collect()}
    assert tables == {"predictions", "metrics", "leaderboard"}
    assert V.window_shape_check(rows.where("date <> '2025-03-01'"), 14, D.METHODS).count() == 3
