"""Rolling-origin demand forecasts that only use days before each origin.

A series is ``series_id, date, quantity`` with one row for each calendar day. Everything an
origin may know is a running sum over its own series, so one window pass gives the state after
every day and any set of origins is a filter on that state: no refit, no loop over windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import is_finite, melt
from ..functions.scale import cut_lineage

# Fixed method names; the order breaks ties between equal scores.
METHODS = ("recent_mean", "weekday_mean", "calendar_ridge")
MIN_HISTORY = 28
RIDGE_ALPHA = 0.1
WEEKDAYS = range(7)
# Fixed weekly pattern of the stress scenarios, Monday first.
WEEKLY_PATTERN = (0, 8, 4, 12, 28, 60, 40)


def regional_summary(demand: DataFrame, groups: tuple[str, ...] = ("region", "sku")) -> DataFrame:
    """Total, mean and sample standard deviation of the daily quantity."""
    return demand.groupBy(*groups).agg(
        F.sum("quantity").alias("total_quantity"), F.avg("quantity").alias("mean_daily_quantity"),
        F.stddev_samp("quantity").alias("std_daily_quantity"))


def daily_total(demand: DataFrame, series: Column | None = None) -> DataFrame:
    """Collapse a demand table to daily series; one series when no key is given."""
    key = (F.lit("total") if series is None else series).alias("series_id")
    return demand.groupBy(key, "date").agg(F.sum("quantity").alias("quantity"))


def series_status(series: DataFrame, min_days: int = MIN_HISTORY) -> DataFrame:
    """One row for each series with the first broken rule, or null when it can be forecast."""
    stats = series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("days"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(F.col("quantity").isNull() | ~is_finite("quantity") | (F.col("quantity") < 0)).alias("bad"))
    reason = (F.when(F.col("rows") != F.col("days"), "duplicate_date")
              .when(F.col("days") != F.date_diff("last_date", "first_date") + 1, "calendar_gap")
              .when(F.col("bad") > 0, "bad_quantity")
              .when(F.col("days") < min_days, "short_history"))
    return stats.withColumn("reason", reason)


def usable_series(series: DataFrame, min_days: int = MIN_HISTORY) -> DataFrame:
    """The series which meet every rule; ``series_status`` lists the others with the reason.

    Every row looks at its own series (one row a day), so nothing is joined back.
    """
    whole = Window.partitionBy("series_id")
    step = F.date_diff("date", F.lag("date", 1).over(whole.orderBy("date")))
    bad = F.col("quantity").isNull() | ~is_finite("quantity") | (F.col("quantity") < 0)
    marked = series.withColumn("_bad", F.coalesce(step != 1, F.lit(False)) | bad)
    checked = (marked.withColumn("_any", F.max(F.col("_bad").cast("int")).over(whole))
               .withColumn("_days", F.count(F.lit(1)).over(whole)))
    return checked.where((F.col("_any") == 0) & (F.col("_days") >= min_days)).select(*series.columns)


def positions(series: DataFrame) -> DataFrame:
    """Add pos (0-based day), n_days and first_date; one row a day keeps each window small."""
    whole = Window.partitionBy("series_id")
    return (series
            .withColumn("pos", F.row_number().over(whole.orderBy("date")) - 1)
            .withColumn("n_days", F.count(F.lit(1)).over(whole))
            .withColumn("first_date", F.min("date").over(whole)))


def calendar_features(series: DataFrame, horizon: int = 14) -> DataFrame:
    """Days since the first day and weekday (Monday 0) of every history and future date."""
    placed = positions(series)
    future = (placed.where(F.col("pos") == F.col("n_days") - 1)
              .select("series_id", "first_date",
                      F.explode(F.expr(f"sequence(date_add(date, 1), date_add(date, {int(horizon)}))")).alias("date"),
                      F.lit(True).alias("is_future")))
    history = placed.select("series_id", "first_date", "date", F.lit(False).alias("is_future"))
    return history.unionByName(future).select(
        "series_id", "date", F.date_diff("date", "first_date").alias("days_since_origin"),
        F.weekday("date").alias("weekday"), "is_future")


def origin_states(series: DataFrame) -> DataFrame:
    """What is known after each day: cutoff = number of observed days, plus the running sums."""
    placed = positions(series)
    order = Window.partitionBy("series_id").orderBy("date")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    week, month = order.rowsBetween(-6, 0), order.rowsBetween(-27, 0)
    y, t, d = F.col("quantity"), F.col("pos").cast("double"), F.weekday("date")

    def each_weekday(value: Column, frame) -> Column:
        return F.array(*[F.sum(F.when(d == k, value).otherwise(0.0)).over(frame) for k in WEEKDAYS])

    return placed.select(
        "series_id", "first_date", F.col("date").alias("last_date"), "n_days",
        (F.col("pos") + 1).alias("cutoff"),
        F.avg(y).over(week).alias("mean_7"),
        each_weekday(y, month).alias("sum_28"), each_weekday(F.lit(1.0), month).alias("count_28"),
        each_weekday(F.lit(1.0), past).alias("n_w"), each_weekday(y, past).alias("y_w"),
        each_weekday(t, past).alias("t_w"),
        F.sum(t * y).over(past).alias("s_ty"), F.sum(t * t).over(past).alias("s_tt"))


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def _ridge(states: DataFrame) -> DataFrame:
    """Closed form of ridge regression on (t, seven weekday flags) with a free intercept.

    Eliminating the weekday effects leaves a symmetric 2x2 system in intercept and slope.
    """
    n, y, t = ([F.col(c)[k] for k in WEEKDAYS] for c in ("n_w", "y_w", "t_w"))
    a = F.lit(RIDGE_ALPHA)
    g = [F.lit(1.0) / (n[k] + a) for k in WEEKDAYS]
    m = states.select(
        "*",
        _total([a * g[k] * n[k] for k in WEEKDAYS]).alias("m11"),
        _total([a * g[k] * t[k] for k in WEEKDAYS]).alias("m12"),
        (F.col("s_tt") - _total([t[k] * t[k] * g[k] for k in WEEKDAYS]) + a).alias("m22"),
        _total([a * g[k] * y[k] for k in WEEKDAYS]).alias("r1"),
        (F.col("s_ty") - _total([t[k] * y[k] * g[k] for k in WEEKDAYS])).alias("r2"))
    det = F.col("m11") * F.col("m22") - F.col("m12") * F.col("m12")
    m = (m.withColumn("intercept", (F.col("r1") * F.col("m22") - F.col("r2") * F.col("m12")) / det)
         .withColumn("slope", (F.col("r2") * F.col("m11") - F.col("r1") * F.col("m12")) / det))
    effect = F.array(*[(y[k] - n[k] * F.col("intercept") - t[k] * F.col("slope")) * g[k] for k in WEEKDAYS])
    return m.withColumn("weekday_effect", effect).drop("m11", "m12", "m22", "r1", "r2")


def regular_origins(horizon: int = 14, first: int = 56, complete: bool = True) -> Column:
    """Origins first, first+horizon, … ; with ``complete`` the whole window lies in the history."""
    inside = F.col("cutoff") + horizon <= F.col("n_days") if complete else F.col("cutoff") <= F.col("n_days")
    return (F.col("cutoff") >= first) & ((F.col("cutoff") - first) % horizon == 0) & inside


def last_origin() -> Column:
    return F.col("cutoff") == F.col("n_days")


def forecast_at_origin(states: DataFrame, origins: Column, horizon: int = 14) -> DataFrame:
    """Wide forecasts (one column for each method) of the chosen origins.

    Future dates come from the calendar after the last observed day, never from future rows.
    Origins with fewer than 28 observed days are refused by the filter.
    """
    chosen = _ridge(states.where((F.col("cutoff") >= MIN_HISTORY) & origins))
    ahead = chosen.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    ahead = (ahead.withColumn("date", F.expr("date_add(last_date, step)"))
             .withColumn("wd", F.weekday("date")))
    t = (F.col("cutoff") - 1 + F.col("step")).cast("double")
    ridge = F.col("intercept") + F.col("slope") * t + F.get("weekday_effect", F.col("wd"))
    return ahead.select(
        "series_id", "cutoff", "last_date", "n_days", "date", "step",
        F.col("mean_7").alias(METHODS[0]),
        (F.get("sum_28", F.col("wd")) / F.get("count_28", F.col("wd"))).alias(METHODS[1]),
        F.greatest(F.lit(0.0), ridge).alias(METHODS[2]))


def long_forecasts(wide: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return melt(wide, ["series_id", "cutoff", "date", *extra], {m: m for m in METHODS}, "model", "prediction")


def rolling_backtest(series: DataFrame, horizon: int = 14, first: int = 56,
                     origins: Column | None = None, states: DataFrame | None = None) -> DataFrame:
    """Every origin's forecasts of all methods next to the later actual value.

    ``states`` are the series' ``origin_states``, if the caller has them already.
    """
    origins = regular_origins(horizon, first) if origins is None else origins
    wide = forecast_at_origin(origin_states(series) if states is None else states, origins, horizon)
    actual = series.select("series_id", "date", F.col("quantity").alias("actual"))
    return long_forecasts(wide.join(actual, ["series_id", "date"]), ("actual",))


def forecast_metrics(predictions: DataFrame, method: str = "model",
                     window: tuple[str, ...] = ("series_id", "cutoff")) -> DataFrame:
    """MAE and RMSE of each window and method."""
    e = F.col("actual") - F.col("prediction")
    return predictions.groupBy(*window, method).agg(
        F.min("date").alias("valid_start"), F.max("date").alias("valid_end"),
        F.count(F.lit(1)).alias("days"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"))


def method_leaderboard(metrics: DataFrame, method: str = "model",
                       groups: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Unweighted mean over windows: every window counts the same."""
    return metrics.groupBy(*groups, method).agg(
        F.count(F.lit(1)).alias("windows"), F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"))


def completed_window_scores(series: DataFrame, horizon: int = 14, states: DataFrame | None = None) -> DataFrame:
    """MAE of the windows that start at day 28, 28+h, … and ended inside the history."""
    scored = forecast_metrics(rolling_backtest(series, horizon, MIN_HISTORY, states=states))
    return scored.select("series_id", F.col("cutoff").alias("window_cutoff"),
                         F.col("valid_start").alias("window_start"), F.col("valid_end").alias("window_end"),
                         "model", "mae")


def past_scores(series: DataFrame, horizon: int = 14, lookback: int = 2,
                origins: Column | None = None, first: int = 56, states: DataFrame | None = None) -> DataFrame:
    """The last completed windows each decision may use, with the day their score is known.

    Windows are anchored at day 28, so the ones a decision at ``cutoff`` uses follow from
    arithmetic and the join is an equi-join.
    """
    if lookback < 1:
        raise ValueError("at least one completed window is needed")
    origins = regular_origins(horizon, first) if origins is None else origins
    decisions = (positions(series).withColumn("cutoff", F.col("pos") + 1)
                 .where(origins)
                 .select("series_id", "cutoff", F.col("date").alias("last_observed_date"),
                         F.date_add("date", 1).alias("decision_date")))
    newest = F.floor((F.col("cutoff") - horizon - MIN_HISTORY) / horizon)
    used = F.array(*[newest - i for i in range(lookback)])
    wanted = (decisions.withColumn("j", F.explode(used)).where(F.col("j") >= 0)
              .withColumn("window_cutoff", (F.lit(MIN_HISTORY) + F.col("j") * horizon).cast("bigint")).drop("j"))
    scores = completed_window_scores(series, horizon, states).withColumn(
        "window_cutoff", F.col("window_cutoff").cast("bigint"))
    return (wanted.join(scores, ["series_id", "window_cutoff"])
            .withColumn("known_at_date", F.date_add("window_end", 1)))


def known_too_late(scores: DataFrame) -> DataFrame:
    """Violations: a used score that was not yet known on the decision date."""
    return scores.where(F.col("known_at_date") > F.col("decision_date"))


def _rank(model: str = "model") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col(model))


def select_method(scores: DataFrame) -> DataFrame:
    """Method with the least mean past MAE for each decision; ties follow the method order."""
    keys = ["series_id", "cutoff", "decision_date", "last_observed_date"]
    windows = scores.groupBy(*keys, "model").agg(
        F.avg("mae").alias("past_mae"), F.max("window_end").alias("window_end"),
        F.array_sort(F.collect_set("window_cutoff")).alias("windows"))
    past = [F.max(F.when(F.col("model") == m, F.col("past_mae"))).alias(f"past_mae_{m}") for m in METHODS]
    return windows.groupBy(*keys).agg(
        F.min_by("model", F.struct(F.col("past_mae"), _rank())).alias("selected_model"), *past,
        F.max("window_end").alias("latest_completed_window_end"),
        F.array_join(F.transform(F.max("windows"), lambda w: w.cast("string")), "|").alias("used_window_cutoffs"))


def sequential_forecast(series: DataFrame, horizon: int = 14, lookback: int = 2,
                        origins: Column | None = None, first: int = 56) -> DataFrame:
    """Fixed methods plus ``sequential_select``, which follows the choice made at each origin."""
    origins = regular_origins(horizon, first) if origins is None else origins
    states = cut_lineage(origin_states(series))  # the forecasts and the past scores read the same states
    predictions = rolling_backtest(series, horizon, first, origins, states)
    choice = select_method(past_scores(series, horizon, lookback, origins, first, states)).select(
        "series_id", "cutoff", "selected_model")
    # Each fixed forecast is read once; the chosen one is emitted a second time under its new name.
    both = predictions.join(choice, ["series_id", "cutoff"])
    own = F.struct(F.col("model").alias("method"), F.col("model").alias("selected"))
    picked = F.struct(F.lit("sequential_select").alias("method"), F.col("model").alias("selected"))
    rows = F.when(F.col("model") == F.col("selected_model"), F.array(own, picked)).otherwise(F.array(own))
    return (both.select("series_id", "cutoff", "date", "actual", "prediction", F.explode(rows).alias("r"))
            .select("series_id", "cutoff", "date", F.col("r.method").alias("method"),
                    F.col("r.selected").alias("selected_model"), "actual", "prediction"))


def decision_log(series: DataFrame, horizon: int = 14, lookback: int = 2,
                 origins: Column | None = None, first: int = 56) -> DataFrame:
    """What was known and chosen at each origin, and the error that became known afterwards."""
    origins = regular_origins(horizon, first) if origins is None else origins
    states = cut_lineage(origin_states(series))
    chosen = select_method(past_scores(series, horizon, lookback, origins, first, states))
    after = forecast_metrics(rolling_backtest(series, horizon, first, origins, states)).select(
        "series_id", "cutoff", F.col("model").alias("selected_model"), F.col("valid_end").alias("future_window_end"),
        F.date_add("valid_end", 1).alias("future_mae_known_at_date"), F.col("mae").alias("future_mae"))
    return chosen.join(after, ["series_id", "cutoff", "selected_model"], "left")


def scenario_compare(metrics: DataFrame, scenario: str = "scenario", method: str = "model") -> DataFrame:
    """Mean MAE of each scenario and method and the best method of the scenario."""
    means = metrics.groupBy(scenario, method).agg(F.avg("mae").alias("mean_mae"))
    columns = [F.max(F.when(F.col(method) == m, F.col("mean_mae"))).alias(m) for m in METHODS]
    return means.groupBy(scenario).agg(
        *columns, F.min_by(method, F.struct(F.col("mean_mae"), _rank(method))).alias("best_method"))


def scenario_overlay(series: DataFrame, shock: int, slope: float, anchor_days: int = 7,
                     weekly: tuple[float, ...] = WEEKLY_PATTERN, floor: float = 5.0,
                     noise: Column | None = None) -> DataFrame:
    """Keep the days before ``shock``; afterwards follow a falling (slope > 0) or rising line.

    The anchor is the mean of ``anchor_days`` days before the shock minus the mean pattern; with
    one anchor day that day's own weekday effect is removed. Noise is an input column.
    """
    placed = positions(series)
    pattern = F.array(*[F.lit(float(v)) for v in weekly])
    wd = F.weekday("date")
    near = (F.col("pos") >= shock - anchor_days) & (F.col("pos") < shock)
    removed = F.get(pattern, wd) if anchor_days == 1 else F.lit(float(sum(weekly)) / len(weekly))
    whole = Window.partitionBy("series_id")
    anchor = F.avg(F.when(near, F.col("quantity"))).over(whole)
    if anchor_days == 1:
        anchor = F.max(F.when(near, F.col("quantity") - removed)).over(whole)
    else:
        anchor = anchor - removed
    placed = placed.withColumn("anchor", anchor)
    line = (F.col("anchor") - F.lit(float(slope)) * (F.col("pos") - shock + 1) + F.get(pattern, wd)
            + (F.lit(0.0) if noise is None else noise))
    value = F.when(F.col("pos") < shock, F.col("quantity")).otherwise(
        F.greatest(F.lit(float(floor)), F.bround(line, 0)))
    return placed.select("series_id", "date", value.alias("quantity"))


def stress_scenarios(series: DataFrame, decline_at: int = 56, regrow_at: int = 84) -> DataFrame:
    """original, decline and regrowth as series named ``scenario|series_id``."""
    decline = scenario_overlay(series, decline_at, 2.0)
    regrowth = scenario_overlay(decline, regrow_at, -3.0, anchor_days=1)
    out = None
    for name, s in (("original", series), ("decline", decline), ("regrowth", regrowth)):
        named = s.select(F.lit(name).alias("scenario"),
                         F.concat_ws("|", F.lit(name), "series_id").alias("series_id"), "date", "quantity")
        out = named if out is None else out.unionByName(named)
    return out


def future_forecast_export(demand: DataFrame, as_of: str, horizon: int = 14) -> DataFrame:
    """Forecast from ``as_of`` using earlier rows only; no score is claimed.

    Series which do not reach the day before ``as_of`` are left to ``history_reaches_origin``.
    """
    if horizon < 1:
        raise ValueError("the horizon must be a positive number of days")
    day = F.lit(as_of).cast("date")
    history = daily_total(demand.where(F.col("date") < day),
                          F.col("series_id") if "series_id" in demand.columns else None)
    history = usable_series(history)
    wide = forecast_at_origin(origin_states(history), last_origin() & (F.col("last_date") == F.date_sub(day, 1)),
                              horizon)
    return long_forecasts(wide)
