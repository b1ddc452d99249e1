"""Delivery-time analysis that respects when a label became known.

Records are ``order_id, accept_time, delivery_time`` (timestamps without zone); a record that has
not been delivered has a null ``delivery_time``. Windows are given by their start dates and a
horizon in days; a record finds its windows with array expressions, never with a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import melt, minutes_between
from ..functions.scale import exact_quantiles, ordered_running
from . import calendar as C, demand as D
from .contracts import dup_keys, negative_duration, require_none

# Fixed method names and the limit of a long delivery, in minutes.
DURATION_METHODS = ("global_median", "hour_median")
LONG_MINUTES = 360.0
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _full_text(column: str, year: int | None) -> Column:
    c = F.col(column)
    return c if year is None else F.concat(F.lit(f"{year}-"), c)


def _ds_text(year: int | None) -> Column:
    if year is None:
        return F.col("ds")
    code = F.lpad("ds", 4, "0")
    return F.concat_ws("-", F.lit(str(year)), F.substring(code, 1, 2), F.substring(code, 3, 2))


def parse_delivery_times(raw: DataFrame, year: int | None = None) -> DataFrame:
    """Text columns accept_time, delivery_time and ds to timestamps and a date; bad text fails."""
    parsed = [F.to_timestamp_ntz(_full_text(c, year), F.lit(TIME_FORMAT)).alias(c)
              for c in ("accept_time", "delivery_time")]
    return raw.select("order_id", F.to_date(_ds_text(year), "yyyy-MM-dd").alias("ds"), *parsed)


def unparsed_times(raw: DataFrame, year: int | None = None) -> DataFrame:
    """Violations: order_id, field and text of every time that cannot be read."""
    checks = [(c, _full_text(c, year), F.try_to_timestamp(_full_text(c, year), F.lit(TIME_FORMAT)))
              for c in ("accept_time", "delivery_time")]
    checks.append(("ds", _ds_text(year), F.try_to_date(_ds_text(year), "yyyy-MM-dd")))
    cells = F.array_compact(F.array(*[
        F.when(value.isNull(), F.struct(F.lit(name).alias("field"), text.alias("text")))
        for name, text, value in checks]))
    return raw.select("order_id", F.inline(cells))


def duration_minutes(records: DataFrame) -> DataFrame:
    return records.withColumn("minutes", minutes_between("accept_time", "delivery_time"))


def completed_asof(records: DataFrame, observation_end: str | None) -> DataFrame:
    """Records delivered before the end of the observation day."""
    done = records.where(F.col("delivery_time").isNotNull())
    if observation_end is None:
        return done
    return done.where(F.col("delivery_time") < F.expr(f"date_add(DATE '{observation_end}', 1)"))


def daily_completions(completed: DataFrame) -> DataFrame:
    """Completed records by completion date (not by ds), as one series."""
    return (completed.groupBy(F.lit("completions").alias("series_id"), F.to_date("delivery_time").alias("date"))
            .agg(F.count(F.lit(1)).cast("double").alias("quantity")))


def backtest_window_starts(block: DataFrame, windows: int, horizon: int) -> DataFrame:
    """The last ``windows`` windows of each block that has 28 + horizon*(windows+1) days."""
    enough = block.where(F.col("days") >= D.MIN_HISTORY + horizon * (windows + 1))
    offsets = F.sequence(F.col("days") - windows * horizon, F.col("days") - 1, F.lit(horizon).cast("bigint"))
    return (enough.select("series_id", "start_date", F.explode(offsets).alias("cutoff"))
            .select("series_id", "cutoff",
                    F.expr("date_add(start_date, cast(cutoff as int))").alias("window_start"),
                    F.expr(f"date_add(start_date, cast(cutoff as int) + {horizon - 1})").alias("window_end")))


def data_audit(records: DataFrame, observation_end: str | None = None) -> DataFrame:
    """Counts that describe the input and its observed part, as (metric, value) text rows."""
    everything = records.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("order_id").alias("unique_orders"),
        F.count_distinct("ds").alias("ds_days"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("ds", "accept_time", "delivery_time")])
    done = completed_asof(records, observation_end)
    observed = done.agg(
        F.count(F.lit(1)).alias("observed_completed_rows"),
        F.count_if(F.col("ds") != F.to_date("delivery_time")).alias("ds_finish_day_disagreements"),
        F.count_if(F.col("ds") != F.to_date("accept_time")).alias("ds_accept_day_disagreements"))
    daily = daily_completions(done)
    missing = C.calendar_gaps(daily).agg(F.count(F.lit(1)).alias("missing_dates"))
    block = C.longest_contiguous_block(daily).select(
        F.col("start_date").alias("block_start"), F.col("end_date").alias("block_end"), F.col("days").alias("block_days"))
    out = None
    for part in (everything, observed, missing, block):
        rows = melt(part, [], {c: c for c in part.columns}, "metric", "value", "string")
        out = rows if out is None else out.unionByName(rows)
    return out


def duration_quantiles(completed: DataFrame,
                       fractions: tuple[float, ...] = (0.0, 0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    names = {f"q{i}": f for i, f in enumerate(fractions)}
    wide = exact_quantiles(completed, [], "minutes", names)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(float(f)).alias("fraction"), F.col(n).alias("minutes")) for n, f in names.items()])))


def _dates(starts: list[str]) -> Column:
    return F.array(*[F.lit(s).cast("date") for s in sorted(set(starts))])


def window_table(records: DataFrame, starts: list[str], horizon: int) -> DataFrame:
    return (records.sparkSession.range(1).select(F.explode(_dates(starts)).alias("window_start"))
            .withColumn("window_end", F.date_add("window_start", horizon - 1)))


def window_cohort(records: DataFrame, starts: list[str], horizon: int) -> DataFrame:
    """Records accepted inside each window."""
    day = F.to_date("accept_time")
    inside = F.filter(_dates(starts), lambda s: (day >= s) & (day < F.date_add(s, horizon)))
    return records.select("*", F.explode(inside).alias("window_start"))


def mature_history(records: DataFrame, starts: list[str]) -> DataFrame:
    """Records accepted and delivered strictly before each origin."""
    known = F.filter(_dates(starts), lambda s: (F.col("accept_time") < s.cast("timestamp_ntz"))
                     & (F.col("delivery_time") < s.cast("timestamp_ntz")))
    return records.where(F.col("delivery_time").isNotNull()).select("*", F.explode(known).alias("window_start"))


def label_maturity(records: DataFrame, starts: list[str], horizon: int,
                   observation_end: str | None = None) -> DataFrame:
    """Accepted, mature and pending records of each window; undelivered records are pending.

    The time after which all labels are known is null while a record of the window is undelivered.
    """
    pending = F.col("delivery_time").isNull()
    if observation_end is not None:
        pending = pending | (F.col("delivery_time") >= F.expr(f"date_add(DATE '{observation_end}', 1)"))
    counted = window_cohort(records, starts, horizon).groupBy("window_start").agg(
        F.count(F.lit(1)).alias("accepted_records"), F.count_if(pending).alias("pending_records"),
        F.when(F.count_if(F.col("delivery_time").isNull()) == 0, F.max("delivery_time"))
        .alias("all_test_labels_known_after"))
    zero = F.lit(0).cast("bigint")
    return (window_table(records, starts, horizon).join(counted, "window_start", "left")
            .withColumn("accepted_records", F.coalesce("accepted_records", zero))
            .withColumn("pending_records", F.coalesce("pending_records", zero))
            .withColumn("mature_records", F.col("accepted_records") - F.col("pending_records"))
            .withColumn("all_labels_mature", F.col("pending_records") == 0))


def maturity_gate(maturity: DataFrame) -> DataFrame:
    """Windows that must not be scored because labels are still pending."""
    return maturity.where(F.col("pending_records") > 0)


def require_mature(maturity: DataFrame) -> None:
    require_none(maturity_gate(maturity), "labels are still pending; scoring only the fast records is refused")


def duration_global_median(records: DataFrame, starts: list[str]) -> DataFrame:
    """Exact median of the mature history of each origin."""
    return exact_quantiles(mature_history(records, starts), ["window_start"], "minutes",
                           {"global_median": 0.5}).withColumnRenamed(
        "n_values", "known_training_records")


def duration_hour_median(records: DataFrame, starts: list[str], min_records: int = 30) -> DataFrame:
    """Median of each accept hour with enough mature records, otherwise the origin's median.

    One row for each origin and each of the 24 hours.
    """
    history = mature_history(records, starts).withColumn("accept_hour", F.hour("accept_time"))
    by_hour = exact_quantiles(history, ["window_start", "accept_hour"], "minutes",
                              {"own_median": 0.5})
    hours = duration_global_median(records, starts).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("accept_hour"))
    own = F.when(F.col("n_values") >= min_records, F.col("own_median"))
    return hours.join(by_hour, ["window_start", "accept_hour"], "left").select(
        "window_start", "accept_hour", "known_training_records", "global_median",
        F.coalesce("n_values", F.lit(0).cast("bigint")).alias("hour_records"),
        F.coalesce(own, F.col("global_median")).alias("hour_median"))


def score_status(records: DataFrame, starts: list[str], horizon: int, observation_end: str | None) -> DataFrame:
    """window_start, accepted_records, pending_records, status of each window: only 'scored' ones have predictions."""
    status = (F.when(F.col("accepted_records") == 0, "no test records")
              .when(F.col("pending_records") > 0, "labels pending").when(F.col("known") == 0, "no mature history")
              .otherwise("scored"))
    known = mature_history(records, starts).groupBy("window_start").agg(F.count(F.lit(1)).alias("known"))
    return (label_maturity(records, starts, horizon, observation_end).join(known, "window_start", "left")
            .fillna(0, ["known"]).select("window_start", "accepted_records", "pending_records", status.alias("status")))


def duration_predictions(records: DataFrame, starts: list[str], horizon: int, observation_end: str | None = None,
                         min_records: int = 30, numbered: bool = True) -> DataFrame:
    """Both methods for the same records of each window, numbered by acceptance within the window.

    ``records`` are all accepted records, undelivered ones included. A window with pending labels is refused:
    scoring its fast deliveries alone would flatter every method. ``score_status`` names the windows without rows.
    Numbering needs a global order, so callers that only aggregate leave it out.
    """
    open_windows = maturity_gate(label_maturity(records, starts, horizon, observation_end)).select("window_start")
    test = window_cohort(records, starts, horizon).join(open_windows, "window_start", "left_anti").select(
        "window_start", "order_id", "accept_time", F.hour("accept_time").alias("accept_hour"),
        F.to_date("accept_time").alias("accept_date"), F.col("minutes").alias("actual_minutes"))
    ids = ["window_start", "accept_hour", "accept_date", "actual_minutes", "known_training_records"]
    if numbered:
        test = ordered_running(test, ["window_start"], [F.col("accept_time"), F.col("order_id")],
                               {"number": F.lit(1)}).withColumn("sample_index", F.col("number") - 1)
        ids.insert(1, "sample_index")
    estimates = duration_hour_median(records, starts, min_records)
    wide = test.join(estimates, ["window_start", "accept_hour"])
    return melt(wide, ids, {m: m for m in DURATION_METHODS}, "method", "prediction_minutes")


def _error() -> Column:
    return F.abs(F.col("actual_minutes") - F.col("prediction_minutes"))


def duration_metrics(predictions: DataFrame) -> DataFrame:
    """Errors of each window and method; the long-delivery MAE is null when there is none."""
    slow = F.col("actual_minutes") > LONG_MINUTES
    return predictions.groupBy("window_start", "method").agg(
        F.max("known_training_records").alias("known_training_records"),
        F.count(F.lit(1)).alias("test_records"), F.avg(_error()).alias("mae_minutes"),
        F.count_if(slow).alias("records_over_360_minutes"),
        F.avg(F.when(slow, _error())).alias("mae_over_360_minutes"))


def record_weighted_mae(metrics: DataFrame) -> DataFrame:
    """Mean over records: windows weigh by their test records."""
    return metrics.groupBy("method").agg(
        F.sum("test_records").alias("test_records"),
        (F.sum(F.col("mae_minutes") * F.col("test_records")) / F.sum("test_records")).alias("mae_minutes"))


def duration_diagnostics(predictions: DataFrame) -> DataFrame:
    """MAE and count by accept hour, accept date and duration band, each with the method."""
    slow = F.when(F.col("actual_minutes") > LONG_MINUTES, "over_360").otherwise("up_to_360")
    sets = F.array(*[F.struct(F.lit(by).alias("by"), value.alias("group")) for by, value in (
        ("accept_hour", F.col("accept_hour").cast("string")), ("accept_date", F.col("accept_date").cast("string")),
        ("duration_band", slow))])
    return (predictions.select("method", _error().alias("e"), F.inline(sets))
            .groupBy("by", "group", "method")
            .agg(F.count(F.lit(1)).alias("test_records"), F.avg("e").alias("mae_minutes")))


def volume_origins(windows: int, horizon: int) -> Column:
    """The last ``windows`` origins of a series, ``horizon`` days apart."""
    left = F.col("n_days") - F.col("cutoff")
    return (left % horizon == 0) & (left >= horizon) & (left <= windows * horizon)


def volume_backtest(series: DataFrame, windows: int = 4, horizon: int = 14) -> DataFrame:
    """Sequential and fixed forecasts of the last windows of each contiguous series."""
    needed = D.MIN_HISTORY + horizon * (windows + 1)
    return D.sequential_forecast(D.usable_series(series, needed), horizon, origins=volume_origins(windows, horizon))


def volume_choices(series: DataFrame, windows: int = 4, horizon: int = 14) -> DataFrame:
    needed = D.MIN_HISTORY + horizon * (windows + 1)
    return D.select_method(D.past_scores(D.usable_series(series, needed), horizon,
                                         origins=volume_origins(windows, horizon)))


def improvement_pct(overall: DataFrame) -> DataFrame:
    """Relative MAE reduction of the hour medians; null when the global MAE is zero."""
    both = overall.agg(*[F.max(F.when(F.col("method") == m, F.col("mae_minutes"))).alias(m)
                         for m in DURATION_METHODS])
    base, hour = F.col(DURATION_METHODS[0]), F.col(DURATION_METHODS[1])
    return both.withColumn("improvement_pct", F.try_divide(100 * (base - hour), F.nullif(base, F.lit(0.0))))


def tail_mae(predictions: DataFrame) -> DataFrame:
    """MAE of each method on deliveries over 360 minutes, null when there is none."""
    slow = F.col("actual_minutes") > LONG_MINUTES
    return predictions.groupBy("method").agg(
        F.count_if(slow).alias("tail_records"), F.avg(F.when(slow, _error())).alias("tail_mae_minutes"))


def check_records(records: DataFrame) -> None:
    """Refuse negative durations and repeated order ids."""
    require_none(negative_duration(records), "negative duration")
    require_none(dup_keys(records, ["order_id"]), "order ids must be unique")
