"""Input contracts: each check returns the violating rows; ``require_none`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import all_close, any_of, is_finite, melt
from ..functions.scale import nearest_in_time
from ..sources.tables import ContractError


def require_none(violations: DataFrame, message: str) -> None:
    """Raise when a check found anything; only one violating row reaches the driver."""
    first = violations.take(1)
    if first:
        raise ContractError(f"{message}: {first[0].asDict()}")


def require_rows(df: DataFrame, message: str) -> None:
    if not df.take(1):
        raise ContractError(message)


def null_audit(df: DataFrame) -> DataFrame:
    """Null count of each column that has any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return melt(counts, [], {c: c for c in df.columns}, "column", "nulls", "bigint").where("nulls > 0")


def dup_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def sign_check(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Rows below zero, or not above zero when ``strict``."""
    return df.where(F.col(column) <= 0 if strict else F.col(column) < 0)


def finite_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with NaN or an infinity in any of the columns."""
    return df.where(any_of([~is_finite(c) for c in columns]))


def finite_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Finite and not finite values of each column."""
    stats = df.agg(*[F.count_if(is_finite(c)).alias(f"ok_{c}") for c in columns],
                   *[F.count_if(~is_finite(c)).alias(f"bad_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"ok_{c}").alias("finite"),
                               F.col(f"bad_{c}").alias("not_finite")) for c in columns])
    return stats.select(F.inline(cells))


def before_cutoff(df: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    """Rows strictly before the observation date."""
    return df.where(F.col(date) < F.lit(cutoff).cast("date"))


def after_cutoff(df: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    """Violations: rows at or after the observation date."""
    return df.where(F.col(date) >= F.lit(cutoff).cast("date"))


def history_reaches_origin(series: DataFrame, as_of: str) -> DataFrame:
    """Last known day of each series next to the day before ``as_of``."""
    day = F.lit(as_of).cast("date")
    return (series.where(F.col("date") < day).groupBy("series_id")
            .agg(F.max("date").alias("last_date"))
            .withColumn("expected_date", F.date_sub(day, 1))
            .withColumn("reaches", F.col("last_date") == F.col("expected_date")))


def point_in_time(df: DataFrame, available_at: str, prediction_at: str) -> DataFrame:
    """Keep features which were available at the prediction."""
    return df.where(F.col(available_at) <= F.col(prediction_at))


def late_features(df: DataFrame, available_at: str, prediction_at: str) -> DataFrame:
    """Violations: features that became available after the prediction."""
    return df.where(F.col(available_at) > F.col(prediction_at))


def latest_known(requests: DataFrame, features: DataFrame, key: str, prediction_at: str,
                 available_at: str, value: str) -> DataFrame:
    """For each request the newest feature value with available_at <= prediction_at (null if none).

    Feature rows of one key must have different ``available_at``.
    """
    kept = [c for c in requests.columns if c not in (key, prediction_at)]
    left = requests.select(F.col(key), F.col(prediction_at).alias("_at"), F.lit(True).alias("_asks"),
                           F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"),
                           F.lit(None).alias("_feature"))
    right = features.select(F.col(key), F.col(available_at).alias("_at"), F.lit(False).alias("_asks"),
                            F.lit(None).alias("_row"),
                            F.struct(F.col(value).alias("v"), F.col(available_at).alias("at")).alias("_feature"))
    both = nearest_in_time(left.unionByName(right), [key], "_at", F.col("_feature"), "_known")
    out = both.where("_asks").select(key, F.col("_at").alias(prediction_at),
                                     *([F.col("_row.*")] if kept else []),
                                     F.col("_known.v").alias(value), F.col("_known.at").alias(available_at))
    return out


def future_split_check(rows: DataFrame, fold: str = "fold", role: str = "role", date: str = "date") -> DataFrame:
    """Each fold's last training and first validation date; ``ok`` needs strictly earlier training."""
    return (rows.groupBy(fold)
            .agg(F.max(F.when(F.col(role) == "train", F.col(date))).alias("train_end"),
                 F.min(F.when(F.col(role) == "valid", F.col(date))).alias("valid_start"))
            .withColumn("ok", F.coalesce(F.col("train_end") < F.col("valid_start"), F.lit(False))))


def join_cardinality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a one-to-one join, with the side that repeats them."""
    sides = [dup_keys(df, keys).select(F.lit(side).alias("side"), *keys, "n")
             for side, df in (("left", left), ("right", right))]
    return sides[0].unionByName(sides[1])


def one_to_one_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that refuses repeated keys on either side."""
    require_none(join_cardinality(left, right, keys), "join keys are not one-to-one")
    return left.join(right, keys, "inner")


def key_set_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    r = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return (l.join(r, keys, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull())
            .select(*keys, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("status")))


def allclose_check(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two values differ by more than 1e-8 + 1e-5*|b|."""
    return df.where(~all_close(a, b))


def rows_vs_distinct(lines: DataFrame, group: list[str], item: str) -> DataFrame:
    """Groups whose row count differs from their distinct items. Repeats are summed map-side first."""
    per_item = lines.groupBy(*group, item).agg(F.count(F.lit(1)).alias("_n"))
    return (per_item.groupBy(*group)
            .agg(F.sum("_n").alias("row_count"), F.count(F.lit(1)).alias("distinct_count"))
            .where(F.col("row_count") != F.col("distinct_count")))


def answer_as_feature(df: DataFrame, label: str, candidates: list[str]) -> DataFrame:
    """MAE of each candidate used as the prediction; zero marks a copied answer.

    The constant baseline predicts the mean label.
    """
    mean = df.agg(F.avg(label)).scalar()
    errors = {c: F.avg(F.abs(F.col(label) - F.col(c))) for c in candidates}
    errors["constant_mean"] = F.avg(F.abs(F.col(label) - mean))
    stats = df.agg(*[e.alias(c) for c, e in errors.items()])
    return (melt(stats, [], {c: c for c in errors}, "candidate", "mae")
            .withColumn("copies_answer", F.col("mae") == 0))


def negative_duration(df: DataFrame, minutes: str = "minutes") -> DataFrame:
    """Records completed before they were accepted; rejected, never repaired."""
    return df.where(F.col(minutes) < 0)


def catalog_search(catalog: DataFrame, competition: str = "", keyword: str = "",
                   priority: str | None = None,
                   searched: tuple[str, ...] = ("title", "value", "limitation")) -> DataFrame:
    """Substring on the competition, exact priority, case-folded keyword over the text columns."""
    out = catalog
    if competition:
        out = out.where(F.col("competition").contains(competition))
    if priority is not None:
        out = out.where(F.col("priority") == priority)
    if keyword:
        text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in searched])
        out = out.where(F.lower(text).contains(keyword.lower()))
    return out


# Fixed values of the catalogue contract.
PRIORITIES = ("P0", "P1", "P2")
URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def catalog_quality(catalog: DataFrame, text_fields: list[str]) -> DataFrame:
    """One row for each broken rule of each entry: id, rule, field.

    Entries with a blank field are only reported as blank. Repeated ids and urls are counted by
    grouping, so a value shared by a third of the rows is combined before it travels.
    """
    blank = {f: F.col(f).isNull() | (F.trim(F.col(f)) == "") for f in text_fields}
    blank_rows = catalog.select("id", F.explode(F.array_compact(F.array(*[
        F.when(blank[f], F.lit(f)) for f in text_fields]))).alias("field")).withColumn("rule", F.lit("blank"))
    full = catalog.where(~any_of(list(blank.values())))
    host = F.lower(F.regexp_extract("url", URL_HOST, 1))
    scheme = F.lower(F.regexp_extract("url", URL_SCHEME, 1))
    bad_url = ~scheme.isin("http", "https") | (host == "")
    bad_date = ~F.col("checked_at").rlike(ISO_DATE) | F.try_to_date("checked_at", "yyyy-MM-dd").isNull()
    rules: list[tuple[str, str, Column]] = [
        ("priority", "priority", ~F.col("priority").isin(*PRIORITIES)),
        ("url_scheme_or_host", "url", bad_url),
        ("url_reserved_host", "url", ~bad_url & host.endswith(".invalid")),
        ("date", "checked_at", bad_date)]
    broken = full.select("id", F.inline(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(f).alias("field"))) for rule, f, cond in rules]))))
    out = blank_rows.select("id", "rule", "field").unionByName(broken)
    for f in ("id", "url"):
        repeated = full.groupBy(f).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(f)
        out = out.unionByName(full.join(repeated, f, "left_semi").select(
            "id", F.lit("duplicate").alias("rule"), F.lit(f).alias("field")))
    return out
