"""Recompute-and-compare jobs: stored result tables against results rebuilt from their inputs.

Every check returns differences as ``table, key, field, status, stored, fresh``; no rows means the
stored tables agree with their inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import is_close, is_finite
from ..functions.scale import cut_lineage
from . import delivery as T, demand as D, location as L, segments as G, warehouse as W


def tolerant_diff(stored: DataFrame, fresh: DataFrame, keys: list[str], values: list[str],
                  exact: list[str] | None = None, table: str = "result") -> DataFrame:
    """Full outer comparison on keys: missing, extra and repeated keys and differing values.

    ``values`` are compared within an absolute 2e-6 or relative 1e-7, ``exact`` columns as text. A null key is a
    key. Repeated keys are reported on either side ('repeated', 'repeated_fresh'); their least and greatest values
    are compared, so none hides behind another. A null key is printed as ``null``.
    """
    exact = exact or []

    def grouped(df: DataFrame, side: str) -> DataFrame:
        ends = [f(c).alias(f"_{side}{e}_{c}") for c in [*values, *exact] for e, f in (("l", F.min), ("h", F.max))]
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{side}"), *ends)

    left, right = grouped(stored, "s"), grouped(fresh, "f")
    right = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "full_outer")
    none = F.lit(None).cast("double")

    def problem(cond, field, status, a=none, b=none):
        return F.when(cond, F.struct(F.lit(field).cast("string").alias("field"), F.lit(status).alias("status"),
                                     a.alias("stored"), b.alias("fresh")))

    both = F.col("_ns").isNotNull() & F.col("_nf").isNotNull()
    found = [problem(F.col("_ns").isNull(), None, "missing"), problem(F.col("_nf").isNull(), None, "extra"),
             problem(F.col("_ns") > 1, None, "repeated"), problem(F.col("_nf") > 1, None, "repeated_fresh")]
    for c in values:
        ends = [[F.col(f"_{side}{e}_{c}").cast("double") for side in "sf"] for e in "lh"]
        same = [F.coalesce(is_close(a, b), a.isNull() & b.isNull()) for a, b in ends]
        a, b = ends[1]
        low_a, low_b = ends[0]
        found.append(problem(both & ~(same[0] & same[1]), c, "differs", F.when(~same[1], a).otherwise(low_a),
                             F.when(~same[1], b).otherwise(low_b)))
    for c in exact:
        same = [F.col(f"_s{e}_{c}").cast("string").eqNullSafe(F.col(f"_f{e}_{c}").cast("string")) for e in "lh"]
        found.append(problem(both & ~(same[0] & same[1]), c, "differs"))
    key = F.concat_ws("|", *[F.coalesce(F.coalesce(F.col(k), F.col(f"_k_{k}")).cast("string"), F.lit("null")) for k in keys])
    return joined.select(F.lit(table).alias("table"), key.alias("key"), F.inline(F.array_compact(F.array(*found))))


def all_differences(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def recompute_metrics(series: DataFrame, predictions: DataFrame, metrics: DataFrame,
                      leaderboard: DataFrame) -> DataFrame:
    """Stored actuals against the series, stored errors and means against the stored predictions."""
    rows = ["series_id", "cutoff", "date", "model"]
    actual = predictions.drop("actual").join(
        series.select("series_id", "date", F.col("quantity").alias("actual")), ["series_id", "date"], "left")
    rebuilt = D.forecast_metrics(predictions)
    return all_differences([
        tolerant_diff(predictions, actual, rows, ["actual"], table="predictions"),
        tolerant_diff(metrics, rebuilt, ["series_id", "cutoff", "model"], ["mae", "rmse"], ["valid_start"], "metrics"),
        tolerant_diff(leaderboard, D.method_leaderboard(rebuilt), ["series_id", "model"], ["mean_mae", "mean_rmse"],
                      table="leaderboard")])


def window_shape_check(predictions: DataFrame, horizon: int, methods: tuple[str, ...],
                       window: tuple[str, ...] = ("series_id", "cutoff"), method: str = "model") -> DataFrame:
    """Windows whose dates are not exactly ``horizon`` consecutive days, and methods a window lacks."""
    shape = predictions.groupBy(*window, method).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_days"),
        F.min("date").alias("a"), F.max("date").alias("b"))
    broken = (F.when(F.col("n_rows") != F.col("n_days"), "repeated_date")
              .when(F.col("n_days") != horizon, "wrong_length")
              .when(F.date_diff("b", "a") + 1 != horizon, "not_consecutive"))
    grid = shape.select(*window).distinct().withColumn(method, F.explode(F.array(*[F.lit(m) for m in methods])))
    lacking = grid.join(shape.select(*window, method), [*window, method], "left_anti")
    return (shape.withColumn("problem", broken).where(F.col("problem").isNotNull())
            .select(*window, method, "problem")
            .unionByName(lacking.withColumn("problem", F.lit("missing_method"))))


def recompute_eiq_abc(orders: DataFrame, stored_orders: DataFrame, stored_items: DataFrame) -> DataFrame:
    """Order and item statistics, shares and both ABC classes from the raw order lines.

    Both parts read the lines; write them once (``cut_lineage``) if they come from joins.
    """
    lines = W.order_sku_lines(orders)
    items = W.abc_classify(W.item_eiq(lines), limits={"ABC": W.LIMITS, "ABC_70_90": (0.70, 0.90)})
    return all_differences([
        tolerant_diff(stored_orders, W.order_eiq(lines), ["date", "order_id"], ["EQ", "EN"], table="order_eiq"),
        tolerant_diff(stored_items, items, ["date", "sku"], ["IQ", "IK", "cum_share"], ["ABC", "ABC_70_90"],
                      "item_eiq_abc")])


def recompute_coverage(points: DataFrame, centers: DataFrame, allocations: DataFrame, cover: DataFrame,
                       ks: tuple[int, ...], radii: tuple[float, ...]) -> DataFrame:
    """Each stored allocation must name *a* nearest centre; coverage is recomputed."""
    near = L.nearest_center(points, centers, ks)
    best = near.select("k", "point_id", F.col("distance_km").alias("best"))
    spot = points.select("point_id", "x_km", "y_km")
    named = centers.select("k", F.col("cluster").cast("int").alias("cluster"), F.struct(F.col("x_km").alias("x"), F.col("y_km").alias("y")).alias("_c"))
    recorded = (allocations.join(spot, "point_id").join(named, ["k", "cluster"], "left")
                .withColumn("to_recorded", L.euclid("x_km", "y_km", F.col("_c.x"), F.col("_c.y")))
                .join(best, ["k", "point_id"]))
    none = F.lit(None).cast("double")
    wrong = F.array_compact(F.array(
        F.when(F.col("_c").isNull(), F.struct(F.lit("cluster").alias("field"), F.lit("unknown_center").alias("status"),
                                              none.alias("stored"), none.alias("fresh"))),
        F.when(~is_close("to_recorded", "best"), F.struct(
            F.lit("cluster").alias("field"), F.lit("not_nearest").alias("status"),
            F.col("to_recorded").alias("stored"), F.col("best").alias("fresh")))))
    placed = recorded.select(F.lit("allocations").alias("table"),
                             F.concat_ws("|", F.col("k").cast("string"), F.col("point_id").cast("string")).alias("key"),
                             F.inline(wrong))
    return all_differences([
        placed,
        tolerant_diff(allocations, near, ["k", "point_id"], ["distance_km"], table="allocations"),
        tolerant_diff(cover, L.coverage(near, radii), ["k", "radius_km"],
                      ["city_coverage", "demand_coverage", "weighted_distance_km"], table="coverage")])


def recompute_segments(features: DataFrame, stored_rules: DataFrame, stored_scores: DataFrame,
                       stored_profiles: DataFrame, stored_ari: DataFrame, labels: DataFrame,
                       columns: list[str] = G.FEATURES) -> DataFrame:
    """Volume thirds, silhouettes, agreement and profiles from the features and stored labels.

    ``labels`` is period, customer_id, cluster.
    """
    z = [f"z_{c}" for c in columns]
    ruled = cut_lineage(G.volume_terciles(G.standardize(features, columns)))
    labelled = cut_lineage(ruled.join(labels, ["period", "customer_id"]))
    return all_differences([
        tolerant_diff(stored_rules, ruled, ["period", "customer_id"], ["volume_rule"], table="volume_rule"),
        tolerant_diff(stored_scores, G.silhouette(labelled.select("period", *z, "cluster"), z, ["period"]),
                      ["period"], ["silhouette"], table="scores"),
        tolerant_diff(stored_profiles, G.segment_profiles(labelled, ["period"]), ["period", "cluster"],
                      ["customer_count", "mean_orders", "mean_volume", "mean_recency"], table="profiles"),
        tolerant_diff(stored_ari, G.adjusted_rand(labelled, "cluster", "volume_rule", ["period"]), ["period"],
                      ["ari"], table="agreement")])


def recompute_drift(features: DataFrame, assignments: DataFrame, metrics: DataFrame, seeds: DataFrame,
                    summary: DataFrame, reference: str, base: str = "kmeans_fixed",
                    methods: tuple[str, ...] = ("kmeans_fixed", "kmeans_refit", "volume_fixed", "volume_refit"),
                    columns: list[str] = G.FEATURES) -> DataFrame:
    """Stored labels of several methods and seeds, and every measure published from them.

    ``assignments`` is period, customer_id, method, cluster; ``metrics`` period, method, k, silhouette and the two
    agreements; ``seeds`` seed, customer_id, cluster for the reference period; ``summary`` name, value. Each method
    must label each customer of each period once and each seed each customer of the reference period. Both volume
    rules are rebuilt from the features; silhouettes and agreements from the stored labels, one pass over all
    methods and periods; ``summary`` holds the least agreement of a seed, the first silhouette and the agreement over
    time of ``base``.
    """
    z = [f"z_{c}" for c in columns]
    rules = ["volume_fixed", "volume_refit"]
    table = cut_lineage(G.volume_bands(G.standardize(features, columns, reference=reference), reference))
    everyone = table.select("period", "customer_id")
    ruled = G.assignment_long(table, rules)
    other = [m for m in methods if m not in rules]
    grid = everyone.withColumn("method", F.explode(F.array(*[F.lit(m) for m in other])))
    keys = ["period", "customer_id", "method"]
    own = assignments.where(F.col("method") == "volume_refit").select("period", "customer_id", F.col("cluster").alias("rule"))
    labelled = assignments.join(own, ["period", "customer_id"]).join(
        table.select("period", "customer_id", *z), ["period", "customer_id"])
    drift = cut_lineage(G.long_drift(cut_lineage(labelled), z, reference))
    start = assignments.where((F.col("period") == reference) & (F.col("method") == base)).select(
        "customer_id", F.col("cluster").alias("base"))
    first = everyone.where(F.col("period") == reference).select("customer_id")
    each_seed = first.withColumn("seed", F.explode(seeds.agg(F.collect_set("seed")).scalar()))  # a handful of seeds
    agreed = G.adjusted_rand(seeds.join(start, "customer_id"), "base", "cluster", ["seed"])

    def of_base(period: Column, value: str) -> DataFrame:
        return drift.where(period & (F.col("method") == base)).agg(F.min(value).alias("value"))

    at_first = F.col("period") == reference
    rebuilt = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), "value") for name, df in (
        ("single_initialization_minimum_ari", agreed.agg(F.min("ari").alias("value"))),
        ("first_customer_silhouette", of_base(at_first, "silhouette")),
        ("customer_fixed_model_time_ari", of_base(~at_first, "ari_to_first_period")))])
    return all_differences([
        tolerant_diff(assignments.where(F.col("method").isin(rules)), ruled, keys, ["cluster"], table="assignments"),
        tolerant_diff(assignments.where(~F.col("method").isin(rules)), grid, keys, [], table="assignments"),
        tolerant_diff(metrics, drift, ["period", "method"],
                      ["k", "silhouette", "ari_to_first_period", "ari_to_volume_refit"], table="metrics"),
        tolerant_diff(seeds, each_seed, ["seed", "customer_id"], [], table="seeds"),
        tolerant_diff(summary, rebuilt, ["name"], ["value"], table="summary")])


def recompute_slotting(demand: DataFrame, stored: DataFrame, site: str = "warehouse") -> DataFrame:
    """Policies and walking metres replayed from the demand, which is read three times: written once if it comes from joins."""
    fresh = W.slot_policy_operations(W.slot_policy(demand, site), demand, site)
    return tolerant_diff(stored, fresh, [site, "strategy", "date"],
                         ["pick_walk_m", "move_walk_m", "total_walk_m"], ["near_sku"], "warehouse_operations")


def recompute_sites(points: DataFrame, sites: DataFrame, k: int, radii: tuple[float, ...],
                    stored: DataFrame) -> DataFrame:
    """Stored plans against the recomputed optimum; sites must be distinct candidates.

    ``stored`` is policy, radius_km, extra_loss_budget, k, centers and the plan measures.
    """
    fresh = L.selected_plans(cut_lineage(L.evaluate_sites(points, sites, k, radii)))
    keys = ["policy", "radius_km", "budget"]

    def keyed(df):
        return df.withColumn("budget", F.coalesce("extra_loss_budget", F.lit(-1.0)))

    listed = keyed(stored).select(*keys, F.split("centers", r"\|").alias("ids"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    none = F.lit(None).cast("double")
    fixed = [F.lit("centers").alias("field"), none.alias("stored"), none.alias("fresh")]
    repeated = listed.where(F.size(F.array_distinct("ids")) != k).select(
        F.lit("selected_plans").alias("table"), key.alias("key"), F.lit("repeated_site").alias("status"), *fixed)
    unknown = (listed.withColumn("site_id", F.explode("ids"))
               .join(sites.select(F.col("site_id").cast("string").alias("site_id")), "site_id", "left_anti")
               .select(F.lit("selected_plans").alias("table"), key.alias("key"), F.lit("unknown_site").alias("status"), *fixed))
    return all_differences([
        tolerant_diff(keyed(stored), keyed(fresh), keys,
                      ["city_coverage", "demand_coverage", "weighted_distance_km", "weighted_squared_loss"],
                      ["centers"], "selected_plans"), repeated, unknown])


def paired_methods_check(predictions: DataFrame, methods: tuple[str, str] = T.DURATION_METHODS,
                         columns: tuple[str, ...] = ("window_start", "sample_index", "accept_hour", "accept_date",
                                                     "actual_minutes")) -> DataFrame:
    """Records one method scored and the other did not, counted with repetition."""
    a, b = (predictions.where(F.col("method") == m).select(*columns) for m in methods)
    return (a.exceptAll(b).withColumn("only_in", F.lit(methods[0]))
            .unionByName(b.exceptAll(a).withColumn("only_in", F.lit(methods[1]))))


def recompute_duration(predictions: DataFrame, metrics: DataFrame, diagnostics: DataFrame,
                       overall: DataFrame) -> DataFrame:
    """Window, long-delivery, overall and diagnostic errors from the stored predictions."""
    rebuilt = T.duration_metrics(predictions)
    return all_differences([
        tolerant_diff(metrics, rebuilt, ["window_start", "method"],
                      ["test_records", "mae_minutes", "records_over_360_minutes", "mae_over_360_minutes"],
                      table="duration_metrics"),
        tolerant_diff(diagnostics, T.duration_diagnostics(predictions), ["by", "group", "method"],
                      ["test_records", "mae_minutes"], table="duration_diagnostics"),
        tolerant_diff(overall, T.record_weighted_mae(rebuilt), ["method"], ["mae_minutes"], table="duration_overall")])


def duration_tables_check(predictions: DataFrame, metrics: DataFrame, horizon: int,
                          methods: tuple[str, ...] = T.DURATION_METHODS) -> DataFrame:
    """Stored duration tables against what every such table must obey, one row for each breach.

    Predictions: finite and not negative, an hour of 0 to 23, an accept date inside the window, each sample_index of a
    window and method once. Metrics: the window's last day, equal training records of all methods, every method for
    each window of either table.
    """
    none = F.lit(None).cast("double")

    def breach(cond: Column, field: str, status: str, stored: Column = none, fresh: Column = none) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(status).alias("status"),
                                     stored.cast("double").alias("stored"), fresh.cast("double").alias("fresh")))

    def told(df: DataFrame, table: str, keys: list[str], rules: list[Column]) -> DataFrame:
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
        return df.select(F.lit(table).alias("table"), key.alias("key"), F.inline(F.array_compact(F.array(*rules))))

    minutes = []
    for field in ("actual_minutes", "prediction_minutes"):
        good = F.coalesce(is_finite(field), F.lit(False))
        minutes += [breach(~good, field, "not_finite"), breach(good & (F.col(field) < 0), field, "negative", F.col(field))]
    last = F.date_add("window_start", horizon - 1)
    inside = F.coalesce(F.col("accept_date").between(F.col("window_start"), last), F.lit(False))
    hour = F.coalesce(F.col("accept_hour").between(0, 23), F.lit(False))
    index = ["window_start", "method", "sample_index"]
    repeated = predictions.groupBy(*index).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    windows = predictions.select("window_start").union(metrics.select("window_start")).distinct()
    grid = windows.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    lacking = [told(grid.join(df.select("window_start", "method"), ["window_start", "method"], "left_anti"), table,
                    ["window_start", "method"], [breach(F.lit(True), "method", "missing_method")])
               for df, table in ((predictions, "duration_predictions"), (metrics, "duration_metrics"))]
    training = metrics.groupBy("window_start").agg(F.min("known_training_records").alias("least"),
                                                   F.max("known_training_records").alias("most"))
    return all_differences([
        told(predictions, "duration_predictions", index, [
            *minutes, breach(~hour, "accept_hour", "not_an_hour", F.col("accept_hour")),
            breach(~inside, "accept_date", "outside_window")]),
        told(repeated, "duration_predictions", index, [breach(F.lit(True), "sample_index", "repeated", F.col("copies"))]),
        told(metrics, "duration_metrics", ["window_start", "method"], [
            breach(~F.col("window_end").eqNullSafe(last), "window_end", "wrong_end")]),
        told(training, "duration_metrics", ["window_start"], [
            breach(F.col("least") != F.col("most"), "known_training_records", "unequal_training", F.col("least"),
                   F.col("most"))]), *lacking])


def claim_trace(claims: DataFrame, published: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each problem of a claim: id, status.

    ``claims`` is id, value, display_value; ``published`` is id, shown; ``results`` is id, result_value.
    A display value must be a plain decimal and equal the value at its own number of decimals.
    """
    per_claim = claims.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.max("value").alias("value"),
                                         F.max("display_value").alias("display_value"))
    shown = published.groupBy("id").agg(F.count(F.lit(1)).alias("shown_copies"), F.max("shown").alias("shown"))
    joined = per_claim.join(shown, "id", "full_outer").join(results, "id", "left")
    known = F.col("copies").isNotNull()
    decimal = F.col("display_value").rlike(r"^-?[0-9]+([.][0-9]+)?$")
    places = F.length(F.regexp_extract("display_value", r"^-?[0-9]+[.]?([0-9]*)$", 1))
    gap = F.abs(F.col("display_value").try_cast("double") - F.col("value"))
    rules = [("unregistered", ~known), ("repeated_claim", F.col("copies") > 1),
             ("not_published", known & F.col("shown").isNull()), ("published_twice", F.col("shown_copies") > 1),
             ("shown_differs", known & (F.col("shown") != F.col("display_value"))),
             ("not_decimal", known & ~decimal),
             ("display_differs", decimal & (gap > 0.5 * F.pow(F.lit(10.0), -places) * (1 + 1e-9))),
             ("result_missing", known & F.col("result_value").isNull()),
             ("result_differs", known & (F.col("value") != F.col("result_value")))]
    return joined.select("id", F.explode(F.array_compact(F.array(*[
        F.when(cond, F.lit(name)) for name, cond in rules]))).alias("status"))


#: Fixed form of a published link: one text in brackets and its target in parentheses.
PUBLISHED_LINK = r"^\[[^\]]+\]\(([^\s()]+)\)$"


def claim_links(claims: DataFrame, published: DataFrame, folder: str = "") -> DataFrame:
    """Published links that do not lead to the claim's evidence file: id, status, target.

    ``claims`` is id, file (a path from the root); ``published`` is id, link. A link is relative to ``folder``, the
    folder of the report; '.' and '..' are resolved, a path above the root stays above it. Scheme, host, query,
    fragment and a leading slash are refused. Claims without a published link are listed as ``claim_trace`` does.
    """
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                .otherwise(F.concat(done, F.array(part))))

    def resolved(path: Column) -> Column:
        return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")

    target = F.regexp_extract("link", PUBLISHED_LINK, 1)
    joined = claims.select("id", "file").join(published.select("id", target.alias("target"), "link"), "id", "left")
    plain = F.col("target").rlike("^[^/?#]") & ~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:|[?#]")
    there = resolved(F.concat(F.lit(f"{folder}/"), "target"))
    status = (F.when(F.col("link").isNull(), "not_published").when(F.col("target") == "", "not_a_link")
              .when(~plain, "not_relative").when(~there.eqNullSafe(resolved(F.col("file"))), "leads_elsewhere"))
    return joined.withColumn("status", status).where(F.col("status").isNotNull()).select("id", "status", "target")


def claim_evidence(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each problem of a claim's evidence: id, status.

    ``claims`` is id, file, keys (an array of names), value, data_kind; ``documents`` is file, content (JSON). The
    named file must be there once, the keys must lead to a number equal to the value, and the kind of data must be
    stated. A claim's document is found by a join; nothing is read on the driver.
    """
    files = documents.groupBy("file").agg(F.count(F.lit(1)).alias("copies"), F.max("content").alias("content"))
    path = F.concat(F.lit("$"), F.array_join(F.transform("keys", lambda k: F.concat(F.lit("['"), k, F.lit("']"))), ""))
    found = (claims.withColumn("_path", path).join(files, "file", "left")
             .withColumn("_text", F.expr("get_json_object(content, _path)"))
             .withColumn("_number", F.col("_text").try_cast("double")))
    there = F.col("copies").isNotNull()
    rules = [("file_missing", ~there), ("file_repeated", F.col("copies") > 1),
             ("keys_lead_nowhere", there & F.col("_text").isNull()),
             ("not_a_number", F.col("_text").isNotNull() & F.col("_number").isNull()),
             ("evidence_differs", F.col("_number").isNotNull() & ~F.col("_number").eqNullSafe(F.col("value"))),
             ("kind_missing", F.coalesce(F.trim("data_kind"), F.lit("")) == "")]
    return found.select("id", F.explode(F.array_compact(F.array(*[
        F.when(cond, F.lit(name)) for name, cond in rules]))).alias("status"))


#: A value of an attribute in any of its three forms: in double quotes, in single quotes, bare.
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
LINK = r"""(?i)[\s"'/]href\s*=\s*""" + VALUE
BASE = r"""(?i)<base\s(?:[^>]*[\s"'/])?href\s*=\s*""" + VALUE
#: Character references read in attributes besides numeric ones (fixed values).
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _attribute(raw: Column) -> Column:
    """An attribute's value: quotes off, character references read once, white space at the ends off."""
    bare = F.when(raw.rlike("""^["']"""), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    def piece(p: Column) -> Column:
        body = F.regexp_extract(p, f"^(#[0-9]{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|{'|'.join(NAMED)});", 1)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10)).when(
            body.startswith("#"), F.substring(body, 2, 7)).cast("bigint")
        real = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, text in NAMED.items():
            char = F.when(body == name, F.lit(text)).otherwise(char)
        return F.coalesce(F.concat(char, F.substring(p, F.length(body) + 2, F.length(p))), F.concat(F.lit("&"), p))

    parts = F.split(bare, "&")
    return F.trim(F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), "")))


def _collapsed(path: Column) -> Column:
    """A path from the root without '.' and '..'."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(path, "/")
    start = F.array(F.element_at(parts, 1))
    return F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), start, step), "/")


def broken_links(pages: DataFrame, link_pattern: str = LINK, key: str = "page_id",
                 text: str = "html", address: str = "url") -> DataFrame:
    """Local link targets that no page has: key, target.

    Targets are resolved as a browser does: values may be quoted or bare and hold character references, a page's
    first ``<base href>`` moves its folder, paths start at the root of the host or that folder, '.' and '..' are
    collapsed, percent codes decoded on both sides. Targets with a scheme, other hosts (also by the base) and pure
    fragments are skipped; queries and fragments are cut off.
    """
    host = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:"
    valid = r"^([^%]|%[0-9A-Fa-f]{2})*$"

    def decoded(c: Column) -> Column:
        return F.when(c.rlike(valid), F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)

    def plain(c: Column) -> Column:
        return F.regexp_replace(c, r"[?#].*$", "")

    def folder_of(path: Column) -> Column:
        found = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
        return F.when(found == "", "/").otherwise(found)

    known = pages.select(decoded(plain(F.col(address))).alias("target")).distinct()
    base, site, page = F.col("base"), F.col("site"), F.col("page")
    base_path = F.regexp_replace(base, host, "")
    links = (pages.select(key, F.regexp_extract(address, host, 1).alias("site"),
                          folder_of(F.regexp_replace(plain(F.col(address)), host, "")).alias("page"),
                          plain(_attribute(F.regexp_extract(text, BASE, 1))).alias("base"),
                          F.regexp_extract_all(F.regexp_replace(text, r"(?i)<base\s[^>]*>", ""), F.lit(link_pattern), F.lit(1)).alias("raw"))
             .where(F.coalesce(~base.startswith("//") & (~base.rlike(scheme) | (F.regexp_extract(base, host, 1) == site)), F.lit(True)))
             .withColumn("folder", F.when(base == "", page).when(base.rlike(scheme) | base.startswith("/"), folder_of(base_path))
                         .otherwise(folder_of(F.concat("page", "base"))))
             .select(key, "site", "folder", F.explode("raw").alias("raw"))
             .withColumn("path", plain(_attribute(F.col("raw"))))
             .where((F.col("path") != "") & ~F.col("path").startswith("//") & ~F.col("path").rlike(scheme))
             .withColumn("path", F.when(F.col("path").startswith("/"), F.col("path"))
                         .otherwise(F.concat("folder", "path")))
             .select(key, decoded(F.concat("site", _collapsed(F.col("path")))).alias("target"))
             .distinct())
    return links.join(known, "target", "left_anti").select(key, "target")
