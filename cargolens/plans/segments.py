"""Registered customer queries: customers of the orders, two observation periods."""

from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import segments as G
from ..sources import bindings as B
from .registry import register, view

CUTOFF = "2001-09-01"
PERIODS = {"first": "1998-01-01", "later": CUTOFF}
Z = [f"z_{c}" for c in G.FEATURES]

view("cs_volume", """
SELECT o_custkey AS customer_id, sum(l_quantity) AS business_volume
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
view("cs_features", f"""
SELECT w.customer_id, count(DISTINCT waybill_id) AS orders, max(date) AS last_date, sum(quantity) AS summed_quantity,
  any_value(business_volume) AS business_volume, DATE '{CUTOFF}' - max(date) AS recency_days
FROM wb_waybills w JOIN cs_volume v ON w.customer_id = v.customer_id GROUP BY w.customer_id""")
view("cs_partial", """
SELECT w.customer_id, sum(quantity) AS summed_quantity, any_value(business_volume) AS business_volume
FROM wb_waybills w JOIN cs_volume v ON w.customer_id = v.customer_id
WHERE date < DATE '1998-01-01' GROUP BY w.customer_id""")
view("cs_periods", """
SELECT period, customer_id, count(DISTINCT waybill_id) AS orders, sum(quantity) AS business_volume,
  any_value(cutoff) - max(date) AS recency_days
FROM wb_waybills JOIN (VALUES """ + ", ".join(f"('{p}', DATE '{c}')" for p, c in PERIODS.items()) + """) v(period, cutoff)
ON date < cutoff WHERE customer_id IN (SELECT customer_id FROM wb_waybills WHERE date < DATE '1998-01-01')
GROUP BY period, customer_id""")


def _scaled_sql(reference):
    over = "(PARTITION BY period)" if reference is None else ""
    if reference is None:
        cols = ", ".join(f"({c} - avg({c}) OVER {over}) / CASE WHEN stddev_pop({c}) OVER {over} = 0 THEN 1 "
                         f"ELSE stddev_pop({c}) OVER {over} END AS z_{c}" for c in G.FEATURES)
        return f"SELECT *, {cols} FROM cs_periods"
    cols = ", ".join(f"(p.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS z_{c}" for c in G.FEATURES)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in G.FEATURES)
    return f"SELECT p.*, {cols} FROM cs_periods p CROSS JOIN (SELECT {stats} FROM cs_periods WHERE period = '{reference}')"


view("cs_scaled", _scaled_sql(None))
view("cs_scaled_first", _scaled_sql("first"))
view("cs_limits", """
SELECT period, quantile_cont(business_volume, 1.0::DOUBLE / 3) AS q1, quantile_cont(business_volume, 2.0::DOUBLE / 3) AS q2
FROM cs_periods GROUP BY period""")
view("cs_rule", """
SELECT s.*, CASE WHEN s.business_volume <= r.q1 THEN 0 WHEN s.business_volume <= r.q2 THEN 1 ELSE 2 END AS volume_refit,
  CASE WHEN s.business_volume <= f.q1 THEN 0 WHEN s.business_volume <= f.q2 THEN 1 ELSE 2 END AS volume_fixed
FROM cs_scaled_first s JOIN cs_limits r ON s.period = r.period JOIN cs_limits f ON f.period = 'first'""")
# Stored centres: the mean of each volume third in the first period.
view("cs_centers", "SELECT volume_refit AS cluster, " + ", ".join(f"avg({z}) AS {z}" for z in Z)
     + " FROM cs_rule WHERE period = 'first' GROUP BY 1")
view("cs_fixed", """
SELECT period, customer_id, first(cluster ORDER BY d, cluster) AS cluster FROM (
  SELECT s.period, s.customer_id, c.cluster, sqrt(""" + " + ".join(f"(s.{z} - c.{z}) * (s.{z} - c.{z})" for z in Z) + """) AS d
  FROM cs_scaled_first s CROSS JOIN cs_centers c) GROUP BY period, customer_id""")
view("cs_long", """
SELECT r.period, r.customer_id, v.method, v.cluster FROM cs_rule r JOIN cs_fixed f
ON r.period = f.period AND r.customer_id = f.customer_id,
LATERAL (VALUES ('centers_fixed', f.cluster), ('volume_fixed', r.volume_fixed), ('volume_refit', r.volume_refit)) v(method, cluster)""")


def silhouette_sql(points: str, keys: list[str], ident: str, features: list[str]) -> str:
    """Mean silhouette straight from the definition over all pairs."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys) or "TRUE"
    g = ", ".join(keys)
    ga = ", ".join(f"a.{k}" for k in keys)
    d = "sqrt(" + " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in features) + ")"
    return f"""
SELECT {g}, avg(s) AS silhouette FROM (
  SELECT {g}, {ident}, CASE WHEN max(n) FILTER (own) = 1 THEN 0.0 ELSE
      coalesce((min(total / n) FILTER (NOT own) - max(total / (n - 1)) FILTER (own))
        / nullif(greatest(min(total / n) FILTER (NOT own), max(total / (n - 1)) FILTER (own)), 0), 0.0) END AS s
  FROM (SELECT {ga}, a.{ident}, b.cluster, a.cluster = b.cluster AS own, count(*) AS n, sum({d}) AS total
        FROM {points} a JOIN {points} b ON {on} GROUP BY ALL) GROUP BY {g}, {ident}) GROUP BY {g}"""


def ari_sql(labels: str, a: str, b: str, keys: list[str]) -> str:
    g = ", ".join(keys)
    on = " AND ".join(f"t.{k} = x.{k}" for k in keys)
    on_b = " AND ".join(f"t.{k} = y.{k}" for k in keys)
    p = "n * (n - 1) / 2.0"
    return f"""
SELECT t.*, coalesce((t.both_pairs - x.s * y.s / (t.m * (t.m - 1) / 2.0))
  / nullif((x.s + y.s) / 2 - x.s * y.s / (t.m * (t.m - 1) / 2.0), 0), 1.0) AS ari
FROM (SELECT {g}, sum({p}) AS both_pairs, CAST(sum(n) AS DOUBLE) AS m
      FROM (SELECT {g}, {a}, {b}, CAST(count(*) AS DOUBLE) AS n FROM {labels} GROUP BY {g}, {a}, {b}) GROUP BY {g}) t
JOIN (SELECT {g}, sum({p}) AS s FROM (SELECT {g}, {a}, CAST(count(*) AS DOUBLE) AS n FROM {labels} GROUP BY {g}, {a}) GROUP BY {g}) x ON {on}
JOIN (SELECT {g}, sum({p}) AS s FROM (SELECT {g}, {b}, CAST(count(*) AS DOUBLE) AS n FROM {labels} GROUP BY {g}, {b}) GROUP BY {g}) y ON {on_b}"""


view("cs_points", "SELECT period, customer_id, volume_refit AS cluster, " + ", ".join(Z) + " FROM cs_rule")
view("cs_silhouette", silhouette_sql("cs_points", ["period"], "customer_id", Z))
view("cs_ari_rows", "SELECT r.period, r.volume_refit, f.cluster AS centers_fixed FROM cs_rule r JOIN cs_fixed f "
     "ON r.period = f.period AND r.customer_id = f.customer_id")
view("cs_ari", ari_sql("cs_ari_rows", "volume_refit", "centers_fixed", ["period"]))


def features(spark, folder):
    return G.customer_features(B.waybills(spark, folder), B.business_volume(spark, folder), CUTOFF)


def periods(spark, folder):
    return G.period_features(B.waybills(spark, folder), PERIODS)


def ruled(spark, folder):
    """Scaled features of both periods (first period's scaling) with both volume rules.

    Written once: the label queries read it several times.
    """
    scaled = G.standardize(cut_lineage(periods(spark, folder)), reference="first")
    return G.volume_bands(scaled, "first")


def stored_centers(table):
    return (table.where("period = 'first'").groupBy(F.col("volume_refit").alias("cluster"))
            .agg(*[F.avg(z).alias(z) for z in Z]))


def fixed(spark, folder):
    table = cut_lineage(periods(spark, folder))
    rules = G.volume_bands(G.standardize(table, reference="first"), "first")
    return G.apply_fixed_model(table, stored_centers(rules), "first")


def with_rules(spark, folder):
    """Every label of a customer and period in one row."""
    table = cut_lineage(ruled(spark, folder))
    return G.label_by_centers(table, stored_centers(table)).withColumnRenamed("cluster", "centers_fixed")


def volume_points(spark, folder):
    return ruled(spark, folder).select("period", "customer_id", *Z, F.col("volume_refit").alias("cluster"))


def _partial(spark, folder):
    early = B.waybills(spark, folder).where(F.col("date") < F.lit("1998-01-01").cast("date"))
    return G.volume_reconcile_check(G.customer_features(early, B.business_volume(spark, folder), "1998-01-01"))


def _two_sources(spark, folder):
    """Waybills against a second source whose unit, period or value depends on the market segment."""
    left = (B.waybills(spark, folder).groupBy("customer_id").agg(F.sum("quantity").alias("quantity"))
            .select("customer_id", F.lit("to_2001").alias("period"), "quantity", F.lit("unit").alias("unit")))
    segment = B.table(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")
    tens = F.col("c_mktsegment") == "BUILDING"
    right = (segment.join(B.business_volume(spark, folder), "customer_id", "left")
             .select("customer_id",
                     F.when(F.col("c_mktsegment") == "MACHINERY", "to_2000").otherwise("to_2001").alias("period"),
                     F.when(tens, F.col("business_volume") / 10)
                     .when(F.col("c_mktsegment") == "FURNITURE", F.col("business_volume") + 10)
                     .otherwise(F.col("business_volume")).alias("quantity"),
                     F.when(tens, "ten_units").otherwise("unit").alias("unit")))
    return G.unit_period_reconcile(left, right, {("unit", "ten_units"): 10.0})


def _drift(spark, folder):
    return G.labelled_drift(with_rules(spark, folder), Z, "first", ["centers_fixed", "volume_fixed", "volume_refit"])


register("customer_features", "customer_id:i orders:i last_date:d summed_quantity:f business_volume:f recency_days:i",
         features, "cs_features")
register("period_features", "period:s customer_id:i orders:i business_volume:f recency_days:i", periods, "cs_periods")
register("volume_reconcile_check", "customer_id:i summed_quantity:f business_volume:f", _partial, """
SELECT * FROM cs_partial WHERE NOT abs(summed_quantity - business_volume) <= 1e-8 + 1e-5 * abs(business_volume)""")
register("standardize", "period:s customer_id:i z_orders:f z_business_volume:f z_recency_days:f",
         lambda s, d: G.standardize(periods(s, d)), "cs_scaled")
register("standardize_reference", "period:s customer_id:i z_orders:f z_business_volume:f z_recency_days:f",
         lambda s, d: G.standardize(periods(s, d), reference="first"), "cs_scaled_first")
register("kmeans_sweep", "method:s k:i actual_clusters:i silhouette:f reason:s",
         lambda s, d: G.kmeans_sweep(features(s, d)))
register("silhouette", "period:s silhouette:f", lambda s, d: G.silhouette(volume_points(s, d), Z, ["period"]), "cs_silhouette")
# The later rule also scores one single group: all customers together.
register("score_or_reason", "period:s actual_clusters:i n:i silhouette:f reason:s",
         lambda s, d: G.silhouette(volume_points(s, d).withColumn(
             "cluster", F.when(F.col("period") == "first", F.col("cluster")).otherwise(0)), Z, ["period"]), """
SELECT p.period, actual_clusters, n, CASE WHEN p.period = 'first' THEN silhouette END AS silhouette,
  CASE WHEN actual_clusters < 2 OR actual_clusters >= n THEN actual_clusters || ' groups outside 2..n-1' END AS reason
FROM (SELECT period, count(DISTINCT CASE WHEN period = 'first' THEN cluster ELSE 0 END) AS actual_clusters, count(*) AS n
      FROM cs_points GROUP BY period) p JOIN cs_silhouette s ON p.period = s.period""")
register("volume_terciles", "period:s customer_id:i business_volume:f volume_rule:i",
         lambda s, d: G.volume_terciles(periods(s, d)), "SELECT *, volume_refit AS volume_rule FROM cs_rule")
register("adjusted_rand", "period:s n:i ari:f",
         lambda s, d: G.adjusted_rand(with_rules(s, d), "volume_refit", "centers_fixed", ["period"]),
         "SELECT *, m AS n FROM cs_ari")
register("segment_profiles", "period:s cluster:i customer_count:i mean_orders:f mean_volume:f mean_recency:f",
         lambda s, d: G.segment_profiles(ruled(s, d).withColumnRenamed("volume_refit", "cluster"), ["period"]), """
SELECT period, volume_refit AS cluster, count(*) AS customer_count, avg(orders) AS mean_orders,
  avg(business_volume) AS mean_volume, avg(recency_days) AS mean_recency FROM cs_rule GROUP BY 1, 2""")
register("seed_stability", "seed:i ari:f", lambda s, d: G.seed_stability(features(s, d)))
register("single_init_stability", "seed:i ari:f", lambda s, d: G.seed_stability(features(s, d), seeds=(0, 1, 2, 3, 4, 5), restarts=1))
register("single_init_labels", "customer_id:i seed:i cluster:i",
         lambda s, d: G.single_init_labels(features(s, d)))
register("apply_fixed_model", "period:s customer_id:i cluster:i", fixed, "cs_fixed")
register("refit_centers", "period:s cluster:i z_orders:f z_business_volume:f z_recency_days:f",
         lambda s, d: G.refit_centers(periods(s, d), "later", "first"))
register("volume_bands", "period:s customer_id:i volume_fixed:i volume_refit:i", ruled, "cs_rule")
register("drift_metrics", "period:s method:s silhouette:f ari_to_first_period:f ari_to_volume_refit:f",
         lambda s, d: G.drift_metrics(periods(s, d), "first"))
register("assignment_long", "period:s customer_id:i method:s cluster:i",
         lambda s, d: G.assignment_long(with_rules(s, d), ["centers_fixed", "volume_fixed", "volume_refit"]), "cs_long")
register("unit_period_reconcile", "customer_id:i left_period:s left_quantity:f left_unit:s right_period:s right_quantity:f "
         "right_unit:s known_unit_factor:f status:s", _two_sources, """
SELECT *, CASE WHEN left_quantity IS NULL OR right_quantity IS NULL THEN 'missing_value'
  WHEN left_period <> right_period THEN 'different_period'
  WHEN abs(left_quantity - right_quantity * known_unit_factor) <= 1e-8 + 1e-5 * abs(right_quantity * known_unit_factor)
    THEN CASE WHEN known_unit_factor <> 1 THEN 'convertible' ELSE 'equal' END ELSE 'review' END AS status
FROM (SELECT *, CASE WHEN left_unit = right_unit THEN 1.0 WHEN right_unit = 'ten_units' AND left_unit = 'unit' THEN 10.0 END AS known_unit_factor
  FROM (SELECT customer_id, 'to_2001' AS left_period, sum(quantity) AS left_quantity, 'unit' AS left_unit
        FROM wb_waybills GROUP BY 1) l
  FULL JOIN (SELECT c_custkey AS customer_id,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'to_2000' ELSE 'to_2001' END AS right_period,
      CASE WHEN c_mktsegment = 'BUILDING' THEN business_volume / 10 WHEN c_mktsegment = 'FURNITURE' THEN business_volume + 10
        ELSE business_volume END AS right_quantity,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'ten_units' ELSE 'unit' END AS right_unit
    FROM customer LEFT JOIN cs_volume ON c_custkey = customer_id) r USING (customer_id))""")
# The drift of given labels has an exact SQL form.
view("cs_drift_points", "SELECT l.period || '|' || l.method AS pm, l.customer_id, l.cluster, "
     + ", ".join(f"s.{z}" for z in Z) + " FROM cs_long l JOIN cs_scaled_first s ON l.period = s.period AND l.customer_id = s.customer_id")
view("cs_drift_sil", silhouette_sql("cs_drift_points", ["pm"], "customer_id", Z))
view("cs_drift_labels", """
SELECT l.period || '|' || l.method AS pm, l.cluster, f.cluster AS first_cluster, r.cluster AS rule_cluster
FROM cs_long l JOIN cs_long f ON f.period = 'first' AND f.method = l.method AND f.customer_id = l.customer_id
JOIN cs_long r ON r.period = l.period AND r.method = 'volume_refit' AND r.customer_id = l.customer_id""")
view("cs_drift_first", ari_sql("cs_drift_labels", "first_cluster", "cluster", ["pm"]))
view("cs_drift_rule", ari_sql("cs_drift_labels", "rule_cluster", "cluster", ["pm"]))
register("labelled_drift", "period:s method:s silhouette:f ari_to_first_period:f ari_to_volume_refit:f", _drift, """
SELECT split_part(s.pm, '|', 1) AS period, split_part(s.pm, '|', 2) AS method, s.silhouette,
  f.ari AS ari_to_first_period, r.ari AS ari_to_volume_refit
FROM cs_drift_sil s JOIN cs_drift_first f ON s.pm = f.pm JOIN cs_drift_rule r ON s.pm = r.pm""")
