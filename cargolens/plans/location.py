"""Registered location queries: embedding points everywhere, nations as candidate sites."""

from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import location as L
from ..operators.best_plans import best_plans
from ..sources import bindings as B
from .registry import register, view

KS = (1, 2, 3, 4)
RADII = (8.0, 14.0, 22.0)
SWEEP = (5.0, 18.0, 40.0)
PLAN_RADII = (15.0, 25.0, 35.0)
START = [(-8.0, -5.0), (6.0, 9.0), (1.0, -12.0)]


def _values(values):
    return "(VALUES " + ", ".join(f"(CAST({v} AS DOUBLE))" for v in values) + ")"


view("lc_points", """
SELECT vec_id AS point_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x_km, CAST(embedding[2] AS DOUBLE) * 100 AS y_km,
  CAST(label + 1 AS DOUBLE) AS demand FROM embeddings""")
view("lc_centers", """
SELECT k, label * k // 10 AS cluster, sum(demand * x_km) / sum(demand) AS x_km, sum(demand * y_km) / sum(demand) AS y_km
FROM lc_points CROSS JOIN range(1, 5) r(k) GROUP BY 1, 2""")
view("lc_near", """
SELECT point_id, demand, k, first(cluster ORDER BY d, cluster) AS cluster, min(d) AS distance_km FROM (
  SELECT point_id, demand, k, cluster, sqrt((p.x_km - c.x_km) * (p.x_km - c.x_km) + (p.y_km - c.y_km) * (p.y_km - c.y_km)) AS d
  FROM lc_points p CROSS JOIN lc_centers c) GROUP BY point_id, demand, k""")


def coverage_sql(radii, tolerance="0.0"):
    return f"""
SELECT k, radius_km, avg(CASE WHEN distance_km <= radius_km + {tolerance} THEN 1.0 ELSE 0.0 END) AS city_coverage,
  sum(CASE WHEN distance_km <= radius_km + {tolerance} THEN demand ELSE 0 END) / sum(demand) AS demand_coverage,
  sum(demand * distance_km) / sum(demand) AS weighted_distance_km,
  sum(demand * distance_km * distance_km) AS weighted_squared_loss
FROM lc_near CROSS JOIN {_values(radii)} r(radius_km) GROUP BY k, radius_km"""


view("lc_coverage", coverage_sql(RADII))
view("lc_sweep", coverage_sql(SWEEP))
view("lc_sites", """
SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS site_id, n_regionkey AS zone,
  CAST(n_nationkey * 37 % 100 AS DOUBLE) AS x_km, CAST(n_nationkey * 61 % 100 AS DOUBLE) AS y_km,
  CAST(count(*) AS DOUBLE) AS demand
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
view("lc_plans", """
SELECT a.site_id || '|' || b.site_id || '|' || c.site_id AS centers, a.site_id AS s0, b.site_id AS s1, c.site_id AS s2,
  a.x_km AS x0, a.y_km AS y0, b.x_km AS x1, b.y_km AS y1, c.x_km AS x2, c.y_km AS y2
FROM lc_sites a JOIN lc_sites b ON a.site_id < b.site_id JOIN lc_sites c ON b.site_id < c.site_id""")
view("lc_plan_near", """
SELECT centers, point_id, demand, least((p.x_km - x0) * (p.x_km - x0) + (p.y_km - y0) * (p.y_km - y0),
  (p.x_km - x1) * (p.x_km - x1) + (p.y_km - y1) * (p.y_km - y1),
  (p.x_km - x2) * (p.x_km - x2) + (p.y_km - y2) * (p.y_km - y2)) AS d2 FROM lc_plans CROSS JOIN lc_points p""")
view("lc_evaluated", f"""
SELECT radius_km, 3 AS k, centers, avg(CASE WHEN sqrt(d2) <= radius_km + 1e-9 THEN 1.0 ELSE 0.0 END) AS city_coverage,
  sum(CASE WHEN sqrt(d2) <= radius_km + 1e-9 THEN demand ELSE 0 END) / sum(demand) AS demand_coverage,
  sum(demand * sqrt(d2)) / sum(demand) AS weighted_distance_km, sum(demand * d2) AS weighted_squared_loss
FROM lc_plan_near CROSS JOIN {_values(PLAN_RADII)} r(radius_km) GROUP BY radius_km, centers""")
view("lc_pct", """
SELECT *, (weighted_squared_loss / min(weighted_squared_loss) OVER (PARTITION BY radius_km) - 1) * 100
  AS squared_loss_increase_pct FROM lc_evaluated""")
view("lc_pareto", """
SELECT e.*, NOT EXISTS (SELECT 1 FROM lc_evaluated o WHERE o.radius_km = e.radius_km
  AND o.weighted_squared_loss <= e.weighted_squared_loss + 1e-9 AND o.demand_coverage >= e.demand_coverage - 1e-9
  AND (o.weighted_squared_loss < e.weighted_squared_loss - 1e-9 OR o.demand_coverage > e.demand_coverage + 1e-9)) AS is_pareto
FROM lc_evaluated e""")
_DEMAND = ("round(demand_coverage, 12) DESC, round(weighted_squared_loss, 6), round(city_coverage, 12) DESC, "
           "round(weighted_distance_km, 9), centers")


def _first_sql(order, policy, source="lc_evaluated", keys="radius_km", extra="CAST(NULL AS DOUBLE) AS extra_loss_budget"):
    return (f"SELECT '{policy}' AS policy, * EXCLUDE (r), {extra} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY {order}) AS r FROM {source}) WHERE r = 1")


view("lc_min_loss", _first_sql("round(weighted_squared_loss, 6), round(demand_coverage, 12) DESC, centers", "min_squared_loss"))
view("lc_max_city", _first_sql(f"round(city_coverage, 12) DESC, {_DEMAND}", "max_city_coverage"))
view("lc_max_demand", _first_sql(_DEMAND, "max_demand_coverage"))
view("lc_offered", f"""
SELECT e.*, budget FROM (SELECT *, min(weighted_squared_loss) OVER (PARTITION BY radius_km) AS least FROM lc_evaluated) e
CROSS JOIN {_values((0.0, 0.002, 0.01))} b(budget) WHERE weighted_squared_loss <= least * (1 + budget) + 1e-9""")
view("lc_budget", _first_sql(_DEMAND, "budgeted_demand_coverage", "lc_offered", "radius_km, budget",
                             "budget AS extra_loss_budget"))
_PLAN_COLUMNS = ("policy, radius_km, k, centers, city_coverage, demand_coverage, weighted_distance_km, "
                 "weighted_squared_loss, extra_loss_budget")
view("lc_selected", " UNION ALL ".join(f"SELECT {_PLAN_COLUMNS} FROM {v}" for v in
                                       ("lc_min_loss", "lc_max_city", "lc_max_demand", "lc_budget")))


def points(spark, folder):
    return B.embedding_points(spark, folder)


def centers(spark, folder):
    """Weighted centroids of k runs of labels for k = 1 … 4; the ten labels are summed first."""
    w = F.col("demand")
    by_label = points(spark, folder).groupBy("label").agg(
        F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(c) for c in ("x_km", "y_km")])
    each = by_label.withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS])))
    return each.groupBy("k", F.floor(F.col("label") * F.col("k") / 10).cast("int").alias("cluster")).agg(
        *[(F.sum(c) / F.sum("w")).alias(c) for c in ("x_km", "y_km")])


def sites(spark, folder):
    return B.cities(spark, folder).withColumnRenamed("city_id", "site_id").withColumnRenamed("region", "zone")


def plans(spark, folder):
    return cut_lineage(L.evaluate_sites(points(spark, folder), sites(spark, folder), 3, PLAN_RADII))


def near(spark, folder):
    return L.nearest_center(points(spark, folder), centers(spark, folder), KS)


def _covered(spark, folder):
    return L.covered_points(points(spark, folder), cut_lineage(L.selected_plans(plans(spark, folder))), sites(spark, folder))


def _line(spark, folder):
    return points(spark, folder).withColumn("y_km", F.lit(0.0)).withColumn("zone", F.col("label"))


_COVER = "k:i radius_km:f city_coverage:f demand_coverage:f weighted_distance_km:f"
_PLAN = ("radius_km:f k:i centers:s city_coverage:f demand_coverage:f weighted_distance_km:f weighted_squared_loss:f")

register("weighted_kmeans", "k:i cluster:i x_km:f y_km:f cost:f",
         lambda s, d: L.weighted_kmeans(points(s, d), KS))

def _trace_sql():
    """Steps as lists of old and new centres with the labels of all points, until the labels repeat."""
    def d(i):
        return f"((x_km - nx[{i}]) * (x_km - nx[{i}]) + (y_km - ny[{i}]) * (y_km - ny[{i}]))"

    def mean(c, old):
        return "[" + ", ".join(f"coalesce(sum(demand * {c}) FILTER (label = {i}) / sum(demand) FILTER (label = {i}), {old}[{i + 1}])"
                               for i in range(3)) + "]"
    start = [str([float(v[i]) for v in START]) + "::DOUBLE[]" for i in range(2)]
    return f"""
WITH RECURSIVE t AS (
  SELECT 0 AS step, {start[0]} AS ox, {start[1]} AS oy, {start[0]} AS nx, {start[1]} AS ny, [0, 0, 0]::BIGINT[] AS members,
    []::INTEGER[] AS labels, FALSE AS done
  UNION ALL
  SELECT step + 1, nx, ny, fresh_x, fresh_y, counts, fresh, fresh = labels FROM (
    SELECT step, nx, ny, labels, {mean("x_km", "nx")} AS fresh_x, {mean("y_km", "ny")} AS fresh_y,
      [count(*) FILTER (label = 0), count(*) FILTER (label = 1), count(*) FILTER (label = 2)] AS counts,
      list(label ORDER BY point_id) AS fresh
    FROM (SELECT t.*, point_id, x_km, y_km, demand, CAST(CASE WHEN {d(1)} <= {d(2)} AND {d(1)} <= {d(3)} THEN 0
            WHEN {d(2)} <= {d(3)} THEN 1 ELSE 2 END AS INTEGER) AS label
          FROM t CROSS JOIN (SELECT point_id, x_km, y_km, demand FROM lc_points) p WHERE NOT done)
    GROUP BY step, nx, ny, labels))
SELECT step, i - 1 AS cluster, ox[i] AS old_x, oy[i] AS old_y, members[i] AS members, nx[i] AS new_x, ny[i] AS new_y, TRUE AS converged
FROM t CROSS JOIN range(1, 4) r(i) WHERE step > 0"""


register("lloyd_trace", "step:i cluster:i old_x:f old_y:f members:i new_x:f new_y:f converged:b",
         lambda s, d: L.lloyd_trace(points(s, d), START), _trace_sql())
register("nearest_center", "k:i point_id:i cluster:i distance_km:f", near, "lc_near")
register("coverage", _COVER, lambda s, d: L.coverage(near(s, d), RADII), "lc_coverage")
register("weighted_distance", "k:i weighted_distance_km:f weighted_squared_loss:f",
         lambda s, d: L.weighted_distance(near(s, d)), """
SELECT k, sum(demand * distance_km) / sum(demand) AS weighted_distance_km,
  sum(demand * distance_km * distance_km) AS weighted_squared_loss FROM lc_near GROUP BY k""")
register("enumerate_sites", "k:i centers:s", lambda s, d: L.enumerate_sites(sites(s, d), 3),
         "SELECT 3 AS k, centers FROM lc_plans")
register("evaluate_sites", _PLAN, plans, "lc_evaluated")
register("loss_increase_pct", "radius_km:f k:i centers:s squared_loss_increase_pct:f",
         lambda s, d: L.loss_increase_pct(plans(s, d)), "lc_pct")
register("pareto_frontier", "radius_km:f k:i centers:s is_pareto:b", lambda s, d: L.pareto_frontier(plans(s, d)), "lc_pareto")
register("select_site_min_loss", "policy:s " + _PLAN, lambda s, d: L.select_site_min_loss(plans(s, d)), "lc_min_loss")
register("select_site_max_city", "policy:s " + _PLAN, lambda s, d: L.select_site_max_city(plans(s, d)), "lc_max_city")
register("select_site_max_demand", "policy:s " + _PLAN, lambda s, d: L.select_site_max_demand(plans(s, d)), "lc_max_demand")
register("select_site_budget", "policy:s extra_loss_budget:f " + _PLAN,
         lambda s, d: L.select_site_budget(plans(s, d)), "lc_budget")
register("covered_points", "policy:s radius_km:f extra_loss_budget:f point_id:i", _covered, """
SELECT policy, radius_km, extra_loss_budget, n.point_id FROM lc_selected s JOIN lc_plan_near n ON s.centers = n.centers
AND sqrt(n.d2) <= s.radius_km + 1e-9""")
register("policy_delta", "radius_km:f k:i pareto_plans:i squared_loss_increase_pct:f city_coverage_gain_points:f "
         "demand_coverage_gain_points:f weighted_distance_reduction_km:f", lambda s, d: L.policy_delta(plans(s, d)), """
SELECT a.radius_km, a.k, (SELECT count(*) FROM lc_pareto p WHERE p.radius_km = a.radius_km AND is_pareto) AS pareto_plans,
  (b.weighted_squared_loss / a.weighted_squared_loss - 1) * 100 AS squared_loss_increase_pct,
  100 * (b.city_coverage - a.city_coverage) AS city_coverage_gain_points,
  100 * (b.demand_coverage - a.demand_coverage) AS demand_coverage_gain_points,
  a.weighted_distance_km - b.weighted_distance_km AS weighted_distance_reduction_km
FROM lc_min_loss a JOIN lc_max_demand b ON a.radius_km = b.radius_km""")
register("snap_centers", "k:i cluster:i site_id:s squared_distance:f",
         lambda s, d: L.snap_centers(centers(s, d), sites(s, d), 3), """
WITH c AS (SELECT cluster, x_km AS x, y_km AS y FROM lc_centers WHERE k = 3),
o AS (SELECT cluster, site_id, (x - x_km) * (x - x_km) + (y - y_km) * (y - y_km) AS d FROM c CROSS JOIN lc_sites),
t AS (SELECT a.site_id AS s0, b.site_id AS s1, e.site_id AS s2, a.d AS d0, b.d AS d1, e.d AS d2
  FROM o a JOIN o b ON a.cluster = 0 AND b.cluster = 1 AND a.site_id <> b.site_id
  JOIN o e ON e.cluster = 2 AND e.site_id <> a.site_id AND e.site_id <> b.site_id
  ORDER BY round(a.d + b.d + e.d, 9), list_sort([a.site_id, b.site_id, e.site_id]), s0, s1 LIMIT 1)
SELECT 3 AS k, v.cluster, v.site_id, v.squared_distance FROM t,
  LATERAL (VALUES (0, s0, d0), (1, s1, d1), (2, s2, d2)) v(cluster, site_id, squared_distance)""")
view("lc_line", """
SELECT zone, x, w, row_number() OVER w AS i, sum(w) OVER w AS sw, sum(w * x) OVER w AS swx, sum(w * x * x) OVER w AS swxx
FROM (SELECT label AS zone, x_km AS x, sum(demand) AS w FROM lc_points GROUP BY label, x_km) WINDOW w AS (PARTITION BY zone ORDER BY x)""")
view("lc_segment", """
SELECT zone, i, j, sw, swx / sw AS c, swxx - swx * swx / sw AS loss FROM (
  SELECT a.zone, a.i, b.i AS j, b.sw - a.sw + a.w AS sw, b.swx - a.swx + a.w * a.x AS swx, b.swxx - a.swxx + a.w * a.x * a.x AS swxx
  FROM lc_line a JOIN lc_line b ON a.zone = b.zone AND a.i <= b.i)""")
register("optimal_1d_centers", "zone:i k:i cluster:i x_km:f weight:f loss:f",
         lambda s, d: L.optimal_1d_centers(_line(s, d), (2, 3)), """
WITH n AS (SELECT zone, max(i) AS m FROM lc_line GROUP BY zone),
two AS (SELECT * FROM (SELECT a.zone, a.c AS c0, a.sw AS w0, a.loss AS l0, b.c AS c1, b.sw AS w1, b.loss AS l1,
  row_number() OVER (PARTITION BY a.zone ORDER BY a.loss + b.loss) AS r
  FROM lc_segment a JOIN lc_segment b ON a.zone = b.zone AND b.i = a.j + 1 JOIN n ON n.zone = a.zone
  WHERE a.i = 1 AND b.j = n.m) WHERE r = 1),
three AS (SELECT * FROM (SELECT a.zone, a.c AS c0, a.sw AS w0, a.loss AS l0, b.c AS c1, b.sw AS w1, b.loss AS l1,
  e.c AS c2, e.sw AS w2, e.loss AS l2, row_number() OVER (PARTITION BY a.zone ORDER BY a.loss + b.loss + e.loss) AS r
  FROM lc_segment a JOIN lc_segment b ON a.zone = b.zone AND b.i = a.j + 1
  JOIN lc_segment e ON e.zone = b.zone AND e.i = b.j + 1 JOIN n ON n.zone = a.zone
  WHERE a.i = 1 AND e.j = n.m) WHERE r = 1)
SELECT zone, 2 AS k, v.* FROM two, LATERAL (VALUES (0, c0, w0, l0), (1, c1, w1, l1)) v(cluster, x_km, weight, loss)
UNION ALL SELECT zone, 3, v.* FROM three,
  LATERAL (VALUES (0, c0, w0, l0), (1, c1, w1, l1), (2, c2, w2, l2)) v(cluster, x_km, weight, loss)""")
register("max_city_cover_alt_order", "policy:s " + _PLAN, lambda s, d: L.max_city_cover_alt_order(plans(s, d)),
         _first_sql("round(city_coverage, 12) DESC, round(demand_coverage, 12) DESC, round(weighted_distance_km, 9), centers",
                    "max_city_coverage_alt"))
register("best_plans", "policy:s extra_loss_budget:f " + _PLAN,
         lambda s, d: best_plans(points(s, d), sites(s, d), 3, PLAN_RADII),
         f"SELECT {_PLAN_COLUMNS} FROM lc_selected UNION ALL SELECT {_PLAN_COLUMNS} FROM (" + _first_sql(
             "round(city_coverage, 12) DESC, round(demand_coverage, 12) DESC, round(weighted_distance_km, 9), centers",
             "max_city_coverage_alt") + ")")


def _comparison(spark, folder):
    flat = sites(spark, folder).select("site_id", "x_km", F.lit(0.0).alias("y_km"))
    return L.method_comparison(_line(spark, folder).drop("zone"), flat, (2, 3), 5.0)


register("method_comparison", "method:s k:i constraint:s radius_km:f city_coverage:f demand_coverage:f "
         "weighted_distance_km:f weighted_squared_loss:f enumerated_solutions:i", _comparison)
register("radius_sweep", _COVER + " weighted_squared_loss:f", lambda s, d: L.coverage(near(s, d), SWEEP), "lc_sweep")
register("coverage_monotone_check", _COVER,
         lambda s, d: L.coverage_monotone_check(L.coverage(near(s, d), RADII + SWEEP)), """
SELECT * FROM (SELECT *, lag(city_coverage) OVER w > city_coverage OR lag(demand_coverage) OVER w > demand_coverage AS falls
  FROM (SELECT * FROM lc_coverage UNION ALL SELECT * FROM lc_sweep) WINDOW w AS (PARTITION BY k ORDER BY radius_km))
WHERE falls""")
