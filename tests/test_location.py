from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import assignment, frontier, grid, intervals, location as L
from cargolens.operators.intervals import split_line
from cargolens.sources.tables import ContractError

# The published line instance and, below, its two recorded losses.
LINE_X = [7, 8, 15, 29, 41, 46, 49, 64, 72]
LINE_W = [77, 57, 61, 63, 76, 36, 57, 9, 13]


def points(spark, rows):
    return spark.createDataFrame([(f"P{i}", float(x), float(y), float(w)) for i, (x, y, w) in enumerate(rows)],
                                 "point_id string, x_km double, y_km double, demand double")


def line(spark):
    return points(spark, [(x, 0, w) for x, w in zip(LINE_X, LINE_W)])


def plans(spark, rows):
    return spark.createDataFrame([(5.0, 3, n, c, c, 1.0, l) for n, l, c in rows],
                                 "radius_km double, k int, centers string, city_coverage double, "
                                 "demand_coverage double, weighted_distance_km double, weighted_squared_loss double")


def test_shares_of_points_and_of_demand_inside_a_radius(spark):
    p = points(spark, [(0, 0, 2), (5, 12, 3), (8, 15, 5)])  # 0, 13 and 17 from the centre
    centers = spark.createDataFrame([(1, 0, 0.0, 0.0)], "k int, cluster int, x_km double, y_km double")
    near = L.nearest_center(p, centers, (1,))
    got = {r.radius_km: r for r in L.coverage(near, (12.5, 13.0, 17.0)).collect()}
    assert [round(got[r].city_coverage * 3) for r in (12.5, 13.0, 17.0)] == [1, 2, 3]
    assert [got[r].demand_coverage for r in (12.5, 13.0, 17.0)] == [0.2, 0.5, 1.0]
    assert got[13.0].weighted_distance_km == (3 * 13 + 5 * 17) / 10
    assert got[13.0].weighted_squared_loss == 3 * 169 + 5 * 289
    assert L.coverage_monotone_check(L.coverage(near, (2.0, 13.0, 16.0, 40.0))).count() == 0


def test_ties_choose_the_lower_cluster(spark):
    centers = spark.createDataFrame([(2, 1, 2.0, 0.0), (2, 0, 0.0, 0.0)], "k int, cluster int, x_km double, y_km double")
    assert L.nearest_center(points(spark, [(1, 0, 1)]), centers, (2,)).first().cluster == 0


def test_lloyd_trace_of_four_numbers(spark):
    p = points(spark, [(v, 0, 1) for v in (1, 2, 8, 9)])
    rows = L.lloyd_trace(p, [(1.0, 0.0), (2.0, 0.0)]).orderBy("step", "cluster").collect()
    assert len(rows) == 6 and [r.new_x for r in rows[-2:]] == [1.5, 8.5]
    assert [r.old_x for r in rows[2:4]] == [1.0, 19 / 3]


def test_plans_equal_brute_force(spark):
    p = line(spark)
    sites = p.withColumnRenamed("point_id", "site_id")
    assert L.enumerate_sites(sites, 3).count() == 84
    got = {(r.centers, r.radius_km): r for r in L.evaluate_sites(p, sites, 3, (3.0, 5.0)).collect()}
    x, w = np.array(LINE_X, float), np.array(LINE_W, float)
    for ids in combinations(range(9), 3):
        d = np.abs(x[:, None] - x[list(ids)]).min(axis=1)
        for radius in (3.0, 5.0):
            r = got["|".join(f"P{i}" for i in ids), radius]
            assert np.isclose(r.city_coverage, (d <= radius).mean())
            assert np.isclose(r.demand_coverage, w[d <= radius].sum() / w.sum())
            assert np.isclose(r.weighted_squared_loss, (w * d * d).sum())
    with pytest.raises(ContractError):
        L.evaluate_sites(p, sites, 3, (3.0,), max_plans=83)
    with pytest.raises(Exception, match="more than 83 plans"):
        L.enumerate_sites(sites, 3, max_plans=83).collect()


def test_dominance_tolerance_and_ties(spark):
    df = plans(spark, [("p", 40.0, 0.6), ("q", 44.0, 0.9), ("r", 40 + 5e-10, 0.6), ("s", 41.0, 0.6), ("t", 44.0, 0.75)])
    assert {r.centers for r in L.pareto_frontier(df).where("not is_pareto").collect()} == {"s", "t"}
    rng = np.random.default_rng(1)
    rows = [(f"R{i}", float(rng.integers(1, 30)) * 1e8, float(rng.integers(1, 12)) / 12) for i in range(150)]
    got = {r.centers: r.is_pareto for r in L.pareto_frontier(plans(spark, rows)).collect()}
    for n, l, c in rows:
        beaten = any(a <= l + 1e-9 and b >= c - 1e-9 and (a < l - 1e-9 or b > c + 1e-9) for _, a, b in rows)
        assert got[n] == (not beaten)


def test_loss_budgets(spark):
    df = plans(spark, [("m", 250.0, 0.2), ("n", 252.4, 0.55), ("o", 252.5, 0.8), ("u", 252.6, 0.95)])
    got = {r.extra_loss_budget: r.centers for r in L.select_site_budget(df, (0.0, 0.0097, 0.01, 0.5)).collect()}
    assert got == {0.0: "m", 0.0097: "n", 0.01: "o", 0.5: "u"}
    assert L.select_site_max_demand(df).first().centers == "u"
    with pytest.raises(ValueError, match="must not be negative"):
        L.select_site_budget(df, (0.1, -0.5))


def test_snapping_equals_all_permutations(spark):
    rng = np.random.default_rng(4)
    for trial in range(2):
        s = rng.integers(0, 12, (8, 2)).astype(float)
        c = rng.integers(0, 12, (3, 2)).astype(float)
        sites = spark.createDataFrame([(f"S{i}", *map(float, v)) for i, v in enumerate(s)],
                                      "site_id string, x_km double, y_km double")
        centers = spark.createDataFrame([(3, i, *map(float, v)) for i, v in enumerate(c)],
                                        "k int, cluster int, x_km double, y_km double")
        got = sum(r.squared_distance for r in L.snap_centers(centers, sites, 3).collect())
        want = min(((s[list(ids)] - c) ** 2).sum() for ids in permutations(range(8), 3))
        assert np.isclose(got, want)


def test_exact_line_split_and_recorded_losses(spark):
    rows = L.optimal_1d_centers(line(spark).withColumn("zone", F.lit(1)), (2, 3)).collect()
    loss = {k: sum(r.loss for r in rows if r.k == k) for k in (2, 3)}
    assert np.isclose(loss[2], 32366.519281) and np.isclose(loss[3], 15699.885957)
    rng = np.random.default_rng(8)
    x, w = np.sort(rng.choice(100, 12, replace=False)).astype(float), rng.integers(1, 9, 12).astype(float)

    def cost(a, b):
        m = np.average(x[a:b], weights=w[a:b])
        return (w[a:b] * (x[a:b] - m) ** 2).sum()

    best = min(sum(cost(a, b) for a, b in zip((0, *cuts), (*cuts, 12))) for cuts in combinations(range(1, 12), 3))
    assert np.isclose(sum(s[2] for s in split_line(x, w, 4)), best)


def test_runs_share_passes_and_equal_a_plain_lloyd(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (5, 1), (2, 6))])
    w = rng.uniform(0.5, 3, len(x))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, w)], "x double, y double, w double")
    starts = [x[:3].copy(), x[[0, 70, 130]].copy(), x[[5, 100]].copy()]
    for start, (cost, centers) in zip(starts, L.lloyd_runs(df, ["x", "y"], starts, "w", tolerance=0.0)):
        own = start.copy()
        for _ in range(300):
            label = ((x[:, None] - own[None]) ** 2).sum(2).argmin(1)
            new = np.array([np.average(x[label == i], axis=0, weights=w[label == i]) if (label == i).any() else own[i]
                            for i in range(len(own))])
            if np.allclose(new, own, atol=0, rtol=0):
                break
            own = new
        assert np.allclose(centers, own)
        squared = ((x[:, None] - own[None]) ** 2).sum(2)
        assert np.isclose(cost, (w * squared.min(1)).sum())


def test_best_run_is_not_above_any_start_and_centres_are_means(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (120, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "x double, y double")
    cost, centers = L.best_kmeans(df, ["x", "y"], 4, restarts=6)
    runs = L.lloyd_runs(df, ["x", "y"], L.kmeans_starts(df, ["x", "y"], [(4, 42 + i) for i in range(6)]))
    assert np.isclose(cost, min(c for c, _ in runs))
    label = ((x[:, None] - np.array(centers)[None]) ** 2).sum(2).argmin(1)
    for i, c in enumerate(centers):
        assert np.allclose(x[label == i].mean(0), c, atol=0.05)


def test_one_site_plans_are_limited_by_their_number_only(spark):
    assert L._site_limit(1, 2_000_000) == 2_000_000
    assert L._site_limit(3, 84) == 9


def test_lloyd_runs_until_labels_repeat_and_says_so(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in rng.uniform(0, 9, (200, 2))],
                               "x_km double, y_km double, demand double")
    start = [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1)]
    whole = L.lloyd_trace(df, start)
    assert whole.where("not converged").count() == 0
    assert L.lloyd_trace(df, start, 2).where("converged").count() == 0


@pytest.mark.parametrize("far", [[(1e4, 0.0)], [(1e3, 0.0), (0.0, 1e5), (-1e7, 0.0)]])
def test_starts_meet_far_groups_of_a_ten_thousandth_of_the_rows(spark, far):
    n, few = 60_000, 6
    bulk = spark.range(n).select((F.rand(1) * 2 - 1).alias("x"), (F.rand(2) * 2 - 1).alias("y"))
    groups = spark.createDataFrame([(a + i * 1e-3, b) for a, b in far for i in range(few)], "x double, y double")
    df = bulk.unionByName(groups).persist()
    cost, centers = L.best_kmeans(df, ["x", "y"], 1 + len(far), restarts=3)
    df.unpersist()
    assert cost < n
    for a, b in far:
        assert min((x - a) ** 2 + (y - b) ** 2 for x, y in centers) < 1


def test_assignment_equals_all_permutations_with_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 5))
        cost = rng.integers(0, 5, (k, n)).tolist()
        got = assignment.assign([[(s, c) for s, c in enumerate(row)] for row in cost])
        if n < k:
            assert got is None
            continue
        assert len(set(got)) == k
        assert sum(cost[i][s] for i, s in enumerate(got)) == min(
            sum(cost[i][s] for i, s in enumerate(p)) for p in permutations(range(n), k))


def test_snapping_breaks_ties_by_ids_and_ignores_unusable_sites(spark):
    rng = np.random.default_rng(9)
    for trial in range(3):
        s, c = rng.integers(0, 3, (7, 2)).astype(float), rng.integers(0, 3, (3, 2)).astype(float)
        rows = [(f"S{i}", *map(float, v)) for i, v in enumerate(s)]
        sites = spark.createDataFrame(rows + [(None, 0.0, 0.0), ("A", None, 1.0), ("B", float("nan"), 1.0)],
                                      "site_id string, x_km double, y_km double").repartition(3)
        centers = spark.createDataFrame([(3, i, *map(float, v)) for i, v in enumerate(c)], "k int, cluster int, x_km double, y_km double")
        got = [r.site_id for r in L.snap_centers(centers, sites, 3).orderBy("cluster").collect()]
        want = min(permutations(range(7), 3), key=lambda p: (((s[list(p)] - c) ** 2).sum(), sorted(p), p))
        assert got == [f"S{i}" for i in want]
    assert L.snap_centers(centers, sites.where("site_id < 'S1'"), 3).count() == 0


def test_snapping_fifty_centres_onto_many_sites(spark):
    n = 40_000
    sites = spark.range(n).select(F.col("id").alias("site_id"), (F.rand(1) * 1000).alias("x_km"), (F.rand(2) * 1000).alias("y_km"))
    rng = np.random.default_rng(2)  # all centres in one corner, so that they compete for the same sites
    centers = spark.createDataFrame([(50, i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 20, (50, 2)))],
                                    "k int, cluster int, x_km double, y_km double")
    rows = L.snap_centers(centers, sites, 50).collect()
    assert len({r.site_id for r in rows}) == 50
    xy = {r.site_id: (r.x_km, r.y_km) for r in sites.collect()}
    own = {r.cluster: (r.x_km, r.y_km) for r in centers.collect()}

    def cost(cluster, site):
        return (own[cluster][0] - xy[site][0]) ** 2 + (own[cluster][1] - xy[site][1]) ** 2

    held = {r.cluster: r.site_id for r in rows}
    for a in held:  # no exchange of two sites and no move to a free site is cheaper
        for b in held:
            assert cost(a, held[a]) + cost(b, held[b]) <= cost(a, held[b]) + cost(b, held[a]) + 1e-6
    free = [s for s in xy if s not in held.values()]
    assert all(min(cost(a, s) for s in free) >= cost(a, held[a]) - 1e-6 for a in held)


def test_interval_program_on_chunks_equals_the_plain_one(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for zone, n in (("a", 400), ("b", 37), (None, 90), ("c", 2)):
        x = np.sort(rng.choice(5000, n, replace=False)) / 7
        w = rng.integers(1, 9, n).astype(float)
        rows += [(zone, float(a), float(b)) for a, b in zip(x, w)] + [(zone, float(x[0]), 0.0), (zone, -50.0, 0.0)]
        want |= {(zone, k): split_line(x, w, k) for k in (1, 2, 3) if k <= n}
    df = spark.createDataFrame(rows, "zone string, x_km double, demand double").repartition(4)
    for chunk in (11,):  # several levels of ends and of merging; one zone whole
        got = {}
        for r in L.optimal_1d_centers(df, (1, 2, 3), chunk=chunk).orderBy("k", "cluster").collect():
            got.setdefault((r.zone, r.k), []).append((r.x_km, r.weight, r.loss))
        assert set(got) == set(want)
        for key, parts in want.items():
            assert np.allclose(sum(p[2] for p in got[key]), sum(p[2] for p in parts))
            assert np.allclose([p[:2] for p in got[key]], [p[:2] for p in parts])


def test_halving_finds_the_first_best_cut():
    rng = np.random.default_rng(0)
    x, w = np.sort(rng.uniform(0, 100, 60)), rng.integers(1, 5, 60).astype(float)
    pre = np.stack([np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x)])
    cost = np.concatenate([[np.inf], intervals._loss(pre[:, :1], pre[:, 1:])])
    value, cut = intervals.best_cuts(pre[:, 2:], 2, pre[:, 10:40], cost[10:40], 10, 1, 59)
    for j in range(2, 61):
        offers = [cost[i] + intervals._loss(pre[:, i], pre[:, j]) for i in range(10, min(40, j))]
        assert np.isclose(value[j - 2], min(offers)) if offers else np.isinf(value[j - 2])


@pytest.mark.parametrize("kind", ["clustered", "same places"])
def test_grid_index_gives_the_rows_of_the_array(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    c = {"clustered": np.concatenate([rng.normal(50, 0.5, (200, 2)), rng.uniform(-20, 90, (50, 2))]),
         "same places": rng.integers(0, 9, (700, 2)).astype(float)}[kind]
    centers = spark.createDataFrame([(k, i, float(x), float(y)) for k in (1, 2) for i, (x, y) in enumerate(c) if i % k == 0],
                                    "k int, cluster int, x_km double, y_km double")
    p = np.concatenate([rng.uniform(-10, 120, (300, 2)), rng.normal(50, 0.02, (200, 2)), rng.integers(0, 9, (100, 2)), c[:50]])
    odd = [("n", None, 1.0, 1.0), ("m", float("nan"), 1.0, 1.0), ("i", float("inf"), 2.0, 1.0)]
    df = spark.createDataFrame([(f"P{i}", float(x), float(y), 1.0) for i, (x, y) in enumerate(p)] + odd,
                               "point_id string, x_km double, y_km double, demand double")
    want = sorted(map(str, L.nearest_center(df, centers, (1, 2)).collect()))
    monkeypatch.setattr(L, "MAX_CENTERS", 10)
    assert sorted(map(str, L.nearest_center(df, centers, (1, 2)).collect())) == want
    monkeypatch.setattr(grid, "SENT", 0)
    assert sorted(map(str, L.nearest_center(df, centers, (1, 2)).collect())) == want


def test_frontier_over_many_partitions(spark):
    rng = np.random.default_rng(12)
    for scale, tolerance in ((1.0, 1e-9), (1.0, 0.5), (1e9, 1e-9)):
        rows = [(f"R{i}", float(rng.integers(1, 60)) * scale / 4, float(rng.integers(1, 40)) / 40) for i in range(300)]
        got = {r.centers: r.is_pareto for r in frontier.pareto_frontier(plans(spark, rows), ["radius_km", "k"], tolerance, partitions=13).collect()}
        for n, l, c in rows:
            beaten = any(a <= l + tolerance and b >= c - tolerance and (a < l - tolerance or b > c + tolerance) for _, a, b in rows)
            assert got[n] == (not beaten)


def test_nearest_literal_compares_plain_values(spark):
    """Ties go to the lower centre, rows without a place to centre 0; no array is built for a row (one was before)."""
    label = L._nearest_literal([(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (0.0, 9.0)], ["x", "y"])
    rows = [(2.0, 0.0, 0), (3.0, 0.0, 1), (0.0, 8.0, 3), (None, 1.0, 0), (float("nan"), 1.0, 0), (float("inf"), 1.0, 0)]
    got = spark.createDataFrame(rows, "x double, y double, want int").select("want", label.alias("got"))
    assert all(r.want == r.got for r in got.collect())
    assert "array" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert spark.range(1).select(L._nearest_literal([(1.0,)], ["id"]).alias("i")).first().i == 0
