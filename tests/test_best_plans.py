"""Branch and bound over plans against the evaluation of every plan."""

import numpy as np
import pandas as pd
import pytest

from cargolens.operators import best_plans as B, location as L
from cargolens.sources.tables import ContractError

POINTS = "point_id long, x_km double, y_km double, demand double"
SITES = "site_id string, x_km double, y_km double"


def _tables(spark, seed, points, sites, whole=False):
    rng = np.random.default_rng(seed)
    xy = rng.normal(0, 40, (points, 2)) + rng.integers(0, 3, (points, 1)) * 50
    at = rng.uniform(-80, 160, (sites, 2))
    if whole:  # points and sites on few places: many plans tie
        xy, at = np.round(xy / 25) * 25, np.round(at / 40) * 40
    p = pd.DataFrame({"point_id": range(points), "x_km": xy[:, 0], "y_km": xy[:, 1],
                      "demand": rng.integers(1, 9, points).astype(float)})
    s = pd.DataFrame({"site_id": [f"S{i:02d}" for i in range(sites)], "x_km": at[:, 0], "y_km": at[:, 1]})
    return spark.createDataFrame(p, POINTS).repartition(3), spark.createDataFrame(s, SITES)


def _key(rows):
    return {(r["policy"], r["radius_km"], r["extra_loss_budget"]): r["centers"] for r in rows}


@pytest.mark.parametrize("seed, points, sites, k, radii, whole, page", [
    (1, 800, 14, 3, (20.0, 45.0), False, 20_000),
    (2, 300, 12, 4, (30.0, 500.0), True, 7),     # everything is covered at 500; pages of seven plans
    (3, 50, 6, 1, (25.0,), True, 20_000), (4, 40, 5, 5, (25.0,), False, 20_000)])
def test_same_plans_as_enumeration(spark, seed, points, sites, k, radii, whole, page):
    p, s = _tables(spark, seed, points, sites, whole)
    every = L.evaluate_sites(p, s, k, radii).persist()
    alt = L.max_city_cover_alt_order(every).selectExpr("*", "CAST(NULL AS DOUBLE) AS extra_loss_budget")
    want = _key(L.selected_plans(every).unionByName(alt).collect())
    rows = B.best_plans(p, s, k, radii, page=page, cells=12).collect()
    assert _key(rows) == want
    assert all(1 <= r["evaluated"] and r["plans"] == str(every.count() // len(radii)) for r in rows)


def test_bounds_never_exceed_the_values(spark):
    """Every plan's bound, with prices of any quality, against its exact measures."""
    p, s = _tables(spark, 5, 200, 8)
    xy = np.array([(r["x_km"], r["y_km"]) for r in s.orderBy("site_id").collect()])
    measures = B.Measures(xy, [30.0])
    grid, frame = B._grid(p, 5)
    plan = np.array([0, 3])
    costs = list(measures.costs(grid[["x", "y"]].to_numpy(float)))
    rng = np.random.default_rng(6)
    prices = [c[:, plan].min(axis=1) * rng.uniform(0.5, 1.5, len(c)) for c in costs]
    bounds = B.Bounds(measures, *B._site_sums(p, measures, grid, frame, 5, prices, [plan] * 4), 2)
    plans = np.array([(i, j) for i in range(8) for j in range(i + 1, 8)], dtype=np.int32)
    exact = B._plan_sums(p, measures, plans) * bounds.by
    for m in range(4):
        assert (bounds.quick(plans, m, -1) <= exact[:, m] + 1e-9).all()
        close = bounds.close(plans, m, -1)
        assert (close <= exact[:, m] + 1e-9 * np.abs(exact[:, m])).all()
        for order in range(4):
            first = bounds.close(np.arange(7)[:, None], m, order)
            for i in range(7):
                inside = {frozenset((bounds.sites[order][i], bounds.sites[order][j])) for j in range(i + 1, 8)}
                values = [v for v, q in zip(exact[:, m], plans) if frozenset(q) in inside]
                assert first[i] <= min(values) + 1e-9 * abs(min(values))


def test_empty_and_refused(spark):
    p, s = _tables(spark, 7, 10, 3)
    assert B.best_plans(p.where("false"), s, 2, (5.0,)).count() == 0
    assert B.best_plans(p, s, 4, (5.0,)).count() == 0
    many = spark.range(B.MAX_SITES + 1).selectExpr("CAST(id AS STRING) AS site_id", "0D AS x_km", "0D AS y_km")
    with pytest.raises(ContractError):
        B.best_plans(p, many, 2, (5.0,))
    only = B.best_plans(p, s, 1, (5.0,), policies=("min_squared_loss",)).collect()
    assert [r["policy"] for r in only] == ["min_squared_loss"]
