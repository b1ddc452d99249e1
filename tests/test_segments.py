import datetime as dt
import math

import numpy as np
import pytest

from cargolens.operators import cells, contracts as K, segments as G
from cargolens.sources.tables import ContractError


def labelled(spark, rows):
    return spark.createDataFrame([(g, float(x), c) for g, x, c in rows], "g string, x double, cluster int")


def brute(x, labels):
    out = []
    for i, v in enumerate(x):
        own = [abs(v - x[j]) for j in range(len(x)) if j != i and labels[j] == labels[i]]
        if not own:
            out.append(0.0)
            continue
        a = np.mean(own)
        b = min(np.mean([abs(v - x[j]) for j in range(len(x)) if labels[j] == c]) for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_silhouette_hand_answers_reasons_and_blocks(spark):
    rng = np.random.default_rng(2)
    x, c = rng.integers(0, 25, 90).tolist(), (rng.random(90) < 0.7).astype(int).tolist()
    rows = ([("hand", v, l) for v, l in zip((0, 2, 10, 12), (0, 0, 1, 1))]
            + [("single", v, l) for v, l in zip((0, 1, 5), (0, 0, 1))]
            + [("one", v, 0) for v in (1, 2, 3)] + [("all", v, v) for v in (1, 2, 3)]
            + [("same", 4, l) for l in (0, 0, 1, 1)] + [("blocks", v, l) for v, l in zip(x, c)])
    got = {r.g: r for r in G.silhouette(labelled(spark, rows), ["x"], ["g"], block=7).collect()}
    assert math.isclose(got["hand"].silhouette, 79 / 99)
    assert math.isclose(got["single"].silhouette, (0.8 + 0.75) / 3)
    assert got["one"].silhouette is None and got["one"].reason.startswith("1 groups")
    assert got["all"].silhouette is None and got["all"].reason is not None
    assert got["same"].silhouette == 0.0 and got["same"].reason is None
    assert math.isclose(got["blocks"].silhouette, brute(x, c), rel_tol=1e-12)


def test_pruned_silhouette_equals_all_pairs(spark):
    """Ten clear clusters (most pairs pruned), overlapping ones, far offsets, text labels and repeated rows."""
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 20, (10, 2))
    at = rng.integers(0, 10, 900)
    clear = centers[at] + rng.normal(0, 1, (900, 2))
    mixed = rng.integers(0, 6, (300, 2)).astype(float)
    groups = {"clear": (clear, at), "mixed": (mixed, rng.integers(0, 4, 300)), "far": (clear[:200] + 1e6, at[:200]),
              "two": (mixed[:60], (mixed[:60, 0] > 2).astype(int)), "lonely": (mixed[:40], [0] * 20 + [1] * 19 + [2])}
    rows = [(g, float(x), float(y), f"c{c}") for g, (xy, cs) in groups.items() for (x, y), c in zip(xy, cs, strict=True)]
    df = spark.createDataFrame(rows, "g string, x double, y double, cluster string")
    got = {r.g: r for r in G.silhouette(df, ["x", "y"], ["g"], block=50).collect()}
    for g, (xy, cs) in groups.items():
        cs = np.asarray(cs)
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        scores = []
        for i, c in enumerate(cs):
            own = (cs == c).sum() - 1
            b = min(d[i, cs == o].mean() for o in set(cs.tolist()) - {c})
            a = d[i, cs == c].sum() / own if own else 0.0
            scores.append((b - a) / max(a, b) if own and max(a, b) else 0.0)
        assert math.isclose(got[g].silhouette, np.mean(scores), rel_tol=1e-9), g
    assert got["clear"].pruned_share > 0.6 and got["two"].pruned_share == 0


def test_adjusted_rand_hand_answers(spark):
    rows = ([("swap", a, b) for a, b in zip((0, 0, 1, 1), (7, 7, 9, 9))]
            + [("cross", a, b) for a, b in zip((0, 0, 1, 1), (0, 1, 0, 1))] + [("two", 0, 0), ("two", 0, 0), ("n1", 3, 4)])
    df = spark.createDataFrame(rows, "g string, a int, b int")
    got = {r.g: r.ari for r in G.adjusted_rand(df, "a", "b", ["g"]).collect()}
    assert got == pytest.approx({"swap": 1.0, "cross": -0.5, "two": 1.0, "n1": 1.0})


def test_population_scaling_with_a_constant_column(spark):
    df = spark.createDataFrame([("p", 1.0, 7.0), ("p", 3.0, 7.0), ("q", 5.0, 9.0)], "period string, u double, v double")
    own = {(r.period, r.u): (r.z_u, r.z_v) for r in G.standardize(df, ["u", "v"]).collect()}
    assert own["p", 1.0] == (-1.0, 0.0) and own["p", 3.0] == (1.0, 0.0)
    fixed = {r.u: (r.z_u, r.z_v) for r in G.standardize(df, ["u", "v"], reference="p").collect()}
    assert fixed[5.0] == (3.0, 2.0)


def test_thirds_include_the_limit(spark):
    df = spark.createDataFrame([("p", float(v)) for v in (1, 2, 3, 4)] + [("same", 5.0)] * 3, "period string, business_volume double")
    got = sorted((r.period, r.business_volume, r.volume_rule) for r in G.volume_terciles(df).collect())
    assert got == [("p", 1.0, 0), ("p", 2.0, 0), ("p", 3.0, 1), ("p", 4.0, 2)] + [("same", 5.0, 0)] * 3


def test_features_keep_text_ids_apart(spark):
    bills = spark.createDataFrame([("001", "a", dt.date(2025, 1, 1), 2.0), ("1", "b", dt.date(2025, 1, 5), 3.0),
                                   ("1", "c", dt.date(2025, 1, 2), 4.0)],
                                  "customer_id string, waybill_id string, date date, quantity double")
    volume = spark.createDataFrame([("001", 2.0), ("1", 8.0)], "customer_id string, business_volume double")
    f = G.customer_features(bills, volume, "2025-02-01")
    got = {r.customer_id: (r.orders, r.summed_quantity, r.recency_days) for r in f.collect()}
    assert got == {"001": (1, 2.0, 31), "1": (2, 7.0, 27)}
    assert [r.customer_id for r in G.volume_reconcile_check(f).collect()] == ["1"]
    with pytest.raises(ContractError):
        K.one_to_one_join(bills, volume, ["customer_id"])


def test_reconciliation_rules_in_order(spark):
    kinds = "customer_id string, period string, quantity double, unit string"
    base = ("2024", 48.0, "piece")
    cases = {"convertible": ("2024", 2.0, "box"), "equal": ("2024", 48.0000001, "piece"), "review": ("2024", 50.0, "piece"),
             "different_period": ("2023", 2.0, "box"), "missing_value": ("2023", None, "box")}
    left = spark.createDataFrame([(name, *base) for name in cases] + [("only left", *base), ("no factor", *base)], kinds)
    right = spark.createDataFrame([(name, *row) for name, row in cases.items()]
                                  + [("only right", *base), ("no factor", "2024", 2.0, "crate")], kinds)
    got = {r.customer_id: r.status for r in G.unit_period_reconcile(left, right, {("piece", "box"): 24.0}).collect()}
    assert got == {**{name: name for name in cases}, "only left": "missing_value", "only right": "missing_value",
                   "no factor": "review"}


def _features(spark, rows):
    return spark.createDataFrame(rows, "customer_id int, orders int, business_volume double, recency_days int")


def test_sweep_of_very_few_or_equal_customers(spark):
    one = {r.method + str(r.k): r for r in G.kmeans_sweep(_features(spark, [(1, 2, 5.0, 3)])).collect()}
    assert all(one[f"kmeans{k}"].silhouette is None and "impossible" in one[f"kmeans{k}"].reason for k in (2, 3, 4, 5))
    two = {r.method + str(r.k): r for r in G.kmeans_sweep(_features(spark, [(1, 2, 5.0, 3), (2, 9, 1.0, 8)])).collect()}
    assert two["kmeans2"].silhouette is None and two["kmeans2"].reason
    same = G.kmeans_sweep(_features(spark, [(i, 2, 5.0, 3) for i in range(6)])).collect()
    assert all(r.silhouette is None and r.reason for r in same)


def test_equal_volumes_make_one_band_and_seeds_agree_on_clear_groups(spark):
    rows = [(i, 1 + i % 3 * 20, 7.0, 2 + i % 3 * 40) for i in range(30)]
    df = _features(spark, rows)
    sweep = {(r.method, r.k): r for r in G.kmeans_sweep(df, (3,)).collect()}
    assert sweep["volume_rule", 3].silhouette is None
    assert abs(sweep["kmeans", 3].silhouette - 1) < 1e-9
    stable = G.seed_stability(df, restarts=3).collect()
    assert len(stable) == 5 and all(r.ari == 1 and r.min_ari == 1 for r in stable)


def test_repeated_volume_rows_are_refused_and_later_customers_named(spark):
    import datetime as dt
    ways = spark.createDataFrame([(1, 10, dt.date(2024, 1, 1), 2.0), (2, 11, dt.date(2024, 3, 1), 1.0)],
                                 "customer_id int, waybill_id int, date date, quantity double")
    volume = spark.createDataFrame([(1, 2.0), (1, 3.0)], "customer_id int, business_volume double")
    with pytest.raises(Exception, match="more than one volume row for customer 1"):
        G.customer_features(ways, volume, "2024-06-01").collect()
    periods = {"a": "2024-02-01", "b": "2024-04-01"}
    assert {r.customer_id for r in G.period_features(ways, periods).collect()} == {1}
    assert [r.customer_id for r in G.left_out_customers(ways, periods).collect()] == [2]
    assert G.period_features(ways, periods, panel=False).count() == 3


def test_thirds_of_many_groups_null_ones_and_the_reference(spark):
    rows = [(f"p{g}", float(v + g)) for g in range(40) for v in range(1, 5)] + [(None, 1.0), (None, 9.0), ("p0", None)]
    df = spark.createDataFrame(rows, "period string, business_volume double")
    own = [(r.period, r.business_volume, r.volume_rule) for r in G.volume_terciles(df).collect()]
    assert len(own) == len(rows)
    assert {(v - int(p[1:]), rule) for p, v, rule in own if p and v} == {(1, 0), (2, 0), (3, 1), (4, 2)}
    assert sorted((v, rule) for p, v, rule in own if p is None) == [(1.0, 0), (9.0, 2)]
    fixed = {(r.period, r.business_volume): r.volume_rule for r in G.volume_terciles(df, reference="p0").collect()}
    assert fixed["p0", 3.0] == 1 and fixed["p30", 31.0] == 2 and fixed[None, 1.0] == 0


def test_silhouette_by_cells_equals_all_pairs(spark, monkeypatch):
    """Several labellings of the same points, a family with a null and a small one; two clusters that overlap save pairs too."""
    monkeypatch.setattr(G, "BY_CELLS", 1000)
    monkeypatch.setattr(cells, "LEAF", 24)
    rng = np.random.default_rng(4)
    many = np.column_stack([rng.poisson(6, 2400) / 2.0, rng.normal(0, 1, 2400).round(3), rng.exponential(1, 2400).round(3)])
    few = many[:40]
    labels = {("many", "a"): (many[:, 1] > 0).astype(int), ("many", "b"): rng.integers(0, 3, len(many)),
              ("few", "a"): (few[:, 0] > 3).astype(int)}
    labels["many", "b"][0] = 9
    x = {"many": many, "few": few}
    rows = [(p, m, *map(float, v), int(c)) for (p, m), l in labels.items() for v, c in zip(x[p], l, strict=True)]
    rows += [("null", "a", None if i == 0 else float(i), float(i % 7), 0.0, i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "p string, m string, f1 double, f2 double, f3 double, cluster int")
    for same in ((), ("m",), ("p", "m")):
        got = {(r.p, r.m): r for r in G.silhouette(df.where("p <> 'null'"), ["f1", "f2", "f3"], ["p", "m"], same=same).collect()}
        for (p, m), l in labels.items():
            distance = np.sqrt(((x[p][:, None, :] - x[p][None, :, :]) ** 2).sum(axis=2))
            size = np.bincount(l, minlength=10)
            sums = np.stack([distance[:, l == c].sum(axis=1) for c in range(10)], axis=1)
            at = np.arange(len(l))
            a = sums[at, l] / np.maximum(size[l] - 1, 1)
            with np.errstate(all="ignore"):
                other = np.where(size > 0, sums / size, np.inf)
            other[at, l] = np.inf
            b = other.min(axis=1)
            want = np.where(size[l] == 1, 0, (b - a) / np.maximum(a, b)).mean()
            assert abs(got[p, m].silhouette - want) < 1e-8, (same, p, m)
        assert got["many", "a"].pruned_share > 0.2
    assert G.silhouette(df, ["f1", "f2", "f3"], ["p", "m"], same=("m",)).count() == 4


def test_distance_sums_equal_direct_sums(spark):
    """Two families of points of one, two and three features; a constant feature; sums held to 1e-7 of themselves."""
    rng = np.random.default_rng(8)
    for d in (1, 2, 3):
        x = np.unique(rng.normal(0, 1, (1500, d)) * [3.0, 1.0, 0.0][:d], axis=0)
        w = rng.integers(0, 3, (len(x), 2)).astype(float)
        family = np.arange(len(x)) % 2
        names = [f"f{i}" for i in range(d)]
        df = spark.createDataFrame([(int(f), *map(float, p), *map(float, v)) for f, p, v in zip(family, x, w, strict=True)],
                                   "_fid int, " + ", ".join(f"{n} double" for n in [*names, "w0", "w1"]))
        got = cells.distance_sums(df, names, ["w0", "w1"], leaf=16).collect()
        assert len(got) == len(x)
        for r in got:
            mine = family == r["_fid"]
            want = np.sqrt(((x[mine] - [r[n] for n in names]) ** 2).sum(axis=1)) @ w[mine]
            assert np.allclose(r["_sums"], want, rtol=1e-7, atol=0)
        assert min(r["_met"][0] for r in got) < w[:, 0].sum() / 3
