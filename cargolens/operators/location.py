"""Weighted site location: nearest centres, coverage, enumeration, Pareto trade-offs, policies.

Points are ``point_id, x_km, y_km, demand`` in planar kilometres; demand is only a weight. Centres
are ``k, cluster, x_km, y_km``; more than ``MAX_CENTERS`` for a k are searched by a grid index. Candidate
sites are ``site_id, x_km, y_km``; the number of plans is checked against ``MAX_PLANS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count, islice
from math import comb

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import col, euclid
from ..functions.scale import cut_lineage
from ..sources.tables import ContractError
from . import frontier
from .assignment import snap_centers  # noqa: F401
from .grid import nearest_of_many
from .intervals import optimal_1d_centers  # noqa: F401

MAX_CENTERS = 1000
MAX_PLANS = 2_000_000
TOLERANCE = 1e-9
#: Least number of rounds in which k-means starts are sought; rounds that halve the cost are followed by more.
ROUNDS = 3


# Centres -------------------------------------------------------------------------------------

def _centers_by_k(centers: DataFrame) -> DataFrame:
    """One row for each k with its centres as an array ordered by cluster."""
    return centers.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(
        F.col("cluster").cast("int").alias("cluster"), F.col("x_km").alias("x"), F.col("y_km").alias("y")))).alias("_centers"))


def nearest_center(points: DataFrame, centers: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Distance and nearest cluster of each point for each k; ties go to the lower cluster.

    Up to MAX_CENTERS centres for a k travel as one array beside the points, which never move; more are found by the grid
    index of ``grid``, with the same rows.
    """
    centers = cut_lineage(centers.select("k", "cluster", "x_km", "y_km"))
    most = centers.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_CENTERS:
        return nearest_of_many(points, centers, ks)
    each = points.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    both = each.join(F.broadcast(_centers_by_k(centers)), "k")
    found = F.array_min(F.transform("_centers", lambda c: F.struct(
        euclid("x_km", "y_km", c["x"], c["y"]).alias("d"), c["cluster"].alias("cluster"))))
    return (both.withColumn("_n", found)
            .select("k", *points.columns, F.col("_n.cluster").alias("cluster"), F.col("_n.d").alias("distance_km")))


def coverage(near: DataFrame, radii: tuple[float, ...], groups: tuple[str, ...] = ("k",),
             tolerance: float = 0.0) -> DataFrame:
    """City share and demand share within each radius, mean distance and squared loss.

    All radii are aggregated in one pass over the points.
    """
    d, w = F.col("distance_km"), F.col("demand")
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"),
            F.sum(w * d).alias("_wd"), F.sum(w * d * d).alias("_wdd")]
    for i, r in enumerate(radii):
        inside = d <= F.lit(float(r) + tolerance)
        aggs += [F.count_if(inside).alias(f"_n{i}"), F.sum(F.when(inside, w).otherwise(0.0)).alias(f"_w{i}")]
    rows = F.array(*[F.struct(
        F.lit(float(r)).alias("radius_km"), (F.col(f"_n{i}") / F.col("_n")).alias("city_coverage"),
        (F.col(f"_w{i}") / F.col("_w")).alias("demand_coverage")) for i, r in enumerate(radii)])
    return near.groupBy(*groups).agg(*aggs).select(
        *groups, F.inline(rows), (F.col("_wd") / F.col("_w")).alias("weighted_distance_km"),
        F.col("_wdd").alias("weighted_squared_loss"))


def weighted_distance(near: DataFrame, groups: tuple[str, ...] = ("k",)) -> DataFrame:
    d, w = F.col("distance_km"), F.col("demand")
    return near.groupBy(*groups).agg((F.sum(w * d) / F.sum(w)).alias("weighted_distance_km"),
                                     F.sum(w * d * d).alias("weighted_squared_loss"))


def coverage_monotone_check(cover: DataFrame, groups: tuple[str, ...] = ("k",)) -> DataFrame:
    """Violations: fixed centres whose coverage falls when the radius grows."""
    order = Window.partitionBy(*groups).orderBy("radius_km")
    falls = [F.lag(c).over(order) > F.col(c) for c in ("city_coverage", "demand_coverage")]
    return cover.withColumn("falls", F.coalesce(falls[0] | falls[1], F.lit(False))).where("falls")


# k-means -------------------------------------------------------------------------------------

def _nearest_literal(centers: list[tuple[float, ...]], features: list[str]) -> Column:
    """Index of the nearest of a few fixed centres; ties go to the lower index."""
    def squared(c):
        terms = [(F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v))) for f, v in zip(features, c)]
        return sum(terms[1:], terms[0])
    far = [squared(c) for c in centers]
    if len(far) < 2:
        return F.lit(0)
    label, least = F, F.least(*far)  # plain comparisons: an array of structs costs several times as much a row
    for i, d in enumerate(far[:-1]):
        label = label.when(d == least, F.lit(i))
    return F.when(least.isNull(), F.lit(0)).otherwise(label.otherwise(F.lit(len(far) - 1)))


def lloyd_trace(points: DataFrame, start: list[tuple[float, float]], max_steps: int | None = None,
                weight: str = "demand") -> DataFrame:
    """Lloyd steps from given centres until the labels repeat: one row for each step and cluster.

    ``converged`` is true in every row when the labels did repeat; a trace that was asked to stop after
    ``max_steps`` says false. Each step is one aggregate over the points; only the k new centres and the number of changed
    labels return. A group without points keeps its centre.
    """
    features = ["x_km", "y_km"]
    data = points.select(*features, col(weight).cast("double").alias("_w")).persist(StorageLevel.MEMORY_AND_DISK)
    previous, current, trace, converged = None, [tuple(map(float, c)) for c in start], [], False
    try:
        for step in count(1) if max_steps is None else range(1, max_steps + 1):
            label = _nearest_literal(current, features)
            moved = F.lit(True) if previous is None else label != _nearest_literal(previous, features)
            sums = (data.select("*", label.alias("cluster"), moved.alias("_moved")).groupBy("cluster")
                    .agg(F.count(F.lit(1)).alias("n"), F.count_if("_moved").alias("moved"), F.sum("_w").alias("w"),
                         *[F.sum(F.col("_w") * F.col(f)).alias(f) for f in features]).collect())
            found = {r["cluster"]: r for r in sums}
            updated = [tuple(found[i][f] / found[i]["w"] for f in features) if i in found else current[i]
                       for i in range(len(current))]
            trace += [(step, i, *current[i], found[i]["n"] if i in found else 0, *updated[i])
                      for i in range(len(current))]
            changed = sum(r["moved"] for r in sums)
            previous, current = current, updated
            converged = step > 1 and changed == 0
            if converged:
                break
    finally:
        data.unpersist()
    return points.sparkSession.createDataFrame(
        [(*row, converged) for row in trace], "step int, cluster int, old_x double, old_y double, members bigint, "
        "new_x double, new_y double, converged boolean")


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres: each next one is drawn by weighted squared distance to those chosen."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = near * weights
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())) if mass.sum() > 0
                      else int(np.setdiff1d(np.arange(len(points)), chosen)[0]))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _uniform(hashes: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row, the seed and the step alone."""
    x = hashes ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (step + 1) * 0xD6E8FEB86659FD93) % 2 ** 64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    out = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centers[None, :, j]) ** 2
    return out


def kmeans_starts(data: DataFrame, features: list[str], specs: list[tuple[int, int]],
                  weight: str | None = None) -> list[np.ndarray]:
    """One start for each (k, seed) by k-means||, over all distinct rows; all runs share each pass.

    The first candidate is drawn by weight; each round then draws 2k rows by weight times squared distance to the
    candidates so far (the smallest of exponential numbers with these rates, so tasks return 2k rows for each run).
    After ``ROUNDS`` rounds a run goes on as long as the last one halved its cost, so groups that hide behind much
    farther ones are met too. Candidates weigh what lies nearest to them; k of them are drawn by k-means++.
    """
    d = len(features)
    w = col(weight).cast("double") if weight else F.lit(1.0)
    rows = (data.select(*[F.col(f).cast("double").alias(f) for f in features], w.alias("_w"))
            .groupBy(*features).agg(F.sum("_w").alias("_w")).where(F.col("_w") > 0)
            .select(*features, "_w", F.xxhash64(*features).alias("_h")).persist(StorageLevel.MEMORY_AND_DISK))
    names = [f"s{i}" for i in range(d)]
    schema = "run int, place double, cost double, " + ", ".join(f"{c} double" for c in names)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            hashes = batch["_h"].to_numpy(np.int64).view(np.uint64)
            values = batch[[*features, "_w"]].to_numpy(float)
            for low in range(0, len(values), 8192):
                yield values[low:low + 8192, :d], values[low:low + 8192, d], hashes[low:low + 8192]

    def draw(active: dict[int, np.ndarray], number: int) -> dict[int, tuple[float, np.ndarray]]:
        many = {r: 2 * specs[r][0] if number else 1 for r in active}

        def offers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, cost = {r: np.zeros((0, 1 + d)) for r in active}, dict.fromkeys(active, 0.0)
            for x, mass, hashes in blocks(batches):
                for r, known in active.items():
                    part = mass * _squared(x, known).min(axis=1) if len(known) else mass
                    cost[r] += part.sum()
                    with np.errstate(divide="ignore"):
                        place = np.log(-np.log(_uniform(hashes, specs[r][1], number))) - np.log(part)
                    open_ = np.flatnonzero(part > 0)
                    if len(open_) > many[r]:
                        open_ = open_[np.argpartition(place[open_], many[r] - 1)[:many[r]]]
                    both = np.concatenate([best[r], np.column_stack([place[open_], x[open_]])])
                    best[r] = both[np.lexsort(both.T[::-1])[:many[r]]]
            yield pd.DataFrame([(r, place, 0.0, *x) for r, b in best.items() for place, *x in b]
                               + [(r, None, c, *[0.0] * d) for r, c in cost.items()],
                               columns=["run", "place", "cost", *names])

        def smallest(key: tuple, offered: pd.DataFrame) -> pd.DataFrame:
            total = offered["cost"].sum(skipna=False)
            out = offered.dropna(subset=["place"]).sort_values(["place", *names]).head(many[key[0]])
            return pd.concat([out, pd.DataFrame([(key[0], None, total, *[0.0] * d)], columns=offered.columns)
                              .astype({"place": float})])

        found = rows.mapInPandas(offers, schema).groupBy("run").applyInPandas(smallest, schema).collect()
        out = {}
        for r in active:
            mine = sorted((row["place"], *[row[c] for c in names]) for row in found
                          if row["run"] == r and row["place"] is not None)
            cost = sum(row["cost"] for row in found if row["run"] == r)
            if not np.isfinite(cost):
                raise ContractError("k-means: features and weights must be finite")
            out[r] = cost, np.array([m[1:] for m in mine], dtype=float).reshape(-1, d)
        return out

    def weigh(known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {r: np.zeros(len(c)) for r, c in known.items()}
            for x, mass, _ in blocks(batches):
                for r, candidates in known.items():
                    near = _squared(x, candidates).argmin(axis=1)
                    total[r] += np.bincount(near, mass, minlength=len(candidates))
            yield pd.DataFrame([(r, i, v) for r, t in total.items() for i, v in enumerate(t)], columns=["run", "i", "w"])

        out = {r: np.zeros(len(c)) for r, c in known.items()}
        for row in (rows.mapInPandas(sums, "run int, i int, w double").groupBy("run", "i")
                    .agg(F.sum("w").alias("w")).collect()):
            out[row["run"]][row["i"]] = row["w"]
        return out

    try:
        distinct = rows.count()
        short = [k for k, _ in specs if k > distinct]
        if short:
            raise ContractError(f"{max(short)} groups need as many distinct rows; there are {distinct}")
        known = {r: np.zeros((0, d)) for r in range(len(specs))}
        active, costs = set(known), {}
        for number in count():
            if not active:
                break
            for r, (cost, new) in draw({r: known[r] for r in sorted(active)}, number).items():
                known[r] = np.concatenate([known[r], new])
                if not len(new) or number >= ROUNDS and 2 * cost > costs[r]:
                    active.remove(r)
                costs[r] = cost
        weights = weigh(known)
    finally:
        rows.unpersist()
    # Rows nearer to each other than squares can tell leave too few candidates; some centres are then the same.
    return [_plus_plus(*(np.resize(v, (max(k, len(v)), *v.shape[1:])) for v in (known[r], weights[r])), k,
                       np.random.default_rng(seed)) for r, (k, seed) in enumerate(specs)]


def lloyd_runs(data: DataFrame, features: list[str], starts: list[np.ndarray], weight: str | None = None,
               max_steps: int = 300, tolerance: float = 1e-4) -> list[tuple[float, np.ndarray]]:
    """Cost and centres of Lloyd's method from every start; all runs share each pass over the rows.

    A step turns a task's rows into one sum for each run and cluster. A run ends when the squared shift of its
    centres is at most ``tolerance`` times the mean variance of the features, or after ``max_steps`` steps. A
    group without rows keeps its centre; ties go to the lower cluster.
    """
    d = len(features)
    w = col(weight).cast("double") if weight else F.lit(1.0)
    rows = data.select(*[F.col(f).cast("double").alias(f) for f in features], w.alias("_w"))
    spread = rows.agg(*[F.var_pop(f) for f in features]).first()
    limit = tolerance * float(np.mean([v or 0.0 for v in spread]))
    schema = "run int, cluster int, w double, cost double, " + ", ".join(f"s{i} double" for i in range(d))

    def step(active: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {r: np.zeros((len(c), 2 + d)) for r, c in active.items()}
            for batch in batches:
                values = batch.to_numpy(float)
                for low in range(0, len(values), 8192):
                    x, mass = values[low:low + 8192, :d], values[low:low + 8192, d]
                    for r, centers in active.items():
                        squared = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
                        label = squared.argmin(axis=1)
                        cells = np.column_stack([mass, mass * squared[np.arange(len(x)), label], x * mass[:, None]])
                        for j in range(cells.shape[1]):
                            total[r][:, j] += np.bincount(label, cells[:, j], minlength=len(centers))
            yield pd.DataFrame([(r, i, *cell) for r, t in total.items() for i, cell in enumerate(t)],
                               columns=["run", "cluster", "w", "cost", *[f"s{i}" for i in range(d)]])

        found = (rows.mapInPandas(sums, schema).groupBy("run", "cluster")
                 .agg(*[F.sum(c).alias(c) for c in ("w", "cost", *[f"s{i}" for i in range(d)])]).collect())
        out = {r: (0.0, c.copy()) for r, c in active.items()}
        for row in found:
            cost, centers = out[row["run"]]
            if row["w"]:
                centers[row["cluster"]] = [row[f"s{i}"] / row["w"] for i in range(d)]
            out[row["run"]] = cost + row["cost"], centers
        return out

    current = {r: np.array(c, dtype=float) for r, c in enumerate(starts)}
    active, costs = dict(current), {}
    for _ in range(max_steps):
        if not active:
            break
        moved = step(active)
        for r, (_, centers) in moved.items():
            if ((centers - current[r]) ** 2).sum() <= limit:
                del active[r]
            else:
                active[r] = centers
            current[r] = centers
    for r, (cost, _) in step(current).items() if current else ():
        costs[r] = cost
    return [(costs[r], current[r]) for r in range(len(starts))]


def best_of_runs(data: DataFrame, features: list[str], specs: list[tuple[int, int]], restarts: int = 10,
                 weight: str | None = None) -> list[tuple[float, list[tuple[float, ...]]]]:
    """For each (k, seed) the cost and the sorted centres of the best of ``restarts`` runs, all in shared passes."""
    starts = kmeans_starts(data, features, [(k, seed + i) for k, seed in specs for i in range(restarts)], weight)
    runs = lloyd_runs(data, features, starts, weight)
    out = []
    for i in range(len(specs)):
        cost, centers = min(runs[i * restarts:(i + 1) * restarts], key=lambda r: r[0])
        out.append((cost, sorted(tuple(map(float, c)) for c in centers)))
    return out


def best_kmeans(df: DataFrame, features: list[str], k: int, restarts: int = 10, seed: int = 42,
                weight: str | None = None) -> tuple[float, list[tuple[float, ...]]]:
    """Cost and sorted centres of the best of several runs. ``df`` is read once for each step."""
    return best_of_runs(df, features, [(k, seed)], restarts, weight)[0]


def weighted_kmeans(points: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 4), restarts: int = 10,
                    seed: int = 42) -> DataFrame:
    """Centres k, cluster, x_km, y_km and cost; clusters are numbered by sorted centre."""
    features = ["x_km", "y_km"]
    data = points.select(*features, "demand").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = best_of_runs(data, features, [(k, seed) for k in ks], restarts, "demand")
    finally:
        data.unpersist()
    rows = [(k, i, float(x), float(y), float(cost)) for k, (cost, centers) in zip(ks, found, strict=True)
            for i, (x, y) in enumerate(centers)]
    return points.sparkSession.createDataFrame(rows, "k int, cluster int, x_km double, y_km double, cost double")


# Candidate plans -----------------------------------------------------------------------------

def _site_limit(k: int, max_plans: int) -> int:
    """The most candidates that have at most ``max_plans`` k-subsets."""
    low, high = k, max(2 * k, max_plans)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if comb(middle, k) <= max_plans else (low, middle - 1)
    return low


def enumerate_sites(sites: DataFrame, k: int, max_plans: int = MAX_PLANS) -> DataFrame:
    """All k-subsets of the candidate sites in id order: centers ('A|B|C') and members.

    The candidates travel as one small array; each level is an explode of the later positions, so
    no pairs are formed and thrown away. More than ``max_plans`` plans is an error.
    """
    limit = _site_limit(k, max_plans)
    # The candidates are counted before they meet in one row.
    few = sites.select("site_id", "x_km", "y_km").limit(limit + 1)
    one = few.agg(F.array_sort(F.collect_list(F.struct("site_id", "x_km", "y_km"))).alias("s"))
    n = F.size("s")
    checked = F.when(n <= limit, F.col("s")).otherwise(F.raise_error(
        F.lit(f"more than {max_plans} plans; reduce the candidates or k")))
    out = one.where(n >= k).select(checked.alias("s")).withColumn("n", F.size("s"))
    previous = F.lit(-1)
    for j in range(k):
        out = out.withColumn(f"i{j}", F.explode(F.sequence(previous + 1, F.col("n") - k + j)))
        if j == 0:
            out = out.repartition("i0")
        previous = F.col(f"i{j}")
    members = F.array(*[F.get("s", F.col(f"i{j}")) for j in range(k)])
    return (out.select(F.lit(k).alias("k"), members.alias("members"))
            .select("k", F.array_join(F.transform("members", lambda m: m["site_id"].cast("string")), "|").alias("centers"),
                    "members"))


def _candidate_list(sites: DataFrame, k: int, max_plans: int) -> list[tuple[str, float, float]]:
    """The candidate sites on the driver: few by construction, since C(n, k) is limited."""
    limit = _site_limit(k, max_plans)
    rows = sites.select(F.col("site_id").cast("string"), "x_km", "y_km").limit(limit + 1).collect()
    if len(rows) > limit or comb(len(rows), k) > max_plans:
        raise ContractError(f"more than {max_plans} plans; reduce the candidates or k")
    return sorted((r[0], r[1], r[2]) for r in rows)


def _plan_chunks(n: int, k: int, size: int) -> Iterator[np.ndarray]:
    plans = combinations(range(n), k)
    while chunk := list(islice(plans, size)):
        yield np.array(chunk, dtype=np.int32)


def evaluate_sites(points: DataFrame, sites: DataFrame, k: int, radii: tuple[float, ...],
                   tolerance: float = TOLERANCE, max_plans: int = MAX_PLANS) -> DataFrame:
    """City cover, demand cover, mean distance and squared loss of every plan and radius.

    Each task turns its points into partial sums for every plan, so points times plans is computed
    but never emitted: the shuffle carries one row for each plan and task.
    """
    candidates = _candidate_list(sites, k, max_plans)
    xy = np.array([(x, y) for _, x, y in candidates])
    names = [c[0] for c in candidates]
    limits = [float(r) + tolerance for r in radii]
    total = comb(len(candidates), k)

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((total, 2 + 2 * len(limits)))
        number, weight, any_rows = 0, 0.0, False
        for batch in batches:
            if batch.empty:
                continue
            any_rows = True
            for part in range(0, len(batch), 2000):
                rows = batch.iloc[part:part + 2000]
                p, w = rows[["x_km", "y_km"]].to_numpy(), rows["demand"].to_numpy()
                squared = ((p[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
                number, weight = number + len(w), weight + w.sum()
                at = 0
                for plans in _plan_chunks(len(names), k, 512):
                    near = squared[:, plans].min(axis=2)
                    distance = np.sqrt(near)
                    block = sums[at:at + len(plans)]
                    block[:, 0] += w @ distance
                    block[:, 1] += w @ near
                    for i, limit in enumerate(limits):
                        inside = distance <= limit
                        block[:, 2 + 2 * i] += inside.sum(axis=0)
                        block[:, 3 + 2 * i] += w @ inside
                    at += len(plans)
        if any_rows:
            at = 0
            for plans in _plan_chunks(len(names), k, 50_000):
                out = pd.DataFrame(sums[at:at + len(plans)], columns=fields)
                out.insert(0, "centers", ["|".join(names[i] for i in plan) for plan in plans])
                out["n"], out["w"] = number, weight
                at += len(plans)
                yield out

    fields = ["wd", "wdd"] + [f"{c}{i}" for i in range(len(limits)) for c in ("n", "w")]
    schema = "centers string, " + ", ".join(f"{f} double" for f in fields) + ", n double, w double"
    summed = (points.select("x_km", "y_km", "demand").mapInPandas(partial_sums, schema)
              .groupBy("centers").agg(*[F.sum(f).alias(f) for f in [*fields, "n", "w"]]))
    rows = F.array(*[F.struct(
        F.lit(float(r)).alias("radius_km"), (F.col(f"n{i}") / F.col("n")).alias("city_coverage"),
        (F.col(f"w{i}") / F.col("w")).alias("demand_coverage")) for i, r in enumerate(radii)])
    return summed.select(F.lit(k).alias("k"), "centers", F.inline(rows),
                         (F.col("wd") / F.col("w")).alias("weighted_distance_km"),
                         F.col("wdd").alias("weighted_squared_loss"))


GROUP = ["radius_km", "k"]


def loss_increase_pct(plans: DataFrame) -> DataFrame:
    """Add squared_loss_increase_pct over the least loss of the same radius and k."""
    least = plans.groupBy(*GROUP).agg(F.min("weighted_squared_loss").alias("_least"))
    return (plans.join(least, GROUP)
            .withColumn("squared_loss_increase_pct", (F.col("weighted_squared_loss") / F.col("_least") - 1) * 100)
            .drop("_least"))


def pareto_frontier(plans: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Add is_pareto: no other plan has less loss and more demand cover beyond the tolerance (see ``frontier``)."""
    return frontier.pareto_frontier(plans, GROUP, tolerance)


def _exactly(name: str) -> Column:
    """A measure to twelve significant decimals: sums differ in the last bits with the partitioning."""
    digits = {"demand_coverage": 12, "city_coverage": 12, "weighted_distance_km": 9, "weighted_squared_loss": 6}
    return F.round(name, digits[name])


def _demand_order() -> list[Column]:
    return [-_exactly("demand_coverage"), _exactly("weighted_squared_loss"), -_exactly("city_coverage"),
            _exactly("weighted_distance_km"), F.col("centers")]


def _first(plans: DataFrame, order: list[Column], policy: str, keys: list[str]) -> DataFrame:
    """Best row of each key in a fixed order; combined map-side instead of sorted."""
    rest = [c for c in plans.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return plans.groupBy(*keys).agg(best.alias("b")).select(F.lit(policy).alias("policy"), *keys, "b.*")


def select_site_min_loss(plans: DataFrame) -> DataFrame:
    return _first(plans, [_exactly("weighted_squared_loss"), -_exactly("demand_coverage"), F.col("centers")],
                  "min_squared_loss", GROUP)


def select_site_max_city(plans: DataFrame) -> DataFrame:
    return _first(plans, [-_exactly("city_coverage"), *_demand_order()], "max_city_coverage", GROUP)


def select_site_max_demand(plans: DataFrame) -> DataFrame:
    return _first(plans, _demand_order(), "max_demand_coverage", GROUP)


def max_city_cover_alt_order(plans: DataFrame) -> DataFrame:
    """City cover, demand cover, mean distance, ids: the loss takes no part in this order."""
    return _first(plans, [-_exactly("city_coverage"), -_exactly("demand_coverage"),
                          _exactly("weighted_distance_km"), F.col("centers")], "max_city_coverage_alt", GROUP)


def select_site_budget(plans: DataFrame, budgets: tuple[float, ...] = (0.0, 0.002, 0.01),
                       tolerance: float = TOLERANCE) -> DataFrame:
    """Most demand cover among plans whose loss stays within (1 + budget) of the least loss."""
    if any(b < 0 for b in budgets):
        raise ValueError("a loss budget must not be negative")
    least = plans.groupBy(*GROUP).agg(F.min("weighted_squared_loss").alias("_least"))
    offered = (plans.join(least, GROUP)
               .withColumn("extra_loss_budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
               .where(F.col("weighted_squared_loss") <= F.col("_least") * (1 + F.col("extra_loss_budget")) + tolerance)
               .drop("_least"))
    return _first(offered, _demand_order(), "budgeted_demand_coverage", [*GROUP, "extra_loss_budget"])


def selected_plans(plans: DataFrame, budgets: tuple[float, ...] = (0.0, 0.002, 0.01)) -> DataFrame:
    """The plan of every policy, radius and budget."""
    none = F.lit(None).cast("double")
    chosen = select_site_min_loss(plans).withColumn("extra_loss_budget", none)
    for extra in (select_site_max_city(plans), select_site_max_demand(plans)):
        chosen = chosen.unionByName(extra.withColumn("extra_loss_budget", none))
    return chosen.unionByName(select_site_budget(plans, budgets))


def covered_points(points: DataFrame, selected: DataFrame, sites: DataFrame,
                   tolerance: float = TOLERANCE) -> DataFrame:
    """policy, radius_km, extra_loss_budget, point_id for each point a selected plan covers.

    The selected plans (policies times radii) are one small array beside every point.
    """
    listed = (selected.select("policy", "radius_km", "extra_loss_budget", F.explode(F.split("centers", r"\|")).alias("site"))
              .join(sites.select(F.col("site_id").cast("string").alias("site"), "x_km", "y_km"), "site")
              .groupBy("policy", "radius_km", "extra_loss_budget")
              .agg(F.collect_list(F.struct(F.col("x_km").alias("x"), F.col("y_km").alias("y"))).alias("m")))
    plans = listed.agg(F.collect_list(F.struct("policy", "radius_km", "extra_loss_budget", "m"))).scalar()
    each = points.select("point_id", "x_km", "y_km", F.explode(plans).alias("p"))
    nearest = F.array_min(F.transform("p.m", lambda c: euclid("x_km", "y_km", c["x"], c["y"])))
    return (each.where(nearest <= F.col("p.radius_km") + tolerance)
            .select("p.policy", "p.radius_km", "p.extra_loss_budget", "point_id"))


def policy_delta(plans: DataFrame) -> DataFrame:
    """Most demand cover against least loss for each radius, with the number of frontier plans."""
    a = select_site_min_loss(plans).drop("policy")
    b = select_site_max_demand(plans).drop("policy")
    for c in a.columns:
        if c not in GROUP:
            a, b = a.withColumnRenamed(c, f"a_{c}"), b.withColumnRenamed(c, f"b_{c}")
    frontier = pareto_frontier(plans).groupBy(*GROUP).agg(F.count_if("is_pareto").alias("pareto_plans"))
    return a.join(b, GROUP).join(frontier, GROUP).select(
        *GROUP, "pareto_plans",
        ((F.col("b_weighted_squared_loss") / F.col("a_weighted_squared_loss") - 1) * 100).alias("squared_loss_increase_pct"),
        (100 * (F.col("b_city_coverage") - F.col("a_city_coverage"))).alias("city_coverage_gain_points"),
        (100 * (F.col("b_demand_coverage") - F.col("a_demand_coverage"))).alias("demand_coverage_gain_points"),
        (F.col("a_weighted_distance_km") - F.col("b_weighted_distance_km")).alias("weighted_distance_reduction_km"))


def method_comparison(points: DataFrame, sites: DataFrame, ks: tuple[int, ...], radius: float,
                      restarts: int = 50) -> DataFrame:
    """Five ways to place k centres on a line (y = 0), with constraint and enumerated plans."""
    kmeans = weighted_kmeans(points, ks, restarts)
    exact = (optimal_1d_centers(points.withColumn("zone", F.lit(0)), ks)
             .select("k", "cluster", "x_km", F.lit(0.0).alias("y_km")))
    n_points, n_sites = points.select("x_km").distinct().count(), sites.count()
    out = None

    def add(method, centers, k, constraint, enumerated):
        nonlocal out
        near = nearest_center(points, centers.select("k", "cluster", "x_km", "y_km"), (k,))
        row = coverage(near, (radius,)).select(F.lit(method).alias("method"), "*", F.lit(constraint).alias("constraint"),
                                               F.lit(enumerated).cast("bigint").alias("enumerated_solutions"))
        out = row if out is None else out.unionByName(row)

    def from_ids(plan, k):
        ids = plan.select(F.lit(k).alias("k"), F.posexplode(F.split("centers", r"\|")).alias("cluster", "site"))
        return ids.join(sites.select(F.col("site_id").cast("string").alias("site"), "x_km", "y_km"), "site")

    for k in ks:
        plans = evaluate_sites(points, sites, k, (radius,), tolerance=0.0)
        total = comb(n_sites, k)
        add("continuous_kmeans", kmeans, k, "continuous_plane", 0)
        add("continuous_squared_exact", exact, k, "continuous_plane", comb(n_points - 1, k - 1))
        snapped = snap_centers(kmeans, sites, k).join(sites, "site_id")
        add("candidate_kmeans_snapped", snapped, k, "candidate_sites", 0)
        add("candidate_min_squared_exact", from_ids(select_site_min_loss(plans), k), k, "candidate_sites", total)
        add("candidate_max_city_cover_exact", from_ids(max_city_cover_alt_order(plans), k), k, "candidate_sites", total)
    return out
