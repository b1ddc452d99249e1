"""Best plans of k sites by branch and bound, for candidates whose plans are too many to evaluate.

Each measure of a plan (squared loss, distance, uncovered cities, uncovered demand) is a sum over points of the least
cost among the plan's sites. For any price of each point, ``sum(prices) + sum of r(site)`` over the plan's sites is a
lower bound of it, where ``r(site)`` sums ``min(0, cost - price)`` over the points. What two sites both save at a point is
counted twice by that; the sums of these overlaps over the edges of any tree on the plan's sites may be added back. So one
pass over the points bounds all plans at once: the tree links each site to the earlier site it overlaps most.

Prices come from a subgradient search on a grid of at most ``CELLS`` * ``CELLS`` cells, which bounds the driver's
part whatever the number of points. Prices that are not the best make the bounds weaker, never wrong.
Partial plans are a DataFrame; a round adds one site to each and drops those that cannot beat the best plan known. Plans that
are left are evaluated on all points, most promising first, in pages of ``PAGE``; each page may drop later ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scale import cut_lineage
from ..sources.tables import ContractError

MAX_SITES = 500
CELLS = 64
PAGE = 20_000
#: Steps of the price search for one measure.
STEPS = 1000
#: Decimals to which a measure is compared.
DECIMALS = {"loss": 6, "distance": 9, "city": 12, "demand": 12}
#: Share of a bound's terms by which it is lowered, since sums differ in the last bits with the partitioning.
SLACK = 1e-10

_DEMAND = ("demand", "loss", "city", "distance")
ORDERS = {"min_squared_loss": ("loss", "demand"), "max_city_coverage": ("city", *_DEMAND),
          "max_demand_coverage": _DEMAND, "max_city_coverage_alt": ("city", "demand", "distance"),
          "budgeted_demand_coverage": _DEMAND}


@dataclass
class Search:
    """One policy at one radius; measures are column numbers, smaller is better."""
    policy: str
    radius: int
    budget: float | None
    order: list[int]
    limit: float = float("inf")       # of the loss
    best: tuple = ()                   # rounded measures, ids
    plan: np.ndarray | None = None
    values: np.ndarray | None = None


class Measures:
    """Costs of points at sites: columns loss, distance, then city and demand for each radius."""

    def __init__(self, xy: np.ndarray, limits: list[float]):
        self.xy, self.limits = xy, limits
        self.names = ["loss", "distance", *[n for _ in limits for n in ("city", "demand")]]
        self.decimals = [DECIMALS[n] for n in self.names]

    def column(self, name: str, radius: int) -> int:
        return {"loss": 0, "distance": 1, "city": 2 + 2 * radius, "demand": 3 + 2 * radius}[name]

    def costs(self, p: np.ndarray) -> Iterator[np.ndarray]:
        squared = ((p[:, None, :] - self.xy[None, :, :]) ** 2).sum(axis=2)
        distance = np.sqrt(squared)
        yield squared
        yield distance
        for limit in self.limits:
            inside = -(distance <= limit).astype(float)
            yield inside
            yield inside

    def weights(self, w: np.ndarray) -> list[np.ndarray]:
        ones = np.ones(len(w))
        return [ones if name == "city" else w for name in self.names]

    def scaled(self, sums: np.ndarray, number: float, weight: float) -> np.ndarray:
        """Sums as loss, mean distance, and covers with a minus."""
        by = np.array([{"loss": 1.0, "city": number}.get(n, weight) for n in self.names])
        return sums / by

    def rounded(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.round(values[:, m], d) for m, d in enumerate(self.decimals)], axis=1)


def _batches(frames: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), rows):
            part = frame.iloc[at:at + rows]
            yield part[["x_km", "y_km"]].to_numpy(float), part["demand"].to_numpy(float)


# Prices on the grid ----------------------------------------------------------------------------

def _grid(points: DataFrame, cells: int) -> tuple[pd.DataFrame, dict[str, tuple[float, float]]]:
    """Centroid, weight and number of the points of each cell; a bounded table."""
    low_high = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x_km", "y_km") for n, f in (("a", F.min), ("b", F.max))]).first()
    if low_high["a_x_km"] is None:
        return pd.DataFrame(columns=["i", "j", "n", "w", "x", "y"]), {}
    frame = {c: (low_high[f"a_{c}"], (low_high[f"b_{c}"] - low_high[f"a_{c}"]) or 1.0) for c in ("x_km", "y_km")}

    def cell(c: str):
        low, width = frame[c]
        return F.least(F.floor((F.col(c) - low) / width * cells), F.lit(cells - 1)).cast("int")

    found = points.groupBy(cell("x_km").alias("i"), cell("y_km").alias("j")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("demand").alias("w"), F.avg("x_km").alias("x"), F.avg("y_km").alias("y"))
    return found.toPandas().sort_values(["i", "j"], ignore_index=True), frame


def _interchange(cost: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Greedy plan, then exchanges of one site while they help."""
    plan: list[int] = []
    near = np.full(len(cost), cost.max(initial=0.0))
    for _ in range(k):
        total = weight @ np.minimum(near[:, None], cost)
        total[plan] = np.inf
        plan.append(int(total.argmin()))
        near = np.minimum(near, cost[:, plan[-1]])
    best, better = weight @ near, True
    while better:
        better = False
        for at in range(k):
            rest = plan[:at] + plan[at + 1:]
            other = cost[:, rest].min(axis=1) if rest else np.full(len(cost), cost.max(initial=0.0))
            total = weight @ np.minimum(other[:, None], cost)
            total[rest] = np.inf
            site = int(total.argmin())
            if total[site] < best - 1e-12 * abs(best):
                plan, best, better = rest + [site], total[site], True
    return np.sort(np.array(plan))


def _prices(cost: np.ndarray, weight: np.ndarray, plan: np.ndarray, k: int) -> np.ndarray:
    """Prices of cells with a large bound, by subgradient steps towards the cost of the plan known."""
    price = cost[:, plan].min(axis=1)
    goal = weight @ price
    best, kept, theta, idle, way = -np.inf, price, 1.0, 0, np.zeros(len(price))
    for _ in range(STEPS):
        gain = weight @ np.minimum(0.0, cost - price[:, None])
        chosen = np.argpartition(gain, k - 1)[:k]
        bound = weight @ price + gain[chosen].sum()
        idle += 1
        if bound > best:
            idle = idle if bound < best + 1e-6 * abs(goal) else 0
            best, kept = bound, price
        if idle >= 30:
            theta, idle, price, way = theta / 2, 0, kept, np.zeros(len(price))
            if theta < 1e-3:
                break
            continue
        # Steps keep a part of their former direction, which damps zigzags between sites of equal worth.
        way = 0.7 * way + 1.0 - (cost[:, chosen] < price[:, None]).sum(axis=1)
        size = weight @ way ** 2
        if size == 0 or goal - best <= 1e-12 * abs(goal):
            break
        price = price + theta * max(goal - bound, 0.0) / size * way
    return kept


# Passes over the points ------------------------------------------------------------------------

def _site_sums(points: DataFrame, measures: Measures, grid: pd.DataFrame, frame: dict, cells: int,
               prices: list[np.ndarray], plans: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """For each measure: r of every site, overlaps of site pairs, sum of prices, sum under all sites; number, weight."""
    n, m = len(measures.xy), len(measures.names)
    place = np.full((cells, cells), -1)
    place[grid["i"].to_numpy(int), grid["j"].to_numpy(int)] = np.arange(len(grid))
    margins = []
    for at, cost in enumerate(measures.costs(grid[["x", "y"]].to_numpy(float))):
        margins.append(prices[at] - cost[:, plans[at]].min(axis=1) if at < 2 else prices[at])
    later = np.triu_indices(n, 1)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, pairs = np.zeros((m, n + 2)), np.zeros((m, n, n))
        number = weight = 0.0
        for p, w in _batches(frames):
            at = [np.clip(np.floor((p[:, c] - frame[name][0]) / frame[name][1] * cells), 0, cells - 1).astype(int)
                  for c, name in enumerate(("x_km", "y_km"))]
            cell = place[at[0], at[1]]
            number, weight = number + len(w), weight + w.sum()
            for i, (cost, by) in enumerate(zip(measures.costs(p), measures.weights(w))):
                price = margins[i][cell] + (cost[:, plans[i]].min(axis=1) if i < 2 else 0.0)
                saved = by[:, None] * np.maximum(0.0, price[:, None] - cost)
                total[i, :n] -= saved.sum(axis=0)
                total[i, n] += by @ price
                total[i, n + 1] += by @ cost.min(axis=1)
                if i < 2:
                    for site in range(n - 1):
                        near = np.flatnonzero(saved[:, site])
                        pairs[i, site, site + 1:] += np.minimum(saved[near, site, None], saved[near, site + 1:]).sum(axis=0)
                else:  # sites that cover a point all save the same there
                    pairs[i] += saved.T @ (saved > 0)
        if number:
            yield pd.DataFrame({"measure": np.append(np.repeat(np.arange(m), n + 2), [m, m]),
                                "site": np.append(np.tile(np.arange(n + 2), m), [0, 1]), "other": -1,
                                "s": np.append(total.ravel(), [number, weight])})
            for i in range(m):
                yield pd.DataFrame({"measure": i, "site": later[0], "other": later[1], "s": pairs[i][later]})

    found = (points.mapInPandas(sums, "measure int, site int, other int, s double").groupBy("measure", "site", "other")
             .agg(F.sum("s").alias("s")).toPandas())
    single, double = found[found["other"] < 0], found[found["other"] >= 0]
    table, pairs = np.zeros((m + 1, n + 2)), np.zeros((m, n, n))
    table[single["measure"], single["site"]] = single["s"]
    pairs[double["measure"], double["site"], double["other"]] = double["s"]
    return table[:m, :n], pairs + pairs.transpose(0, 2, 1), table[:m, n], table[:m, n + 1], table[m, 0], table[m, 1]


def _plan_sums(points: DataFrame, measures: Measures, plans: np.ndarray) -> np.ndarray:
    """Sums of every measure for a page of plans: one row for each plan from a task."""
    m = len(measures.names)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((len(plans), m)), False
        for p, w in _batches(frames, 500):
            seen = True
            for i, (cost, by) in enumerate(zip(measures.costs(p), measures.weights(w))):
                for at in range(0, len(plans), 1000):
                    part = plans[at:at + 1000]
                    near = cost[:, part[:, 0]]
                    for c in range(1, part.shape[1]):
                        near = np.minimum(near, cost[:, part[:, c]])
                    total[at:at + 1000, i] += by @ near
        if seen:
            out = pd.DataFrame(total, columns=fields)
            out.insert(0, "plan", np.arange(len(plans)))
            yield out

    fields = [f"m{i}" for i in range(m)]
    found = (points.mapInPandas(sums, "plan int, " + ", ".join(f"{f} double" for f in fields))
             .groupBy("plan").agg(*[F.sum(f).alias(f) for f in fields]).toPandas().sort_values("plan"))
    return found[fields].to_numpy(float)


# Search ------------------------------------------------------------------------------------------

class Bounds:
    """Bounds of partial plans, from what one pass over the points told about each site."""

    def __init__(self, measures: Measures, gains: np.ndarray, pairs: np.ndarray, base: np.ndarray, every: np.ndarray,
                 number: float, weight: float, k: int):
        self.measures, self.k = measures, k
        m, n = gains.shape
        self.by = measures.scaled(np.ones(m), number, weight)
        self.gains, self.pairs, self.every = gains, pairs, every
        self.base = base - SLACK * (np.abs(base) + k * np.abs(gains).max(axis=1, initial=0.0))
        # A search for a measure goes through the sites by their gain in it, so that what follows is worse; the
        # last order is that of ids. Plans are places in an order.
        self.sites = np.vstack([np.argsort(gains, axis=1, kind="stable"), np.arange(n)])
        self.places = np.argsort(self.sites, axis=1)
        # tail[o, :, i, r]: sum of the r least gains of the sites from place i of order o on
        self.tail = np.full((m + 1, m, n + 1, k + 1), np.inf)
        self.tail[..., 0] = 0.0
        for o, order in enumerate(self.sites):
            for i in range(n):
                least = np.sort(gains[:, order[i:]], axis=1)[:, :k].cumsum(axis=1)
                self.tail[o, :, i, 1:least.shape[1] + 1] = least

    def quick(self, places: np.ndarray, m: int, order: int) -> np.ndarray:
        """Bound of a measure for partial plans without overlaps."""
        bound = (self.base[m] + self.gains[m, self.sites[order][places]].sum(axis=1)
                 + self.tail[order, m, places[:, -1] + 1, self.k - places.shape[1]])
        return np.maximum(bound, self.every[m]) * self.by[m]

    def close(self, places: np.ndarray, m: int, order: int) -> np.ndarray:
        """The same with the overlaps of a tree; sites that may follow are linked to the plan as well."""
        plans, size = self.sites[order][places], places.shape[1]
        bound = self.base[m] + self.gains[m, plans].sum(axis=1)
        for at in range(1, size):
            bound += self.pairs[m, plans[:, :at], plans[:, at, None]].max(axis=1)
        left = self.k - size
        if left:
            follow = self.pairs[m, plans[:, 0]]
            for at in range(1, size):
                follow = np.maximum(follow, self.pairs[m, plans[:, at]])
            follow = np.where(self.places[order] > places[:, -1:], follow + self.gains[m], np.inf)
            bound += np.partition(follow, left - 1, axis=1)[:, :left].sum(axis=1)
        return np.maximum(bound, self.every[m]) * self.by[m]

    def keep(self, plans: np.ndarray, search: Search, order: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places of the partial plans that may hold a better plan, and how far below the best known they may be."""
        left, slack = np.arange(len(plans)), np.zeros(0)
        scale = abs(search.best[0]) or 1.0
        for rule in (self.quick, self.close):
            bound = rule(plans[left], search.order[0], order)
            good = np.isfinite(bound)
            if np.isfinite(search.limit):
                good &= rule(plans[left], 0, order) <= search.limit
            undecided = good.copy()
            good[:] = False
            for at, m in enumerate(search.order):
                value = np.round(bound if at == 0 else rule(plans[left], m, order), self.measures.decimals[m])
                good |= undecided & (value < search.best[at])
                undecided &= value == search.best[at]
                if not undecided.any():
                    break
            good |= undecided
            left, slack = left[good], ((bound - search.best[0]) / scale)[good]
        return left, slack


def _grow(spark, bounds: Bounds, searches: list[Search], n: int, k: int) -> DataFrame:
    """Plans that may be best in some search: (search, plan, slack), one site more in each round."""
    def rule(last: bool):
        def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for number, rows in frame.groupby("search"):
                    nodes = np.stack(rows["plan"].to_list())
                    for at in range(0, len(nodes), 500):
                        part = nodes[at:at + 500]
                        counts = n - 1 - part[:, -1]
                        parent = np.repeat(np.arange(len(part)), counts)
                        within = np.arange(len(parent)) - np.repeat(counts.cumsum() - counts, counts)
                        child = np.column_stack([part[parent], part[parent, -1] + 1 + within]).astype(np.int32)
                        order = searches[number].order[0]
                        good, slack = bounds.keep(child, searches[number], order)
                        if len(good):
                            found = np.sort(bounds.sites[order][child[good]], axis=1) if last else child[good]
                            yield pd.DataFrame({"search": number, "plan": pd.Series(list(found.astype(np.int32)), dtype=object),
                                                "slack": slack})
        return extend

    schema = "search int, plan array<int>, slack double"
    first = np.arange(n, dtype=np.int32)[:, None]
    start = [(s, [int(bounds.sites[search.order[0]][i] if k == 1 else i)], 0.0) for s, search in enumerate(searches)
             for i in bounds.keep(first, search, search.order[0])[0]]
    nodes = spark.createDataFrame(start, schema)
    for depth in range(2, k + 1):
        # Starts of the order have the most followers, so each round deals its nodes anew.
        nodes = nodes.repartition("search", "plan").mapInPandas(rule(depth == k), schema)
    return nodes


def _take(searches: list[Search], measures: Measures, plans: np.ndarray, values: np.ndarray, names: list[str]) -> None:
    """Let the evaluated plans compete in every search."""
    rounded = measures.rounded(values)
    for s in searches:
        allowed = np.flatnonzero(values[:, 0] <= s.limit)
        if not len(allowed):
            continue
        keys = rounded[np.ix_(allowed, s.order)]
        least = allowed[(keys == keys[np.lexsort(keys.T[::-1])[0]]).all(axis=1)]
        ids = ["|".join(names[i] for i in plans[p]) for p in least]
        at = int(least[int(np.argmin(np.array(ids, dtype=object)))])
        key = (*[float(rounded[at, m]) for m in s.order], "|".join(names[i] for i in plans[at]))
        if not s.best or key < s.best:
            s.best, s.plan, s.values = key, plans[at], values[at]


def _run(points: DataFrame, measures: Measures, bounds: Bounds, searches: list[Search], names: list[str],
         page: int) -> int:
    """Evaluate what the rounds leave, most promising first; returns the number of plans evaluated."""
    def value(plans: np.ndarray) -> np.ndarray:
        return _plan_sums(points, measures, plans) * bounds.by

    grown = _grow(points.sparkSession, bounds, searches, len(names), bounds.k)
    open_plans = cut_lineage(grown.groupBy("plan").agg(F.min("slack").alias("slack"),
                                                      F.collect_set("search").alias("searches")))
    done, last = 0, None
    while True:
        rest = open_plans
        if last is not None:
            rest = rest.where((F.col("slack") > last[0]) | ((F.col("slack") == last[0])
                              & (F.col("plan") > F.array(*[F.lit(int(i)) for i in last[1]]))))

            def still(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    if len(frame):
                        plans, good = np.stack(frame["plan"].to_list()), np.zeros(len(frame), bool)
                        for number, search in enumerate(searches):
                            mine = np.flatnonzero([number in s for s in frame["searches"]])
                            good[mine[bounds.keep(plans[mine], search)[0]]] = True
                        yield frame[good]

            rest = rest.mapInPandas(still, open_plans.schema)
        rows = rest.orderBy("slack", "plan").limit(page).select("slack", "plan").collect()
        if rows:
            plans = np.array([r["plan"] for r in rows], dtype=np.int32)
            _take(searches, measures, plans, value(plans), names)
            done, last = done + len(rows), (rows[-1]["slack"], rows[-1]["plan"])
        if len(rows) < page:
            return done


def best_plans(points: DataFrame, sites: DataFrame, k: int, radii: tuple[float, ...],
               budgets: tuple[float, ...] = (0.0, 0.002, 0.01), tolerance: float = 1e-9,
               cells: int = CELLS, page: int = PAGE, policies: tuple[str, ...] = tuple(ORDERS)) -> DataFrame:
    """The plan of every policy, radius and budget, equal to that of the ``select_site_*`` functions on all plans.

    ``plans`` is the number of all plans, ``evaluated`` how many of them had to be evaluated for the policies of
    the row's stage (least loss first, since it limits the budgets). No points, or fewer than ``k`` sites: no rows. More than
    ``MAX_SITES`` candidates: an error. Only the ``policies`` named are searched. Points must have no nulls. Reads the points once for each page and four times besides.
    """
    if k < 1 or any(b < 0 for b in budgets):
        raise ValueError("k must be positive and no loss budget negative")
    spark = points.sparkSession
    points = points.select("x_km", "y_km", "demand")
    rows = sites.select(F.col("site_id").cast("string"), "x_km", "y_km").limit(MAX_SITES + 1).collect()
    if len(rows) > MAX_SITES:
        raise ContractError(f"more than {MAX_SITES} candidate sites")
    candidates = sorted((r[0], r[1], r[2]) for r in rows)
    names, n = [c[0] for c in candidates], len(candidates)
    schema = ("policy string, radius_km double, k int, centers string, city_coverage double, demand_coverage double, "
              "weighted_distance_km double, weighted_squared_loss double, extra_loss_budget double, plans string, evaluated long")
    grid, frame = _grid(points, cells)
    if n < k or grid.empty:
        return spark.createDataFrame([], schema)
    measures = Measures(np.array([c[1:] for c in candidates], dtype=float), [float(r) + tolerance for r in radii])
    prices, starts = [], []
    by_cell = {"city": grid["n"].to_numpy(float)}
    for name, cost in zip(measures.names, measures.costs(grid[["x", "y"]].to_numpy(float))):
        weight = by_cell.get(name, grid["w"].to_numpy(float))
        starts.append(_interchange(cost, weight, k))
        prices.append(_prices(cost, weight, starts[-1], k))
    bounds = Bounds(measures, *_site_sums(points, measures, grid, frame, cells, prices, starts), k)
    known = np.unique(np.stack(starts), axis=0)
    values = _plan_sums(points, measures, known) * bounds.by

    def search(policy: str, r: int, budget: float | None = None, limit: float = float("inf")) -> Search:
        return Search(policy, r, budget, [measures.column(m, r) for m in ORDERS[policy]], limit)

    result = []

    def solve(searches: list[Search]) -> None:
        _take(searches, measures, known, values, names)
        done = _run(points, measures, bounds, searches, names, page) + len(known)
        for s in searches:
            v = [float(s.values[measures.column(m, s.radius)]) for m in ("city", "demand", "distance", "loss")]
            result.append((s.policy, float(radii[s.radius]), k, s.best[-1], -v[0], -v[1], v[2], v[3], s.budget,
                           str(comb(n, k)), done))

    least = [search("min_squared_loss", r) for r in range(len(radii))]
    solve(least)
    known = np.unique(np.vstack([known, *[s.plan[None, :] for s in least]]), axis=0)
    values = _plan_sums(points, measures, known) * bounds.by
    others = [search(p, r) for p in ("max_city_coverage", "max_demand_coverage", "max_city_coverage_alt")
              for r in range(len(radii))]
    others += [search("budgeted_demand_coverage", r, float(b), float(s.values[0]) * (1 + b) + tolerance)
               for r, s in enumerate(least) for b in budgets]
    others = [s for s in others if s.policy in policies]
    if others:
        solve(others)
    return spark.createDataFrame([r for r in result if r[0] in policies], schema)
