"""Distinct sites for continuous centres, as a minimum-cost assignment.

Each centre needs its k nearest sites only, in order of (distance, site id): k centres can take at most k - 1 of them from
it, and a farther or equally far later site is never better. Tasks keep k sites for each centre while they read the sites,
so a million sites become k * k offers, which are then assigned by successive shortest paths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import is_finite
from ..sources.tables import ContractError

#: Distances are compared in this part of a squared kilometre, so that equal totals are equal in spite of rounding.
UNIT = 1e-9


def nearest_sites(centers: list[tuple[int, float, float]], sites: DataFrame, many: int) -> DataFrame:
    """cluster, site_id, d (squared distance): the ``many`` nearest sites of each centre, ties by site id."""
    clusters = [c for c, _, _ in centers]
    xy = np.array([(x, y) for _, x, y in centers], dtype=float)
    kind = sites.schema["site_id"].dataType.simpleString()

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [pd.DataFrame({"site_id": [], "d": []}) for _ in clusters]
        for batch in batches:
            p = batch[["x_km", "y_km"]].to_numpy(float)
            for i, (x, y) in enumerate(xy):
                d = (x - p[:, 0]) * (x - p[:, 0]) + (y - p[:, 1]) * (y - p[:, 1])
                limit = np.partition(d, many - 1)[many - 1] if len(d) > many else np.inf
                if len(best[i]) == many:
                    limit = min(limit, best[i]["d"].iloc[-1])
                near = d <= limit
                if near.any():
                    new = pd.DataFrame({"site_id": batch["site_id"].to_numpy()[near], "d": d[near]})
                    both = new if best[i].empty else pd.concat([best[i], new])
                    best[i] = both.sort_values(["d", "site_id"]).head(many)
        for cluster, found in zip(clusters, best, strict=True):
            if len(found):
                yield found.assign(cluster=cluster)[["cluster", "site_id", "d"]]

    usable = sites.where(F.col("site_id").isNotNull() & is_finite("x_km") & is_finite("y_km"))
    offers = usable.select("site_id", "x_km", "y_km").mapInPandas(keep, f"cluster int, site_id {kind}, d double")
    order = Window.partitionBy("cluster").orderBy("d", "site_id")
    return offers.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= many).drop("_r")


def assign(offers: list[list[tuple[int, int]]]) -> list[int] | None:
    """Site of each centre with the least total cost, all different; ``offers`` are (site, cost) with whole costs.

    Successive shortest paths: a centre is added at a time, by the cheapest path that moves others on. Potentials keep
    reduced costs from falling below 0. None if the centres can't all have a site.
    """
    held: dict[int, int] = {}
    site_of: list[int | None] = [None] * len(offers)
    of_centre, of_site = [0] * len(offers), {s: 0 for o in offers for s, _ in o}
    for new in range(len(offers)):
        of_centre[new] = max((of_site[s] - c for s, c in offers[new]), default=0)
        centre_at, site_at, came, queue, done = {new: 0}, {}, {}, [], set()
        u, at, end = new, 0, None
        while end is None:
            for s, cost in offers[u]:
                reach = at + cost + of_centre[u] - of_site[s]
                if s not in site_at or reach < site_at[s]:
                    site_at[s], came[s] = reach, u
                    heapq.heappush(queue, (reach, s))
            while queue and queue[0][1] in done:
                heapq.heappop(queue)
            if not queue:
                return None
            at, s = heapq.heappop(queue)
            done.add(s)
            if s in held:
                u = held[s]
                centre_at[u] = at
            else:
                end = s
        for c, d in centre_at.items():
            of_centre[c] += d - at
        for s in done:
            of_site[s] += site_at[s] - at
        s = end
        while s is not None:
            u = came[s]
            held[s] = u
            site_of[u], s = s, site_of[u]
    return site_of


def snap_centers(centers: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """Map k continuous centres to k distinct sites with the least total squared distance.

    Equal totals (in ``UNIT``) choose the first list of site ids in order, then the first ids by cluster. Sites without an id or
    with coordinates that are null or not finite take no part; fewer than k sites give no rows.
    """
    mine = centers.where(F.col("k") == k).select(F.col("cluster").cast("int"), "x_km", "y_km").limit(k + 1).collect()
    if len(mine) > k:
        raise ContractError(f"more than {k} centres for k = {k}")
    spots = sorted((r[0], float(r[1]), float(r[2])) for r in mine)
    offers = nearest_sites(spots, sites, max(len(spots), 1))
    kind = sites.schema["site_id"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["site_id"]))
        place = {s: i for i, s in enumerate(ids)}
        n, bits = len(ids), len(spots) * max(len(ids).bit_length(), 1)
        listed: list[list[tuple[int, int]]] = [[] for _ in spots]
        number = {c: i for i, (c, _, _) in enumerate(spots)}
        distance = {}
        for cluster, site, d in zip(pdf["cluster"], pdf["site_id"], pdf["d"], strict=True):
            i, s = number[cluster], place[site]
            distance[i, s] = d
            # After the distance: earlier ids first, as digits of a set; then the ids by cluster, as digits of a list.
            among = (1 << n) - (1 << (n - 1 - s))
            turn = s << (max(n.bit_length(), 1) * (len(spots) - 1 - i))
            listed[i].append((s, (((round(d / UNIT) << (n + len(spots).bit_length())) + among) << bits) + turn))
        chosen = assign(listed) if all(listed) else None
        rows = [] if chosen is None else [(k, c, ids[s], distance[i, s]) for i, ((c, _, _), s)
                                          in enumerate(zip(spots, chosen, strict=True))]
        return pd.DataFrame(rows, columns=["k", "cluster", "site_id", "squared_distance"])

    # k * k offers at most.
    return offers.groupBy(F.lit(k).alias("k")).applyInPandas(
        lambda pdf: solve(pdf), f"k int, cluster int, site_id {kind}, squared_distance double")
