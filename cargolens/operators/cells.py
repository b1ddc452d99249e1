"""Sums of Euclidean distances to all points of many weighted sets, without visiting all pairs.

Points are dealt to the leaves of a k-d tree (some hundred points each). Leaves near each other meet point by
point. Two nodes whose gap is at least ``APART`` times the larger half side exchange weights at a grid of Chebyshev
points instead: there the distance is smooth. Measured on 16,000 points: no sum of 48,000 was off by more than a part
of 4e-8, their mean by 3e-10; the tests hold sums to 1e-7. Work grows with the points.

The tree's cuts come from a sample; they decide where the work is done, not what is summed. Regions (subtrees of
``REGION`` levels) are the tasks: one receives its own points, those of the leaves near it and the grids of the
nodes that it needs from farther away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scale import cut_lineage

#: Chebyshev points a side, and the gap of far nodes in half sides.
NODES, APART = 8, 1.5
#: Points of a leaf, levels of a tree at most, levels of a region, levels above a region at least, sampled points a leaf.
LEAF, DEEPEST, REGION, ABOVE, SAMPLED = 512, 13, 7, 5, 32
#: Rows and columns of a tile of distances, which stays in a core's cache.
TILE = 128, 1024


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order from 1; ``dims`` and ``cuts`` split them, ``low`` and ``high`` bound their points."""

    depth: int
    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def top(self) -> int:
        """Level of the regions."""
        return max(self.depth - REGION, min(self.depth, ABOVE))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node, at = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[at, self.dims[node]] > self.cuts[node])
        return node

    def regions(self) -> np.ndarray:
        nodes = np.arange(1 << self.top, 2 << self.top)
        return nodes[self.low[nodes, 0] <= self.high[nodes, 0]]

    def grid(self, node: int) -> np.ndarray:
        """The Chebyshev points of a node's box."""
        one = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
        middle, half = (self.low[node] + self.high[node]) / 2, (self.high[node] - self.low[node]) / 2
        sides = np.meshgrid(*[m + h * one for m, h in zip(middle, half, strict=True)], indexing="ij")
        return np.stack([s.ravel() for s in sides], axis=1)

    def basis(self, x: np.ndarray, node: int) -> np.ndarray:
        """Values at ``x`` of the interpolation polynomials of a node's grid."""
        turn = (np.arange(NODES) + 0.5) * np.pi / NODES
        out = np.ones((len(x), 1))
        for f in range(x.shape[1]):
            half = (self.high[node, f] - self.low[node, f]) / 2
            u = (x[:, f] - (self.low[node, f] + self.high[node, f]) / 2) / (half or 1.0)
            angle = np.arccos(np.clip(u, -1, 1))
            orders = np.arange(1, NODES)
            side = (1 + 2 * np.cos(np.outer(angle, orders)) @ np.cos(np.outer(orders, turn))) / NODES
            out = (out[:, :, None] * side[:, None, :]).reshape(len(x), -1)
        return out

    def meetings(self, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Far pairs of nodes and near pairs of leaves that make up the given pairs of nodes."""
        half, leaf = (self.high - self.low).max(axis=1) / 2, 1 << self.depth
        far, near = [], []
        while len(t):
            gap = np.maximum(np.maximum(self.low[t] - self.high[s], self.low[s] - self.high[t]), 0)
            gap = np.sqrt((gap * gap).sum(axis=1))
            apart = (gap > 0) & (gap >= APART * np.maximum(half[t], half[s]))
            far.append(np.stack([t[apart], s[apart]]))
            t, s = t[~apart], s[~apart]
            ends = (t >= leaf) & (s >= leaf)
            near.append(np.stack([t[ends], s[ends]]))
            t, s = t[~ends], s[~ends]
            first = (s >= leaf) | (t < leaf) & (half[t] >= half[s])
            a, b, c, d = t[first], s[first], t[~first], s[~first]
            t, s = np.concatenate([2 * a, 2 * a + 1, c, c]), np.concatenate([b, b, 2 * d, 2 * d + 1])
            filled = (self.low[t, 0] <= self.high[t, 0]) & (self.low[s, 0] <= self.high[s, 0])
            t, s = t[filled], s[filled]
        none = np.zeros((2, 0), dtype=np.int64)
        return np.concatenate([none, *far], axis=1), np.concatenate([none, *near], axis=1)


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split features and values: the longest side of a node's sample, at its median."""
    dims, cuts, members = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth), {1: sample}
    for node in range(1, 1 << depth):
        x = members.pop(node)
        left = np.zeros(len(x), dtype=bool)
        if len(x):
            dims[node] = np.ptp(x, axis=0).argmax()
            values = x[:, dims[node]]
            cuts[node] = np.median(values)
            if cuts[node] >= values.max() > values.min():
                cuts[node] = values[values < values.max()].max()
            left = values <= cuts[node]
        members[2 * node], members[2 * node + 1] = x[left], x[~left]
    return dims, cuts


def _bounded(depth: int, dims: np.ndarray, cuts: np.ndarray, leaves: list, d: int) -> Tree:
    """The tree with the boxes of its points; a node without points has its low end above its high end."""
    low, high = np.full((2 << depth, d), np.inf), np.full((2 << depth, d), -np.inf)
    for leaf, *ends in leaves:
        low[leaf], high[leaf] = ends[:d], ends[d:]
    for node in range((1 << depth) - 1, 0, -1):
        low[node] = np.minimum(low[2 * node], low[2 * node + 1])
        high[node] = np.maximum(high[2 * node], high[2 * node + 1])
    return Tree(depth, dims, cuts, low, high)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of well separated points, as one product."""
    middle = (x.mean(axis=0) + y.mean(axis=0)) / 2
    x, y = x - middle, y - middle
    one = np.column_stack([-2 * x, (x * x).sum(axis=1), np.ones(len(x))])
    two = np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1)])
    out = one @ two.T
    return np.sqrt(out, out=out)


def _add_near(x: np.ndarray, y: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` the weighted distances from each x to all y, tile by tile."""
    for i in range(0, len(x), TILE[0]):
        a = x[i:i + TILE[0]]
        for j in range(0, len(y), TILE[1]):
            b = y[j:j + TILE[1]]
            squared = np.zeros((len(a), len(b)))
            step = np.empty_like(squared)
            for f in range(x.shape[1]):
                np.subtract(a[:, f, None], b[None, :, f], out=step)
                np.multiply(step, step, out=step)
                squared += step
            total[i:i + TILE[0]] += np.sqrt(squared, out=squared) @ weights[j:j + TILE[1]]


def _by_leaf(rows: pd.DataFrame, features: list[str], weights: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    leaf = rows["_leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    nodes, first = np.unique(leaf[order], return_index=True)
    x, w = rows[features].to_numpy(float), rows[weights].to_numpy(float)
    return {int(n): (x[at], w[at], at) for n, at in zip(nodes, np.split(order, first[1:]), strict=True)}


def distance_sums(points: DataFrame, features: list[str], weights: list[str], leaf: int | None = None) -> DataFrame:
    """Add ``_sums``, the distance sums to all points by weight column, and ``_met``, the weights met one by one.

    ``points`` has a number ``_fid`` for each family of points that see each other, finite features, no two equal
    rows of a family, and one numeric column for each weighted set. Per family the driver holds the cuts and boxes
    of at most 2**DEEPEST leaves.
    """
    d, spark, leaf = len(features), points.sparkSession, leaf or LEAF
    points = cut_lineage(points)
    sizes = {r["_fid"]: r["n"] for r in points.groupBy("_fid").agg(F.count(F.lit(1)).alias("n")).collect()}
    depths = {f: min(DEEPEST, max(0, int(np.ceil(np.log2(n / leaf))))) for f, n in sizes.items()}
    every = {f: max(1, n // (SAMPLED << depths[f])) for f, n in sizes.items()}
    keep = F.lit(False)
    for f, n in every.items():
        keep = keep | (F.col("_fid") == f) & (F.pmod(F.xxhash64(*features), F.lit(n)) == 0)
    sample = points.where(keep).select("_fid", *features).toPandas()
    cuts = {f: _cuts(sample.loc[sample["_fid"] == f, features].to_numpy(float), depths[f]) for f in sizes}
    bare = {f: Tree(depths[f], *cuts[f], np.zeros((0, d)), np.zeros((0, d))) for f in sizes}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = np.zeros(len(batch), dtype=np.int64)
            for f in batch["_fid"].unique():
                mine = (batch["_fid"] == f).to_numpy()
                nodes[mine] = bare[f].leaf_of(batch.loc[mine, features].to_numpy(float))
            yield batch.assign(_leaf=nodes)

    columns = "_fid int, " + ", ".join(f"{c} double" for c in [*features, *weights])
    points = points.select(F.col("_fid").cast("int"), *[F.col(c).cast("double") for c in [*features, *weights]])
    dealt = cut_lineage(points.mapInPandas(deal, columns + ", _leaf bigint"))
    ends = dealt.groupBy("_fid", "_leaf").agg(*[F.min(f) for f in features], *[F.max(f) for f in features]).collect()
    trees = {f: _bounded(depths[f], *cuts[f], [r[1:] for r in ends if r["_fid"] == f], d) for f in sizes}

    near_routes, far_routes = set(), set()
    for f, tree in trees.items():
        roots = tree.regions()
        far, near = tree.meetings(np.repeat(roots, len(roots)), np.tile(roots, len(roots)))
        for routes, pairs in ((near_routes, near), (far_routes, far)):
            level = np.floor(np.log2(pairs[0])).astype(np.int64)
            routes.update((f, int(s), int(t)) for s, t in np.unique(
                np.stack([pairs[1], pairs[0] >> (level - tree.top)], axis=1), axis=0))

    def rise(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The weights of a region's nodes at their grids, from the leaves upwards."""
        tree, root = trees[key[0]], int(key[1])
        grids = {n: tree.basis(x, n).T @ w for n, (x, w, _) in _by_leaf(rows, features, weights).items()}
        for n in range((1 << tree.depth) - 1, root - 1, -1):
            if n >> (n.bit_length() - root.bit_length()) == root:
                below = [c for c in (2 * n, 2 * n + 1) if c in grids]
                if below:
                    grids[n] = sum(tree.basis(tree.grid(c), n).T @ grids[c] for c in below)
        return pd.DataFrame([(key[0], n, g.tobytes()) for n, g in grids.items()], columns=["_fid", "_node", "_grid"])

    def meet(key: tuple, rows: pd.DataFrame, grids: pd.DataFrame) -> pd.DataFrame:
        tree, root = trees[key[0]], int(key[1])
        known = _by_leaf(rows, features, weights)
        sources = {int(n): np.frombuffer(g).reshape(-1, len(weights)) for n, g in zip(grids["_node"], grids["_grid"], strict=True)}
        roots = tree.regions()
        far, near = tree.meetings(np.full(len(roots), root), roots)
        values = {}
        for t, s in far.T.tolist():
            value = _far(tree.grid(t), tree.grid(s)) @ sources[s]
            values[t] = values[t] + value if t in values else value
        leaves = {}
        for t, s in near.T.tolist():
            leaves.setdefault(t, []).append(s)
        out = []
        for n, met in sorted(leaves.items()):
            x, _, at = known[n]
            total = np.zeros((len(x), len(weights)))
            for up in range(tree.depth - tree.top + 1):
                if n >> up in values:
                    total += tree.basis(x, n >> up) @ values[n >> up]
            y, w = (np.concatenate([known[s][i] for s in met]) for i in (0, 1))
            _add_near(x, y, w, total)
            mine = rows.iloc[at][["_fid", *features, *weights]]
            out.append(mine.assign(_sums=list(total), _met=[w.sum(axis=0)] * len(mine)))
        return pd.concat(out, ignore_index=True)

    below = F.create_map(*[F.lit(v) for f, t in trees.items() for v in (f, t.depth - t.top)])
    region = F.floor(F.col("_leaf") / F.pow(F.lit(2.0), below[F.col("_fid")])).cast("bigint")
    grids = (dealt.withColumn("_region", region).groupBy("_fid", "_region")
             .applyInPandas(rise, "_fid int, _node bigint, _grid binary"))
    to_near = spark.createDataFrame(pd.DataFrame(sorted(near_routes), columns=["_fid", "_leaf", "_region"]),
                                    "_fid int, _leaf bigint, _region bigint")
    to_far = spark.createDataFrame(pd.DataFrame(sorted(far_routes), columns=["_fid", "_node", "_region"], dtype="int64"),
                                   "_fid int, _node bigint, _region bigint")
    # A task for each region: few rows, much work, so they are not to be put together by size.
    tasks = sum(len(t.regions()) for t in trees.values())
    around, beyond = (df.repartition(tasks, "_fid", "_region").groupBy("_fid", "_region") for df in (
        dealt.join(to_near, ["_fid", "_leaf"]), grids.join(to_far, ["_fid", "_node"])))
    return around.cogroup(beyond).applyInPandas(meet, columns + ", _sums array<double>, _met array<double>")
