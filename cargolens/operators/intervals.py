"""Optimal one-dimensional centres of zones of any size.

A zone that fits into a task is split there. A larger one is laid out in chunks of positions with prefix sums, and the interval
program runs on the chunks, a layer for each number of segments: the best last cut of prefix j never moves left as j grows. First the cuts
of the chunks' ends are found, ``FAN`` times finer at each level, so each chunk of prefixes knows the range of its cuts; then pairs of (chunk of prefixes, chunk of
cuts in its range) are solved by halving, all midpoints of a level at once, and the pairs of a chunk are merged. A task holds two
chunks at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scale import cut_lineage, null_safe_join, ordered_running

#: Positions of a chunk; zones up to this size are solved whole.
CHUNK = 1 << 18
FAN = 16


def split_line(x: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, float, float]]:
    """Optimal contiguous split of sorted positions into k segments: (center, weight, loss) of each."""
    pre = np.stack([np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x)])
    m = len(x)
    cost = np.concatenate([[np.inf], _loss(pre[:, :1], pre[:, 1:])])
    cuts = []
    for r in range(2, k + 1):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        new[r:], cut[r:] = best_cuts(pre[:, r:], r, pre, cost, 0, r - 1, m - 1)
        cost = new
        cuts.append(cut)
    bounds = [m]
    for cut in reversed(cuts):
        bounds.append(int(cut[bounds[-1]]))
    bounds = [0, *reversed(bounds[1:]), m] if k > 1 else [0, m]
    return [(*_segment(pre[:, i], pre[:, j]),) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _loss(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted squared deviation of the positions between prefixes a and b (weight, first, second moment)."""
    mass, first, second = b - a
    return np.maximum(second - first * first / mass, 0.0)


def _segment(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    mass, first, _ = b - a
    return float(first / mass), float(mass), float(_loss(a, b))


def best_cuts(to: np.ndarray, j0: int, pre: np.ndarray, cost: np.ndarray, i0: int, lo: int, hi: int
              ) -> tuple[np.ndarray, np.ndarray]:
    """For prefixes j0, j0 + 1, … (moments ``to``) the least cost[i] + loss(i, j) over lo <= i <= hi, i < j, and its first i.

    ``pre`` and ``cost`` hold prefixes i0, i0 + 1, …. Midpoints are solved level by level; each level reads every cut about once.
    """
    n = to.shape[1]
    value, cut = np.full(n, np.inf), np.full(n, lo, np.int64)
    lo, hi = max(lo, i0), min(hi, i0 + pre.shape[1] - 1)
    low, high = np.array([0]), np.array([n - 1])
    first, last = np.array([lo]), np.array([hi])
    while len(low):
        mid = (low + high) // 2
        count = np.maximum(np.minimum(last, j0 + mid - 1) - first + 1, 0)
        some = np.flatnonzero(count)
        at = first.copy()
        if len(some):
            start = np.cumsum(count[some]) - count[some]
            which = np.repeat(np.arange(len(some)), count[some])
            i = first[some][which] + np.arange(len(which)) - start[which] - i0
            v = cost[i] + _loss(pre[:, i], to[:, mid[some]][:, which])
            least = np.minimum.reduceat(v, start)
            hit = np.flatnonzero(v == least[which])
            hit = hit[np.r_[True, which[hit[1:]] != which[hit[:-1]]]]
            value[mid[some]] = least
            at[some[which[hit]]] = i[hit] + i0
        cut[mid] = at
        left, right = low < mid, mid < high
        low, high, first, last = (np.concatenate(p) for p in (
            (low[left], mid[right] + 1), (mid[left] - 1, high[right]), (first[left], at[right]), (at[left], last[right])))
    return value, cut


PRE = ["w", "wx", "wxx"]


def _columns(table: pa.Table, row: int, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(table.column(c)[row].values) for c in names])


def _lists(values: list[np.ndarray], kind=pa.float64()) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _chunks(spots: DataFrame, chunk: int) -> DataFrame:
    """z, chunk, low (first prefix), m (positions of the zone) and prefix moments as arrays; positions are taken from the mean."""
    laid = ordered_running(spots, ["z"], [F.col("x")], {"j": F.lit(1).cast("bigint"), "w": F.col("d"), "wx": F.col("d") * F.col("x"),
                                                        "wxx": F.col("d") * F.col("x") * F.col("x")}, {"m": F.lit(1).cast("bigint")})
    laid = laid.withColumn("chunk", F.expr(f"(j - 1) div {chunk}"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("j")
        return pa.table({"z": table.column("z")[:1], "chunk": table.column("chunk")[:1], "low": table.column("j")[:1],
                         "m": table.column("m")[:1], **{c: _lists([table.column(c).to_numpy()]) for c in PRE}})

    return cut_lineage(laid.select("z", "chunk", "j", "m", *PRE).groupBy("z", "chunk").applyInArrow(
        pack, "z bigint, chunk bigint, low bigint, m bigint, w array<double>, wx array<double>, wxx array<double>"))


def _end_cuts(layer: DataFrame, ends: DataFrame, r: int, chunk: int) -> DataFrame:
    """z, chunk, cut: the best last cut of each chunk's last prefix, ``FAN`` times more of them at each level."""
    most = ends.agg(F.max("chunk")).first()[0] or 0
    step = 1
    while step * FAN <= most + 1:
        step *= FAN
    known = None

    def try_cuts(key: tuple, asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and rows.num_rows:
            pre, cost, low = _columns(rows, 0, PRE), _columns(rows, 0, ["cost"])[0], rows.column("low")[0].as_py()
            for a in asks.to_pylist():
                first, last = max(a["lo"], low), min(a["hi"], a["end"] - 1, low + len(cost) - 1)
                if first <= last:
                    v = cost[first - low:last - low + 1] + _loss(pre[:, first - low:last - low + 1], np.array([[a[c]] for c in PRE]))
                    at = int(np.argmin(v))
                    out.append((a["z"], a["chunk"], float(v[at]), first + at))
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(
            [("z", pa.int64()), ("chunk", pa.int64()), ("value", pa.float64()), ("cut", pa.int64())])})

    while step >= 1:
        asked = ends.where(((F.col("chunk") + 1) % step == 0) | (F.col("end") == F.col("m")))
        if known is None:
            asked = asked.withColumn("lo", F.lit(r - 1).cast("bigint")).withColumn("hi", F.col("end") - 1)
        else:  # between the cuts of the nearest ends that are known
            span = known.select(F.col("z"), F.col("chunk").alias("_k"), F.col("cut").alias("_cut"))
            near = asked.join(span, "z").groupBy(*asked.columns).agg(
                F.max(F.when(F.col("_k") <= F.col("chunk"), F.col("_cut"))).alias("lo"),
                F.min(F.when(F.col("_k") >= F.col("chunk"), F.col("_cut"))).alias("hi"))
            asked = near.withColumn("lo", F.coalesce("lo", F.lit(r - 1).cast("bigint"))).withColumn("hi", F.coalesce("hi", F.col("end") - 1))
        each = asked.withColumn("piece", F.explode(F.sequence(F.expr(f"(greatest(lo, 1L) - 1) div {chunk}"),
                                                              F.expr(f"(greatest(hi, 1L) - 1) div {chunk}"))))
        # New attributes for the second side: a cogroup of tables of one origin would mix them up.
        rows = layer.select(F.col("z").alias("z"), F.col("chunk").alias("piece"), "low", "cost", *PRE)
        found = (each.groupBy("z", "piece").cogroup(rows.groupBy("z", "piece"))
                 .applyInArrow(try_cuts, "z bigint, chunk bigint, value double, cut bigint"))
        known = cut_lineage(found.groupBy("z", "chunk").agg(F.min_by("cut", F.struct("value", "cut")).alias("cut")))
        step = 0 if step == 1 else step // FAN
    return known


def _next_layer(chunks: DataFrame, layer: DataFrame, ends: DataFrame, r: int, chunk: int) -> DataFrame:
    """z, chunk, cost, cut of all prefixes with r segments."""
    cuts = _end_cuts(layer, ends, r, chunk)
    before = cuts.select("z", (F.col("chunk") + 1).alias("chunk"), F.col("cut").alias("lo"))
    ranges = (ends.select("z", "chunk").join(cuts, ["z", "chunk"], "left").join(before, ["z", "chunk"], "left")
              .select("z", "chunk", F.coalesce("lo", F.lit(r - 1).cast("bigint")).alias("lo"),
                      F.coalesce("cut", F.lit(r - 1).cast("bigint")).alias("hi")))
    pairs = ranges.withColumn("piece", F.explode(F.sequence(F.expr(f"(greatest(lo, 1L) - 1) div {chunk}"),
                                                            F.expr(f"(greatest(hi, 1L) - 1) div {chunk}"))))
    to = chunks.select("z", "chunk", F.col("low").alias("j0"), *[F.col(c).alias(f"to_{c}") for c in PRE])
    left = pairs.join(to, ["z", "chunk"])
    right = layer.select("z", F.col("chunk").alias("piece"), "low", "cost", *PRE)
    both = left.join(right, ["z", "piece"])

    def solve(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values, cuts_ = [], []
            for i in range(table.num_rows):
                j0, low, lo, hi = (table.column(c)[i].as_py() for c in ("j0", "low", "lo", "hi"))
                value, cut = best_cuts(_columns(table, i, [f"to_{c}" for c in PRE]), j0, _columns(table, i, PRE),
                                       _columns(table, i, ["cost"])[0], low, max(lo, r - 1), hi)
                values.append(value)
                cuts_.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column("z"), batch.column("chunk"), batch.column("piece"), _lists(values),
                                              _lists(cuts_, pa.int64())], names=["z", "chunk", "piece", "cost", "cut"])

    def merge(table: pa.Table) -> pa.Table:
        value, cut = _columns(table, 0, ["cost"])[0], _columns(table, 0, ["cut"])[0]
        for i in range(1, table.num_rows):
            other, at = _columns(table, i, ["cost"])[0], _columns(table, i, ["cut"])[0]
            better = (other < value) | (other == value) & (at < cut)
            value, cut = np.where(better, other, value), np.where(better, at, cut)
        return pa.table({"z": table.column("z")[:1], "chunk": table.column("chunk")[:1], "piece": table.column("piece")[:1],
                         "cost": _lists([value]), "cut": _lists([cut], pa.int64())})

    schema = "z bigint, chunk bigint, piece bigint, cost array<double>, cut array<bigint>"
    found = both.mapInArrow(solve, schema)
    many = pairs.groupBy("z", "chunk").count().agg(F.max("count")).first()[0] or 1
    while many > 1:  # at most FAN results of a chunk meet in a task
        found = (found.withColumn("piece", F.expr(f"piece div {FAN}")) if many > FAN else found.withColumn("piece", F.lit(0).cast("bigint")))
        found = found.groupBy("z", "chunk", "piece").applyInArrow(merge, schema)
        many = many // FAN + 1 if many > FAN else 1
    return cut_lineage(found.select("z", "chunk", "cost", "cut"))


def _large(spots: DataFrame, ks: tuple[int, ...], chunk: int) -> DataFrame:
    """z, k, cluster, x (from the mean), weight, loss of zones in chunks."""
    chunks = _chunks(spots, chunk)
    last = F.element_at
    ends = cut_lineage(chunks.select("z", "chunk", "m", (F.col("low") + F.size("w") - 1).alias("end"), *[last(c, -1).alias(c) for c in PRE]))

    def alone(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cost = [_loss(np.zeros((3, 1)), _columns(table, i, PRE)) for i in range(table.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("z", "chunk", "low", *PRE)], _lists(cost)],
                                             names=["z", "chunk", "low", *PRE, "cost"])

    layer = chunks.select("z", "chunk", "low", *PRE).mapInArrow(
        alone, "z bigint, chunk bigint, low bigint, w array<double>, wx array<double>, wxx array<double>, cost array<double>")
    cuts = {}
    for r in range(2, max(ks) + 1):
        cuts[r] = _next_layer(chunks, cut_lineage(layer), ends, r, chunk)
        layer = chunks.select("z", "chunk", "low", *PRE).join(cuts[r].select("z", "chunk", "cost"), ["z", "chunk"])

    def at(rows: DataFrame, table: DataFrame, place: str, picks: dict[str, str]) -> DataFrame:
        """Join entry ``place`` of the arrays of its chunk."""
        named = table.select("z", F.col("chunk").alias("_c"), *[F.col(a).alias(f"_{b}") for a, b in picks.items()])
        rows = rows.withColumn("_c", F.expr(f"({place} - 1) div {chunk}"))
        return (rows.join(named, ["z", "_c"], "left")
                .select(*[c for c in rows.columns if c != "_c"],
                        *[F.get(f"_{b}", F.expr(f"cast(({place} - 1) % {chunk} AS int)")).alias(b) for b in picks.values()]))

    out = None
    zones = ends.select("z", "m").distinct()
    for k in (k for k in ks):
        bounds = zones.select("z", F.col("m").alias("j"), F.lit(k).alias("r"))
        every = bounds
        for r in range(k, 1, -1):  # one row a zone at each step
            bounds = at(bounds.where(F.col("r") == r), cuts[r], "j", {"cut": "cut"}).select("z", F.col("cut").alias("j"), F.lit(r - 1).alias("r"))
            every = every.unionByName(bounds)
        moments = at(every, chunks, "j", {c: c for c in PRE})
        previous = moments.select("z", (F.col("r") + 1).alias("r"), *[F.col(c).alias(f"a_{c}") for c in PRE])
        part = moments.join(previous, ["z", "r"], "left").select(
            "z", F.lit(k).alias("k"), (F.col("r") - 1).alias("cluster"),
            *[(F.col(c) - F.coalesce(f"a_{c}", F.lit(0.0))).alias(c) for c in PRE])
        out = part if out is None else out.unionByName(part)
    return out.select("z", "k", "cluster", (F.col("wx") / F.col("w")).alias("x"), F.col("w").alias("weight"),
                      F.greatest(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w"), F.lit(0.0)).alias("loss"))


def optimal_1d_centers(points: DataFrame, ks: tuple[int, ...], zone: str = "zone", chunk: int = CHUNK) -> DataFrame:
    """Exact weighted one-dimensional k-means of each zone: zone, k, cluster, x_km, weight, loss.

    Points of a zone at the same x are summed before they meet; positions without weight do not count. A zone of fewer than k
    positions has no rows for that k. Small zones run in parallel, each in a task; large ones in chunks (see the module).
    """
    spots = points.groupBy(zone, "x_km").agg(F.sum("demand").alias("demand")).where(F.col("demand") > 0)
    spots = cut_lineage(spots)
    sizes = spots.groupBy(zone).agg(F.count(F.lit(1)).alias("_m"), (F.sum(F.col("demand") * F.col("x_km")) / F.sum("demand")).alias("_mean"))
    large = cut_lineage(sizes.where(F.col("_m") > chunk).withColumn("z", F.monotonically_increasing_id()))
    kind = points.schema[zone].dataType.simpleString()
    schema = f"{zone} {kind}, k int, cluster int, x_km double, weight double, loss double"

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x_km")
        x, w = pdf["x_km"].to_numpy(float), pdf["demand"].to_numpy(float)
        rows = [(key[0], k, i, *segment) for k in ks if k <= len(x) for i, segment in enumerate(split_line(x, w, k))]
        return pd.DataFrame(rows, columns=[zone, "k", "cluster", "x_km", "weight", "loss"])

    if not large.count():
        return spots.groupBy(zone).applyInPandas(split, schema)
    whole = null_safe_join(spots, large.select(zone), [zone], "left_anti").groupBy(zone).applyInPandas(split, schema)
    laid = (null_safe_join(spots, large, [zone])
            .select("z", (F.col("x_km") - F.col("_mean")).alias("x"), F.col("demand").cast("double").alias("d")))
    solved = (_large(laid, ks, chunk).join(large, "z")
              .select(zone, "k", "cluster", (F.col("x") + F.col("_mean")).alias("x_km"), "weight", "loss"))
    return whole.unionByName(solved)
