"""Customer features, segmentation, agreement and drift.

Features are ``[period,] customer_id, orders, business_volume, recency_days``. Label tables hold
``customer_id, cluster`` next to their group columns (period, method, seed, k).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import all_close, band, melt, pairs
from ..functions.scale import cut_lineage, exact_quantiles, null_safe_join
from .cells import distance_sums
from .location import _nearest_literal, best_kmeans, best_of_runs

FEATURES = ["orders", "business_volume", "recency_days"]
SCORE_REASON = "groups outside 2..n-1"
#: Part of the sizes involved by which a cluster's bound may be missed through rounding.
SLACK = 1e-9
#: Distinct rows of a labelling from which distances are summed by cells, and clusters and features up to which.
BY_CELLS, SETS, SIDES = 20_000, 64, 3
#: Seed of the labels that other seeds are compared with.
BASE_SEED = 42


def customer_features(waybills: DataFrame, volume: DataFrame, cutoff: str) -> DataFrame:
    """Orders, volume and recency of each customer present in both sources; a repeated volume row is an error."""
    per_customer = waybills.groupBy("customer_id").agg(
        F.count_distinct("waybill_id").alias("orders"), F.max("date").alias("last_date"),
        F.sum("quantity").alias("summed_quantity"))
    once = [c for c in volume.columns if c != "customer_id"]
    single = volume.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in once])
    single = single.select("customer_id", *[F.when(F.col("_n") == 1, F.col(c)).otherwise(F.raise_error(F.concat(
        F.lit("more than one volume row for customer "), F.col("customer_id").cast("string")))).alias(c) for c in once])
    return (per_customer.join(single, "customer_id")
            .withColumn("recency_days", F.date_diff(F.lit(cutoff).cast("date"), F.col("last_date"))))


def period_features(waybills: DataFrame, cutoffs: dict[str, str], panel: bool = True) -> DataFrame:
    """Features at several observation dates, for the panel of customers present in the first period.

    ``left_out_customers`` names the others; ``panel=False`` keeps them, in the periods in which they have orders.

    One pass over the waybills (ids unique, see ``contracts.dup_keys``): every period is a
    conditional aggregate of the same group.
    """
    first = min(cutoffs, key=cutoffs.get)
    aggs = []
    for p, c in cutoffs.items():
        seen = F.col("date") < F.lit(c).cast("date")
        aggs += [F.count_if(seen).alias(f"n_{p}"), F.sum(F.when(seen, F.col("quantity"))).alias(f"q_{p}"),
                 F.max(F.when(seen, F.col("date"))).alias(f"d_{p}")]
    wide = waybills.groupBy("customer_id").agg(*aggs)
    if panel:
        wide = wide.where(F.col(f"n_{first}") > 0)
    rows = F.array(*[F.struct(
        F.lit(p).alias("period"), F.col(f"n_{p}").alias("orders"), F.col(f"q_{p}").alias("business_volume"),
        F.date_diff(F.lit(c).cast("date"), F.col(f"d_{p}")).alias("recency_days")) for p, c in cutoffs.items()])
    return wide.select("customer_id", F.inline(rows)).where(F.col("orders") > 0)


def left_out_customers(waybills: DataFrame, cutoffs: dict[str, str]) -> DataFrame:
    """customer_id, first_date of the customers who come after the first observation date and before the last."""
    dates = sorted(cutoffs.values())
    known = waybills.where(F.col("date") < F.lit(dates[-1]).cast("date"))
    return (known.groupBy("customer_id").agg(F.min("date").alias("first_date"))
            .where(F.col("first_date") >= F.lit(dates[0]).cast("date")))


def volume_reconcile_check(features: DataFrame) -> DataFrame:
    """Violations: customers whose waybill sum is not close to the volume source."""
    return features.where(~all_close("summed_quantity", "business_volume")).select(
        "customer_id", "summed_quantity", "business_volume")


def _moments(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])


def standardize(df: DataFrame, columns: list[str] = FEATURES, group: str = "period",
                reference: str | None = None) -> DataFrame:
    """Population z-scores z_<column>; a constant column is divided by one.

    With ``reference`` every group uses that group's mean and deviation.
    """
    if reference is None:
        joined = df.join(_moments(df, columns, [group]), group)
    else:
        fixed = _moments(df.where(F.col(group) == reference), columns, [])
        stats = fixed.select(F.struct(*fixed.columns)).scalar()
        joined = df.withColumn("_f", stats).select("*", "_f.*").drop("_f")
    for c in columns:
        scale = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        joined = joined.withColumn(f"z_{c}", (F.col(c) - F.col(f"_m_{c}")) / scale)
    return joined.drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def _block_sums(features: list[str], ids: list[str], own: int, other: int, tile: int) -> Callable:
    """Distance sums between two blocks, by the clusters of the other side that a row needs.

    ``own`` and ``other`` are the positions of the two block numbers in the group key. A row needs its own cluster
    and each one whose mean is no farther than the row's ``_reach``. A pair of blocks meets once, cluster by cluster
    of the right side: distances computed for rows on the left that need the cluster also serve the right side's rows;
    what those still lack follows. At most ``tile`` squared distances are held at a time.
    """
    columns = [*ids, "w", "other", "distance"]
    means = [f"_m_{f}" for f in features]

    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        squared = np.zeros((len(x), len(y)))
        for f in range(x.shape[1]):
            step = x[:, f, None] - y[None, :, f]
            squared += step * step
        return np.sqrt(squared)

    def prepared(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("cluster", kind="stable").reset_index(drop=True)
        clusters, start, codes = np.unique(rows["cluster"].to_numpy(), return_index=True, return_inverse=True)
        weights = np.zeros((len(rows), len(clusters)))
        weights[np.arange(len(rows)), codes] = rows["w"].to_numpy(float)
        return rows, rows[features].to_numpy(float), clusters, [*start, len(rows)], codes, weights

    def needs(rows: pd.DataFrame, x: np.ndarray, clusters: np.ndarray, centers: np.ndarray) -> np.ndarray:
        reach = rows["_reach"].to_numpy(float)[:, None]
        size = np.abs(x).sum(axis=1)[:, None] + np.abs(centers).sum(axis=1)[None, :]
        far = distances(x, centers) > reach + SLACK * (reach + size)
        return ~far | (rows["cluster"].to_numpy()[:, None] == clusters[None, :])

    def add(x, y, w_x, w_y, to_x, to_y, at_x, at_y):
        for i in range(0, len(at_x), tile):
            for j in range(0, len(at_y), tile):
                p, q = at_x[i:i + tile], at_y[j:j + tile]
                distance = distances(x[p], y[q])
                if to_x is not None:
                    to_x[p] += distance @ w_y[q]
                if to_y is not None:
                    to_y[q] += distance.T @ w_x[p]

    def sums(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left, x, mine, first_x, code_x, w_x = prepared(left)
        right, y, theirs, first_y, _, w_y = prepared(right)
        both = key[own] != key[other]
        right_need = needs(left, x, theirs, right[means].to_numpy(float)[first_y[:-1]])
        left_need = needs(right, y, mine, left[means].to_numpy(float)[first_x[:-1]])
        to_right, to_left = np.zeros((len(x), len(theirs))), np.zeros((len(y), len(mine)))
        for c in range(len(theirs)):
            there = np.arange(first_y[c], first_y[c + 1])
            asking = right_need[:, c]
            add(x, y, w_x, w_y, to_right, to_left if both else None, np.flatnonzero(asking), there)
            if both:
                wanted = left_need[there].any(axis=0)
                rest = np.flatnonzero(~asking & wanted[code_x])
                lacking = there[left_need[there][:, np.unique(code_x[rest])].any(axis=1)]
                add(x, y, w_x, w_y, None, to_left, rest, lacking)
        out = []
        for rows, need, clusters, total in ((left, right_need, theirs, to_right), (right, left_need, mine, to_left))[:1 + both]:
            at, which = np.nonzero(need)
            out.append(rows.loc[at, [*ids, "w"]].assign(other=clusters[which], distance=total[at, which]))
        return pd.concat(out, ignore_index=True)[columns]
    return sums


def merged_points(points: DataFrame, features: list[str], groups: list[str]) -> DataFrame:
    """Equal (features, cluster) rows with their number w, written once for the steps that follow."""
    return cut_lineage(points.groupBy(*groups, *features, "cluster").agg(F.count(F.lit(1)).alias("w")))


def with_reach(rows: DataFrame, features: list[str], groups: list[str], centers: int = 1000) -> DataFrame:
    """Add each row's cluster mean ``_m_<feature>`` and ``_reach``, a bound from above on its b.

    The mean distance to a cluster lies between the distance to its mean and that plus the cluster's mean radius, so
    a cluster whose mean is farther than ``_reach`` cannot be the nearest. ``_reach`` is the least upper end over the
    ``centers`` largest other clusters of the group (any of them gives a valid bound).
    """
    whole = [F.count(f) == F.count(F.lit(1)) for f in features]
    means = rows.groupBy(*groups, "cluster").agg(F.sum("w").alias("_size"), *[
        F.when(ok, F.sum(F.col(f) * F.col("w")) / F.sum("w")).alias(f"_m_{f}") for f, ok in zip(features, whole, strict=True)])
    near = null_safe_join(rows, means, [*groups, "cluster"])

    def length(pairs_: list[tuple[Column, Column]]) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [(p - q) * (p - q) for p, q in pairs_]))

    own = length([(F.col(f), F.col(f"_m_{f}")) for f in features])
    named = [F.col(f"_m_{f}") for f in features]
    balls = near.groupBy(*groups, "cluster", "_size", *named).agg(
        (F.sum(own * F.col("w")) / F.max("_size")).alias("_radius"))
    by_size = Window.partitionBy(*groups).orderBy(F.desc("_size"), "cluster")
    largest = (balls.withColumn("_no", F.row_number().over(by_size)).where(F.col("_no") <= centers)
               .groupBy(*groups).agg(F.collect_list(F.struct("cluster", "_radius", *named)).alias("_balls")))
    upper = F.transform("_balls", lambda c: F.when(
        c["cluster"] != F.col("cluster"), length([(F.col(f), c[f"_m_{f}"]) for f in features]) + c["_radius"]))
    return null_safe_join(near, largest, groups).withColumn("_reach", F.array_min(upper)).drop("_balls", "_size")


def _pair_sums(rows: DataFrame, features: list[str], groups: list[str], block: int) -> DataFrame:
    """Each row with its cluster's ``size``, ``_own`` distance sum, ``b`` and ``summed``, from pairs of rows.

    Rows are hashed into blocks, as many as give every task of the session a pair of blocks: each row is copied
    about the root of the number of tasks, whatever the number of rows. A pair of blocks works in tiles of
    ``block`` rows and returns distance sums by cluster, so pairs of points are computed but never stored, and one
    large cluster is spread over many tasks. A row is summed with its own cluster and with those that can be its
    nearest (``with_reach``); ``summed`` is the number of points of these. Exact: a cluster left out is farther.
    """
    ids = [*groups, *features, "cluster"]
    sizes = rows.groupBy(*groups, "cluster").agg(F.sum("w").alias("size"))
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = int(np.ceil(np.sqrt(2 * tasks)))
    shape = rows.groupBy(*groups).agg(F.least(F.ceil(F.count(F.lit(1)) / 500), F.lit(most)).cast("int").alias("_blocks"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = with_reach(rows, features, groups).join(shape, groups).withColumn(
        "_own", F.pmod(F.xxhash64(*features, "cluster"), F.col("_blocks")).cast("int"))
    targets = rows.withColumn("_s", F.explode(F.expr("sequence(_own, _blocks - 1)"))).withColumnRenamed("_own", "_t")
    sources = rows.withColumn("_t", F.explode(F.expr("sequence(0, _own)"))).withColumnRenamed("_own", "_s")
    sources = sources.select(*[F.col(c).alias(c) for c in sources.columns])
    keys = [*groups, "_t", "_s"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ids), "w bigint", f"other {kinds['cluster']}", "distance double"])
    pair_sums = _block_sums(features, ids, len(groups), len(groups) + 1, block)
    partial = targets.groupBy(*keys).cogroup(sources.groupBy(*keys)).applyInPandas(pair_sums, schema)
    total = partial.groupBy(*ids, "w", "other").agg(F.sum("distance").alias("distance"))
    other_size = sizes.withColumnRenamed("cluster", "other").withColumnRenamed("size", "other_size")
    own = F.col("cluster") == F.col("other")
    return (total.join(other_size, [*groups, "other"])
            .groupBy(*ids, "w")
            .agg(F.max(F.when(own, F.col("other_size"))).alias("size"),
                 F.max(F.when(own, F.col("distance"))).alias("_own"),
                 F.min(F.when(~own, F.col("distance") / F.col("other_size"))).alias("b"),
                 F.sum("other_size").alias("summed")))


def _large_families(rows: DataFrame, features: list[str], groups: list[str], same: tuple[str, ...]) -> DataFrame:
    """The clusters whose labellings are summed by cells: groups, cluster, ``_fid``, ``_set``, ``_labelling``, ``size``.

    A family is all labellings that differ in the ``same`` columns only; its clusters are sets 0, 1, ...
    """
    inner = [g for g in groups if g in same]
    family = [F.col(g) for g in groups if g not in same] or [F.lit(0)]
    real = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(f).cast("double")) < float("inf"), F.lit(False)) for f in features])
    each = rows.groupBy(*groups, "cluster").agg(F.count(F.lit(1)).alias("_rows"), F.sum("w").alias("size"),
                                                F.count_if(~real).alias("_bad"))
    whole, by_set = Window.partitionBy(*family), Window.partitionBy(*family).orderBy(*inner, "cluster")
    each = each.withColumn("_labelled", F.sum("_rows").over(Window.partitionBy(*groups))).withColumn(
        "_set", F.row_number().over(by_set) - 1)
    large = ((F.max("_labelled").over(whole) >= BY_CELLS) & (F.sum("_bad").over(whole) == 0)
             & (F.max("_set").over(whole) < SETS))
    labelling = F.dense_rank().over(Window.partitionBy(*family).orderBy(*inner)) if inner else F.lit(1)
    each = each.withColumn("_large", large).withColumn("_labelling", labelling).where("_large")
    # At most SETS rows for each family of BY_CELLS points.
    number = F.dense_rank().over(Window.partitionBy().orderBy(*family)) if len(inner) < len(groups) else F.lit(1)
    return cut_lineage(each.withColumn("_fid", number.cast("int")).select(*groups, "cluster", "_fid", "_set", "_labelling", "size"))


def _cell_sums(rows: DataFrame, features: list[str], groups: list[str], clusters: DataFrame) -> DataFrame:
    """What ``_pair_sums`` gives, for the families in ``clusters``; ``summed`` counts the points met one by one."""
    known: dict[int, list] = {}
    for r in clusters.orderBy("_fid", "_set").select("_fid", "_set", "_labelling", "size").collect():
        known.setdefault(r["_fid"], []).append((r["_labelling"], r["size"]))
    weights = [f"_w{i}" for i in range(max(map(len, known.values())))]
    keys = [*groups, "cluster"]
    points = (null_safe_join(rows, clusters.select(*keys, "_fid", "_set"), keys).groupBy("_fid", *features)
              .agg(*[F.sum(F.when(F.col("_set") == i, F.col("w")).otherwise(0)).alias(w) for i, w in enumerate(weights)]))

    def nearest(batches):
        for batch in batches:
            w = batch[weights].to_numpy(float)
            sums, met = (np.stack(batch[c].to_numpy()) if len(batch) else w for c in ("_sums", "_met"))
            for family in batch["_fid"].unique():
                labelling, size = (np.array(v) for v in zip(*known[family], strict=True))
                mine = (batch["_fid"] == family).to_numpy()
                for s in range(len(size)):
                    at = np.flatnonzero(mine & (w[:, s] > 0))
                    own = labelling == labelling[s]
                    others = np.flatnonzero(own & (np.arange(len(size)) != s))
                    b = (sums[at][:, others] / size[others]).min(axis=1) if len(others) else None
                    yield batch.iloc[at][["_fid", *features]].assign(
                        _set=s, w=w[at, s].astype(np.int64), _own=sums[at, s], b=b,
                        summed=met[at][:, np.flatnonzero(own)].sum(axis=1).astype(np.int64))

    schema = "_fid int, " + ", ".join(f"{f} double" for f in features) + ", _set int, w bigint, _own double, b double, summed bigint"
    found = distance_sums(points, features, weights).mapInPandas(nearest, schema)
    return found.join(clusters.withColumn("_set", F.col("_set").cast("int")), ["_fid", "_set"]).select(
        *groups, *features, "cluster", "w", "size", "_own", "b", "summed")


def silhouette_values(rows: DataFrame, features: list[str], groups: list[str],
                      block: int = 2000, same: tuple[str, ...] = ()) -> DataFrame:
    """Euclidean silhouette of each row of ``merged_points``.

    Labellings of fewer than ``BY_CELLS`` distinct rows (or more than ``SETS`` clusters, ``SIDES`` features or values that
    are not finite) sum their distances by pairs of rows, larger ones by cells (``cells.distance_sums``), all labellings
    of the same points at once. ``same`` names the groups whose labellings mostly share their points; the result
    doesn't depend on it.
    """
    clusters = _large_families(rows, features, groups, same) if len(features) <= SIDES else None
    if clusters is None or clusters.isEmpty():
        sums = _pair_sums(rows, features, groups, block)
    else:
        large = clusters.select(*groups).distinct()
        on = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(F.col(f"_k_{g}")) for g in groups])
        rest = rows.join(large.select(*[F.col(g).alias(f"_k_{g}") for g in groups]), on, "left_anti")
        sums = _cell_sums(rows, features, groups, clusters)
        if not rest.isEmpty():
            sums = sums.unionByName(_pair_sums(cut_lineage(rest), features, groups, block))
    return (sums.withColumn("a", F.when(F.col("size") > 1, F.try_divide("_own", F.col("size") - 1)))
            .withColumn("silhouette", F.when(F.col("size") == 1, 0.0)
                        .when(F.greatest("a", "b") == 0, 0.0)
                        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
            .drop("_own"))


def silhouette(points: DataFrame, features: list[str], groups: list[str], block: int = 2000,
               same: tuple[str, ...] = ()) -> DataFrame:
    """Mean silhouette of each labelling, or null with the reason; ``same``: see ``silhouette_values``.

    ``pruned_share`` is the part of all ordered pairs of points that did not meet one by one.
    """
    rows = merged_points(points, features, groups)
    shape = (rows.groupBy(*groups, "cluster").agg(F.sum("w").alias("w")).groupBy(*groups)
             .agg(F.count(F.lit(1)).alias("actual_clusters"), F.sum("w").alias("n")))
    fit = (F.col("actual_clusters") >= 2) & (F.col("actual_clusters") < F.col("n"))
    scorable = rows.join(shape.where(fit).select(*groups), groups, "left_semi")
    whole = F.sum("w").cast("double")
    means = silhouette_values(scorable, features, groups, block, same).groupBy(*groups).agg(
        (F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("silhouette"),
        (1 - F.sum(F.col("summed").cast("double") * F.col("w")) / (whole * whole)).alias("pruned_share"))
    return shape.join(means, groups, "left").withColumn("reason", score_reason())


def score_reason(clusters: str = "actual_clusters", n: str = "n") -> Column:
    """Why a labelling cannot be scored; null when it can."""
    bad = (F.col(clusters) < 2) | (F.col(clusters) >= F.col(n))
    return F.when(bad, F.concat(F.col(clusters).cast("string"), F.lit(f" {SCORE_REASON}")))


def tercile_limits(features: DataFrame, group: str = "period", value: str = "business_volume") -> DataFrame:
    """The exact thirds q1 and q2 of each group."""
    return exact_quantiles(features, [group], value, {"q1": 1 / 3, "q2": 2 / 3}).select(group, "q1", "q2")


def with_limits(features: DataFrame, limits: DataFrame, group: str, names: tuple[str, str],
                reference: str | None = None) -> DataFrame:
    """Add the limits of each row's group, or of the reference group, to every row; no row is lost."""
    named = limits.select(group, F.col("q1").alias(names[0]), F.col("q2").alias(names[1]))
    if reference is None:
        return null_safe_join(features, named, [group], "left")
    pair = named.where(F.col(group) == reference).select(F.struct(*names)).scalar()
    return features.withColumn("_pair", pair).select("*", "_pair.*").drop("_pair")


def volume_terciles(features: DataFrame, group: str = "period", value: str = "business_volume",
                    reference: str | None = None) -> DataFrame:
    """volume_rule 0, 1, 2 by the exact thirds of each group, or of the reference group."""
    both = with_limits(features, tercile_limits(features, group, value), group, ("_q1", "_q2"), reference)
    return both.withColumn("volume_rule", band(value, "_q1", "_q2")).drop("_q1", "_q2")


def adjusted_rand(labels: DataFrame, a: str, b: str, groups: list[str]) -> DataFrame:
    """Adjusted Rand index from the contingency table; 1 when undefined.

    Labels are counted once; the windows run over the cells, at most clusters squared rows for each
    group. Members of a margin m form m(m-1)/2 pairs, added up cell by cell.
    """
    cells = labels.groupBy(*groups, a, b).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    margin = {c: F.sum("_n").over(Window.partitionBy(*groups, c)) for c in (a, b)}
    half = {c: F.col("_n") * (m - 1) / 2 for c, m in margin.items()}
    cells = cells.select(*groups, "_n", half[a].alias("_a"), half[b].alias("_b"))
    total = cells.groupBy(*groups).agg(F.sum(pairs("_n")).alias("_both"), F.sum("_n").alias("n"),
                                       F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    expected = F.try_divide(F.col("_a") * F.col("_b"), pairs("n"))
    spread = (F.col("_a") + F.col("_b")) / 2 - expected
    ari = F.coalesce(F.try_divide(F.col("_both") - expected, F.nullif(spread, F.lit(0.0))), F.lit(1.0))
    return total.select(*groups, F.col("n").cast("bigint").alias("n"), ari.alias("ari"))


def segment_profiles(labelled: DataFrame, groups: list[str]) -> DataFrame:
    """Size and raw-unit means of each cluster."""
    return labelled.groupBy(*groups, "cluster").agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("orders").alias("mean_orders"),
        F.avg("business_volume").alias("mean_volume"), F.avg("recency_days").alias("mean_recency"))


def assign_centers(df: DataFrame, features: list[str], centers: list[tuple[float, ...]]) -> DataFrame:
    """cluster = index of the nearest of a few stored centres."""
    return df.withColumn("cluster", _nearest_literal(centers, features))


def label_by_centers(scaled: DataFrame, centers: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """cluster = nearest stored centre of already scaled features.

    ``centers`` holds cluster and one z_<column> for each feature: a few rows, kept beside each
    customer as one small array.
    """
    z = [f"z_{c}" for c in columns]
    packed = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", *z)))).scalar()

    def distance(c):
        total = F.lit(0.0)
        for name in z:
            total = total + (F.col(name) - c[name]) * (F.col(name) - c[name])
        return F.sqrt(total)

    found = F.array_min(F.transform("_c", lambda c: F.struct(distance(c).alias("d"), c["cluster"].alias("cluster"))))
    return scaled.withColumn("_c", packed).withColumn("cluster", found["cluster"]).drop("_c")


def apply_fixed_model(features: DataFrame, centers: DataFrame, reference: str, group: str = "period",
                      columns: list[str] = FEATURES) -> DataFrame:
    """Label every period with the reference period's scaling and stored centres."""
    return label_by_centers(standardize(features, columns, group, reference), centers, columns)


def fit_labels(scaled: DataFrame, features: list[str], k: int, restarts: int = 10, seed: int = 42,
               keep: list[str] | None = None) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """Best k-means labels and centres; k <= 1 puts everybody into group 0."""
    keep = keep or ["customer_id"]
    if k <= 1:
        return scaled.select(*keep, *features, F.lit(0).alias("cluster")), []
    _, centers = best_kmeans(scaled, features, k, restarts, seed)
    return assign_centers(scaled, features, centers).select(*keep, *features, "cluster"), centers


def kmeans_sweep(features: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), restarts: int = 10,
                 columns: list[str] = FEATURES) -> DataFrame:
    """method, k, actual_clusters, silhouette, reason for each k and for the volume thirds.

    A k beyond the customers or the distinct feature rows has no groups and a reason.
    """
    z = [f"z_{c}" for c in columns]
    one = features.withColumn("period", F.lit("all"))
    scaled = cut_lineage(standardize(one, columns))
    n, distinct = scaled.agg(F.count(F.lit(1)), F.count_distinct(*z)).first()
    labelled, refused, possible = None, [], []

    def add(df):
        nonlocal labelled
        labelled = df if labelled is None else labelled.unionByName(df)

    for k in ks:
        if k > min(n, distinct):
            refused.append(("kmeans", k, 0, None, f"{n} customers, {distinct} distinct rows: {k} groups impossible"))
            continue
        possible.append(k)
    for k, (_, centers) in zip(possible, best_of_runs(scaled, z, [(k, BASE_SEED) for k in possible], restarts)
                               if possible else [], strict=True):
        add(assign_centers(scaled, z, centers).select(F.lit("kmeans").alias("method"), F.lit(k).alias("k"), *z, "cluster"))
    if min(3, distinct, max(1, n - 1)) == 1:
        refused.append(("kmeans", 1, 1, None, f"1 {SCORE_REASON}"))
    rule = volume_terciles(scaled)
    add(rule.select(F.lit("volume_rule").alias("method"), F.lit(3).alias("k"), *z, F.col("volume_rule").alias("cluster")))
    out = silhouette(labelled, z, ["method", "k"], same=("method", "k")).select("method", "k", "actual_clusters", "silhouette", "reason")
    if refused:
        out = out.unionByName(features.sparkSession.createDataFrame(
            refused, "method string, k int, actual_clusters bigint, silhouette double, reason string"))
    return out


def seed_stability(features: DataFrame, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), k: int = 3,
                   restarts: int = 10, columns: list[str] = FEATURES) -> DataFrame:
    """Agreement (ARI) of other seeds with the labels of the base seed, and the least agreement of all.

    All runs share their passes. ``restarts=1`` gives the single-initialisation variant.
    """
    z = [f"z_{c}" for c in columns]
    scaled = cut_lineage(standardize(features.withColumn("period", F.lit("all")), columns))
    found = best_of_runs(scaled, z, [(k, BASE_SEED), *((k, s) for s in seeds)], restarts)
    base = found[0][1]
    labelled = scaled.withColumn("base", _nearest_literal(base, z))
    runs = F.array(*[F.struct(F.lit(s).alias("seed"),
                              _nearest_literal(centers, z).alias("cluster"))
                     for s, (_, centers) in zip(seeds, found[1:], strict=True)])
    each = adjusted_rand(labelled.select("base", F.inline(runs)), "base", "cluster", ["seed"]).select("seed", "ari")
    return each.withColumn("min_ari", F.min("ari").over(Window.partitionBy()))  # one row for each seed


def single_init_labels(features: DataFrame, seeds: tuple[int, ...] = (0, 1, 2, 3, 4, 5), k: int = 3,
                       columns: list[str] = FEATURES) -> DataFrame:
    """customer_id, seed, cluster of runs with one initialisation each."""
    z = [f"z_{c}" for c in columns]
    scaled = cut_lineage(standardize(features.withColumn("period", F.lit("all")), columns))
    found = best_of_runs(scaled, z, [(k, s) for s in seeds], 1)
    runs = F.array(*[F.struct(F.lit(s).alias("seed"), _nearest_literal(centers, z).alias("cluster"))
                     for s, (_, centers) in zip(seeds, found, strict=True)])
    return scaled.select("customer_id", F.inline(runs))


def refit_centers(features: DataFrame, period: str, reference: str, k: int = 3, restarts: int = 10,
                  columns: list[str] = FEATURES) -> DataFrame:
    """Centres fitted on ``period`` under the reference period's scaling."""
    z = [f"z_{c}" for c in columns]
    scaled = standardize(features, columns, "period", reference).where(F.col("period") == period)
    _, centers = best_kmeans(cut_lineage(scaled), z, k, restarts)
    return features.sparkSession.createDataFrame(
        [(period, i, *c) for i, c in enumerate(centers)],
        "period string, cluster int, " + ", ".join(f"{c} double" for c in z))


def volume_bands(features: DataFrame, reference: str, group: str = "period",
                 value: str = "business_volume") -> DataFrame:
    """volume_fixed keeps the reference period's thresholds, volume_refit recomputes them."""
    limits = cut_lineage(tercile_limits(features, group, value))
    both = with_limits(with_limits(features, limits, group, ("_r1", "_r2")), limits, group, ("_f1", "_f2"), reference)
    return (both.withColumn("volume_fixed", band(value, "_f1", "_f2"))
            .withColumn("volume_refit", band(value, "_r1", "_r2")).drop("_f1", "_f2", "_r1", "_r2"))


def assignment_long(wide: DataFrame, methods: list[str]) -> DataFrame:
    """period, customer_id, method, cluster."""
    return melt(wide, ["period", "customer_id"], {m: m for m in methods}, "method", "cluster", "int")


def drift_metrics(features: DataFrame, reference: str, k: int = 3,
                  restarts: int = 10, columns: list[str] = FEATURES) -> DataFrame:
    """Silhouette, agreement with the first period and with the volume rule, by period and method."""
    z = [f"z_{c}" for c in columns]
    scaled = cut_lineage(standardize(features, columns, "period", reference))
    first = scaled.where(F.col("period") == reference)
    _, fixed = best_kmeans(first, z, k, restarts)
    later = scaled.where(F.col("period") != reference)
    _, refit = best_kmeans(later, z, k, restarts)
    wide = (volume_bands(scaled, reference)
            .withColumn("kmeans_fixed", _nearest_literal(fixed, z))
            .withColumn("kmeans_refit", F.when(F.col("period") == reference, F.col("kmeans_fixed"))
                        .otherwise(_nearest_literal(refit, z))))
    return labelled_drift(wide, z, reference, ["kmeans_fixed", "kmeans_refit", "volume_fixed", "volume_refit"])


def labelled_drift(wide: DataFrame, z: list[str], reference: str, methods: list[str],
                   rule: str = "volume_refit") -> DataFrame:
    """The same measures for given label columns."""
    long = melt(wide.withColumn("rule", F.col(rule)), ["period", "customer_id", *z, "rule"], {m: m for m in methods},
                "method", "cluster", "int")
    return long_drift(long, z, reference).drop("k")


def long_drift(long: DataFrame, z: list[str], reference: str) -> DataFrame:
    """The measures and the number of clusters k of labels in rows: period, customer_id, method, cluster, rule and features."""
    keys = ["period", "method"]
    start = long.where(F.col("period") == reference).select(
        "customer_id", "method", F.col("cluster").alias("first_cluster"))
    scores = silhouette(long.select(*keys, *z, "cluster"), z, keys, same=("method",)).select(
        *keys, F.col("actual_clusters").alias("k"), "silhouette")
    to_first = adjusted_rand(long.join(start, ["customer_id", "method"]), "first_cluster", "cluster", keys)
    to_rule = adjusted_rand(long, "rule", "cluster", keys)
    return (scores.join(to_first.select(*keys, F.col("ari").alias("ari_to_first_period")), keys)
            .join(to_rule.select(*keys, F.col("ari").alias("ari_to_volume_refit")), keys))


def unit_period_reconcile(left: DataFrame, right: DataFrame,
                          factors: dict[tuple[str, str], float]) -> DataFrame:
    """Status of two sources (customer_id, period, quantity, unit); both originals are kept.

    Order of the rules: missing value, different period, known unit factor, equal, unexplained.
    ``factors[(left unit, right unit)]`` states how many left units one right unit holds.
    """
    l = left.select("customer_id", *[F.col(c).alias(f"left_{c}") for c in ("period", "quantity", "unit")])
    r = right.select("customer_id", *[F.col(c).alias(f"right_{c}") for c in ("period", "quantity", "unit")])
    known = F.when(F.col("left_unit") == F.col("right_unit"), F.lit(1.0))
    for (a, b), factor in factors.items():
        known = known.when((F.col("left_unit") == a) & (F.col("right_unit") == b), F.lit(float(factor)))
    joined = l.join(r, "customer_id", "full_outer").withColumn("known_unit_factor", known)
    close = F.coalesce(all_close("left_quantity", F.col("right_quantity") * F.col("known_unit_factor")), F.lit(False))
    status = (F.when(F.col("left_quantity").isNull() | F.col("right_quantity").isNull(), "missing_value")
              .when(F.col("left_period") != F.col("right_period"), "different_period")
              .when(close & (F.col("known_unit_factor") != 1), "convertible")
              .when(close, "equal").otherwise("review"))
    return joined.withColumn("status", status)
