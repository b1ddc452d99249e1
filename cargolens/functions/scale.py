"""Building blocks that keep one hot group from landing in one task.

* ``ordered_running`` – running sums inside groups of any size: range partitions are
  written to the checkpoint folder once, chunk totals give each chunk its offset.
* ``exact_quantiles`` – interpolated quantiles from a coarse histogram followed by the few buckets that
  hold the wanted ranks, split again while they are large; nothing approximate in the result.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .expressions import any_of, col

#: Rows that one task orders in ``ordered_running`` and ``nearest_in_time``.
ROWS_A_CHUNK = 2_000_000
#: Unequal values that one task orders in ``exact_quantiles``, and the parts of a bucket that holds more.
ROWS_A_BUCKET = 1_000_000
PARTS = 4096
#: Bytes of the tables for each partition of a shuffle before small ones are put together, and at most: bytes of
#: a partition put together, bytes of a file that one task scans.
DEALT, TOGETHER, SCANNED = 8 << 20, 16 << 20, 32 << 20
#: The tables that grow; the others are dimensions.
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``; a temporary folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="cargolens-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal; the right side's keys are dropped."""
    named = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])


def frozen_ranges(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """Rows in range partitions of bounded size with their frozen number ``_chunk``."""
    rows = cut_lineage(df)  # the ranges are sampled and then dealt: both read what is written
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                          rows.count() // ROWS_A_CHUNK + 1)
    return cut_lineage(rows.repartitionByRange(n, *order).withColumn("_chunk", F.spark_partition_id()))


def ordered_running(df: DataFrame, groups: list[str], order: list[Column],
                    sums: dict[str, Column], totals: dict[str, Column] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums (and whole-group sums) in the given order.

    A group may be larger than a task: rows are range partitioned by (group, order), the
    partition number is frozen by the checkpoint, and each (group, partition) chunk starts
    from the sum of the chunks before it. The chunk table holds at most one row for each
    group plus one for each partition boundary. The number of partitions follows the rows. Null groups
    are groups like others.
    """
    totals = totals or {}
    ranged = frozen_ranges(df, [*[F.col(g) for g in groups], *order], partitions)

    measures = {**{f"_s_{k}": v for k, v in sums.items()}, **{f"_t_{k}": v for k, v in totals.items()}}
    chunks = ranged.groupBy(*groups, "_chunk").agg(*[F.sum(v).alias(k) for k, v in measures.items()])
    before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    chunks = chunks.select(
        *groups, "_chunk",
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(whole).alias(k) for k in totals])
    inside = (Window.partitionBy(*groups, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = null_safe_join(ranged, chunks, [*groups, "_chunk"])
    for k, v in sums.items():
        joined = joined.withColumn(k, F.sum(v).over(inside) + F.col(f"_o_{k}"))
    return joined.drop("_chunk", *[f"_o_{k}" for k in sums])


def _log_bucket(v: Column) -> Column:
    """Monotone integer code of a double: 2,048 steps for each doubling of 1+1024|v|."""
    steps = F.floor(F.log2(F.lit(1.0) + F.abs(v) * 1024.0) * 2048.0)
    return (F.signum(v) * steps).cast("bigint")


def _part() -> Column:
    """Monotone part, 0 to ``PARTS`` - 1, of ``_v`` between ``_low`` and ``_high``.

    Split by sign first, then by logarithm while one end is more than twice the other, then linearly.
    """
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")

    def share(a: Column, b: Column, c: Column) -> Column:
        return F.floor((b - a) / (c - a) * (PARTS - 1))

    return (F.when((low < 0) & (high >= 0) | (low <= 0) & (high > 0), F.signum(v) + 1)
            .when((low > 0) & (high / 2 > low), share(F.ln(low), F.ln(v), F.ln(high)))
            .when((high < 0) & (low / 2 < high), share(-F.ln(-low), -F.ln(-v), -F.ln(-high)))
            .otherwise(share(low, v, high)).cast("bigint"))


def exact_quantiles(df: DataFrame, groups: list[str], value: str | Column,
                    fractions: dict[str, float], rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Linear-interpolated quantiles for each group, exact at any size.

    Round 1 counts a monotone bucket code (combined map-side, at most some ten thousand codes for each group) and
    keeps the buckets that contain the two neighbouring ranks of each fraction. While a kept bucket holds more than
    ``rows_a_bucket`` rows of unequal value, it is split between its least and greatest value (``_part``) and counted
    again: no task orders more than ``rows_a_bucket`` values. Each round tells the driver only whether another is
    needed; a handful of rounds tells any two doubles apart. A null group is a group; null values are left out; a value that is not finite
    is an error.
    """
    keys = list(groups) or ["_all"]
    rows = df if groups else df.withColumn("_all", F.lit(0))
    finite = F.when(F.isnan("_v") | (F.abs("_v") == float("inf")),
                    F.raise_error(F.lit(f"quantiles of {value}: values must be finite"))).otherwise(F.col("_v"))
    rows = (rows.select(*keys, col(value).cast("double").alias("_v")).withColumn("_v", finite)
            .where(F.col("_v").isNotNull())
            .select(*keys, "_v", F.lit(0).cast("bigint").alias("_first"), F.lit(None).cast("bigint").alias("_n"),
                    _log_bucket(F.col("_v")).alias("_b")))

    def position(f: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(f))

    ranks = [g(position(f)) for f in fractions.values() for g in (F.floor, F.ceil)]
    hit = any_of([(F.col("_next") <= r) & (r < F.col("_next") + F.col("_c")) for r in ranks])
    before = Window.partitionBy(*keys, "_first").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    large = (F.col("_c") > rows_a_bucket) & (F.col("_low") < F.col("_high"))
    while True:
        hist = (rows.groupBy(*keys, "_first", "_n", "_b")
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
                .withColumn("_n", F.coalesce("_n", F.sum("_c").over(Window.partitionBy(*keys))))
                .withColumn("_next", F.col("_first") + F.coalesce(F.sum("_c").over(before), F.lit(0))))
        wanted = cut_lineage(hist.where(hit))
        rows = (null_safe_join(rows.drop("_n"), wanted, [*keys, "_first", "_b"])
                .select(*keys, "_v", F.col("_next").alias("_first"), "_n",
                        F.when(large, _part()).otherwise(0).alias("_b")))
        if wanted.where(large).isEmpty():
            break
    inside = rows.groupBy(*keys, "_first", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*keys, "_first").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = (inside.withColumn("_hi", F.col("_first") + F.sum("_c").over(run))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    picks = []
    for i, f in enumerate(fractions.values()):
        picks += [at(F.floor(position(f))).alias(f"_l{i}"), at(F.ceil(position(f))).alias(f"_u{i}")]
    out = inside.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    result = [(F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}"))
               * (position(f) - F.floor(position(f)))).alias(name)
              for i, (name, f) in enumerate(fractions.items())]
    return out.select(*groups, F.col("_n").alias("n_values"), *result)


def nearest_in_time(df: DataFrame, keys: list[str], time: str, value: Column, name: str,
                    forward: bool = False, inclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """Add the latest earlier (or next later) non-null value of the same key.

    Rows are range partitioned by (key, time) and numbered by partition, so a key with a third of all rows, or
    with all its rows in one hour, is spread over many tasks. The lookup runs inside (key, partition); what lies
    outside comes from a table with one row for each of them. ``value`` must be null where a row offers nothing.
    Every row stays: a null key is a key, a row without a time finds nothing.
    """
    rows = frozen_ranges(df.withColumn("_value", value), [*[F.col(k) for k in keys], F.col(time)], partitions)
    direction = F.col(time).desc_nulls_last() if forward else F.col(time).asc_nulls_last()
    chunk_order = F.col("_chunk").desc() if forward else F.col("_chunk").asc()
    pick = F.min_by if forward else F.max_by
    known = F.when(F.col("_value").isNotNull(), F.col(time))
    chunks = rows.groupBy(*keys, "_chunk").agg(pick("_value", known).alias("_edge"))
    outside = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "_chunk", F.last("_edge", ignorenulls=True).over(outside).alias("_outside"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(direction)
    inside = (inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive
              else inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    found = F.when(F.col(time).isNotNull(), F.coalesce("_inside", "_outside"))
    return (null_safe_join(rows, chunks, [*keys, "_chunk"]).withColumn(name, found)
            .drop("_chunk", "_value", "_inside", "_outside"))


def _bytes(size: str) -> int:
    """A size setting in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def finer_tasks(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES) -> None:
    """Let the number of tasks follow the size of the tables, so that the memory of one does not.

    Shuffles start with a partition for each ``DEALT`` bytes of the tables (the session's number, if that is more);
    small ones are put together up to ``TOGETHER`` bytes, a scan reads up to ``SCANNED``. Smaller settings of the
    session stay. Only lengths of files are read.
    """
    files = spark.read.format("binaryFile").load([f"{folder}/{t}.parquet" for t in tables])
    size = files.agg(F.sum("length")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(least, -(-size // DEALT)))
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TOGETHER), ("spark.sql.files.maxPartitionBytes", SCANNED)):
        if _bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")


def session_settings(spark: SparkSession, folder: str | None = None) -> None:
    """Split hot join keys even when a later aggregate then needs one more shuffle; dates in UTC; tasks by ``folder``."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    if folder is None:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    else:
        finer_tasks(spark, folder)
