"""The skew-proof building blocks against brute force, with one group holding most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from cargolens.functions import scale
from cargolens.functions.scale import exact_quantiles, nearest_in_time, ordered_running


def skewed(spark, n=4000):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", i, float(rng.randrange(6))) for i in range(n)]
    return spark.createDataFrame(rows, "g string, i int, v double"), rows


def test_running_sum_of_a_hot_group_equals_one_window(spark):
    df, _ = skewed(spark)
    got = ordered_running(df, ["g"], [F.col("v").desc(), F.col("i")], {"run": F.col("v"), "no": F.lit(1)},
                          {"total": F.col("v")}, partitions=7)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("run"), F.count("v").over(w).alias("no"),
                     F.sum("v").over(Window.partitionBy("g")).alias("total"))
    cols = ["g", "i", "v", "run", "no", "total"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == want.count() == 4000


def test_quantiles_equal_numpy_with_ties_negatives_and_hot_groups(spark):
    rng = np.random.default_rng(3)
    values = {"hot": np.concatenate([np.full(700, 3.25), rng.lognormal(2, 2, 800), -rng.lognormal(0, 1, 300)]),
              "one": np.array([7.5]), "zero": np.zeros(5), "two": np.array([1e-9, 4e11])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = {"a": 0.0, "b": 1 / 3, "c": 0.5, "d": 0.99, "e": 1.0}
    for r in exact_quantiles(df, ["g"], "v", fractions).collect():
        assert r["n_values"] == len(values[r["g"]])
        for name, f in fractions.items():
            assert np.isclose(r[name], np.quantile(values[r["g"]], f), rtol=1e-12, atol=1e-15)
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert np.isclose(whole["m"], np.median(np.concatenate(list(values.values()))))


def test_nearest_in_time_both_directions(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    seconds = rng.sample(range(200_000), 600)
    rows = [("u" if rng.random() < 0.7 else "w", start + dt.timedelta(seconds=s), rng.random() < 0.3) for s in seconds]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, hit boolean")
    mark = F.when(F.col("hit"), F.col("t"))
    back = {(r.k, r.t): r.x for r in nearest_in_time(df, ["k"], "t", mark, "x").collect()}
    ahead = {(r.k, r.t): r.x for r in
             nearest_in_time(df, ["k"], "t", mark, "x", forward=True, inclusive=False).collect()}
    for k, t, _ in rows:
        hits = [b for a, b, h in rows if a == k and h]
        assert back[k, t] == max((h for h in hits if h <= t), default=None)
        assert ahead[k, t] == min((h for h in hits if h > t), default=None)


def test_null_groups_keys_and_times_lose_no_row(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 1.0)], "g string, i int, v double")
    got = ordered_running(df, ["g"], [F.col("i")], {"run": F.col("v")}, {"total": F.col("v")}).collect()
    assert sorted((r.g or "", r.i, r.run, r.total) for r in got) == [("", 1, 2.0, 5.0), ("", 2, 5.0, 5.0), ("a", 1, 1.0, 1.0)]
    medians = {r.g: r.m for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert medians == {None: 2.5, "a": 1.0}
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(None, t, 1), (None, t + dt.timedelta(hours=2), None), ("k", None, 5),
                                    ("k", t, 7), ("k", t + dt.timedelta(hours=1), None)],
                                   "k string, t timestamp_ntz, v int")
    near = nearest_in_time(events, ["k"], "t", F.col("v"), "x").collect()
    assert len(near) == 5
    assert {(r.k, r.t and r.t.hour): r.x for r in near} == {(None, 0): 1, (None, 2): 1, ("k", None): None,
                                                            ("k", 0): 7, ("k", 1): 7}


def test_one_key_with_all_rows_in_one_hour_is_spread(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("u", start + dt.timedelta(seconds=s), s if s % 7 == 0 else None) for s in range(3000)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v int")
    got = {r.t: r.x for r in nearest_in_time(df, ["k"], "t", F.col("v"), "x", partitions=8).collect()}
    assert all(got[start + dt.timedelta(seconds=s)] == s - s % 7 for s in range(3000))


def test_values_that_are_not_finite_are_refused_by_name(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(Exception, match="quantiles of v: values must be finite"):
        exact_quantiles(df, [], "v", {"m": 0.5}).collect()


def test_a_bucket_of_many_unequal_values_is_split_until_small(spark):
    """All values of a group in one bucket of the code, near zero and near one, with repeats; a part holds 50 rows at most."""
    rng = np.random.default_rng(8)
    values = {"one": 1 + rng.random(3000) * 1e-4, "tiny": np.concatenate([10.0 ** -rng.uniform(8, 300, 900), -10.0 ** -rng.uniform(8, 300, 900), np.zeros(300)]),
              "equal": np.full(400, 2.5), None: np.concatenate([np.full(200, 1.0), 1 + rng.random(500) * 1e-9])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = {"a": 0.0, "b": 1 / 3, "c": 0.5, "d": 0.99, "e": 1.0}
    got = exact_quantiles(df, ["g"], "v", fractions, rows_a_bucket=50).collect()
    assert len(got) == 4
    for r in got:
        want = np.quantile(values[r["g"]], list(fractions.values()))
        assert np.allclose([r[n] for n in fractions], want, rtol=1e-12, atol=0)


def test_tasks_follow_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    """Partitions grow with the files and keep their size; smaller settings of the session stay."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.files.maxPartitionBytes")
    first, merged, scanned = names
    before = {n: spark.conf.get(n, None) for n in names}
    monkeypatch.setattr(scale, "TABLES", ("a", "b"))
    monkeypatch.setattr(scale, "DEALT", 1000)
    try:
        for size in (1, 500_000):
            for t in scale.TABLES:
                spark.range(size).repartition(2).write.parquet(str(tmp_path / str(size) / f"{t}.parquet"))
            spark.conf.set(merged, "64MB")
            spark.conf.set(scanned, "8k")
            scale.finer_tasks(spark, str(tmp_path / str(size)), scale.TABLES)
            length = sum(f.stat().st_size for f in (tmp_path / str(size)).glob("*/part-*"))
            assert int(spark.conf.get(first)) == max(3, -(-length // 1000))
            assert spark.conf.get(merged) == f"{scale.TOGETHER}b" and spark.conf.get(scanned) == "8k"
        assert int(spark.conf.get(first)) > 1000
        scale.session_settings(spark)
        assert spark.conf.get(first, None) is None
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
