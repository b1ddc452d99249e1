"""Stored tables against recomputed ones, links, typed reads."""

import hashlib

import duckdb
import pytest

from pyspark.sql import functions as F

from cargolens.operators import delivery as T, segments as G, verify as V
from cargolens.plans import QUERIES, full_sql
from cargolens.sources import tables as S


def test_a_table_equals_itself_with_null_keys_and_values(spark):
    df = spark.createDataFrame([(None, 1.0, "x"), ("a", None, None), ("b", 2.0, "y")], "k string, v double, t string")
    assert V.tolerant_diff(df, df, ["k"], ["v"], ["t"]).count() == 0


def test_repeats_are_reported_on_both_sides_and_hide_nothing(spark):
    once = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "k string, v double")
    twice = spark.createDataFrame([("a", 5.0), ("a", 3.0), ("b", 1.0)], "k string, v double")
    got = {(r.key, r.status, r.stored, r.fresh) for r in V.tolerant_diff(twice, once, ["k"], ["v"]).collect()}
    assert got == {("a", "repeated", None, None), ("a", "differs", 3.0, 5.0)}
    got = {(r.key, r.status, r.stored, r.fresh) for r in V.tolerant_diff(once, twice, ["k"], ["v"]).collect()}
    assert got == {("a", "repeated_fresh", None, None), ("a", "differs", 5.0, 3.0)}


def test_links_are_resolved_like_a_browser(spark):
    base = "http://h.org"
    pages = [(1, f"{base}/a/b/page.html", "<a href='sib.html'><a HREF=\"../up.html?x#y\"><a href='sp%20ace.html'>"
                                          "<a href='./no.html'><a href='../../../top'><a href='#f'><a href='mailto:x'>"),
             (2, f"{base}/a/b/sib.html", "<a href='/a/up.html'><a href='//other.org/x'>"), (3, f"{base}/a/up.html", ""),
             (4, f"{base}/a/b/sp ace.html", None), (5, base, "<a href='gone'>")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = sorted((r.page_id, r.target) for r in V.broken_links(df).collect())
    assert got == [(1, f"{base}/a/b/no.html"), (1, f"{base}/top"), (5, f"{base}/gone")]


ODD_PAGES = [
    (1, "http://h.org/a/p.html", "<a href=q.html><a class=x href=r.html><a href=\"it's.html\"><a data-href='no'><a href = 'R&#38;D.html'>"
                                 "<a href='caf&#xE9;&lt;.html'><a href='x?a=1&amp;b=2'><a href='&amp;#38;.html'><a href='&bad;&#0;'>"),
    (2, "http://h.org/a/b.html", "<base target=_top href='/c/d/'><a href=e.html><a href='/r.html'>"),
    (3, "http://h.org/a/c.html", "<BASE HREF=sub/><a href=../r.html><a href=s.html>"),
    (4, "http://h.org/a/d.html", "<base href='http://h.org/z/y.html'><a href=k.html>"),
    (5, "http://h.org/a/e.html", "<base href='http://else.org/'><a href=k.html>"), (6, "http://h.org/a/f.html", "<base href='//else.org/'><a href=k.html>"),
    (7, "http://h.org/a/r.html", None), (8, "http://h.org/c/d/e.html", "")]
ODD_LINKS = [(1, "/a/&bad;&"), (1, "/a/&"), (1, "/a/R&D.html"), (1, "/a/caf\u00e9<.html"), (1, "/a/it's.html"), (1, "/a/q.html"), (1, "/a/x"),
             (2, "/r.html"), (3, "/a/sub/s.html"), (4, "/z/k.html")]


def test_links_bare_referenced_and_based(spark):
    """The query and its twin on values in all forms, character references and bases of every kind."""
    df = spark.createDataFrame(ODD_PAGES, "page_id int, url string, html string")
    got = sorted((r.page_id, r.target.removeprefix("http://h.org")) for r in V.broken_links(df).collect())
    assert got == sorted(ODD_LINKS)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INTEGER, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ODD_PAGES)
    twin = con.execute(full_sql(QUERIES["broken_links"])).fetchall()
    assert sorted((int(i), t.removeprefix("http://h.org")) for i, t in twin) == sorted(ODD_LINKS)


def test_parquet_types_must_be_the_declared_ones(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(path)
    assert S.read_table(spark, path, "name string, id int", fmt="parquet").columns == ["name", "id"]
    with pytest.raises(S.ContractError, match="id: int instead of bigint"):
        S.read_table(spark, path, "id bigint", fmt="parquet")
    with pytest.raises(S.ContractError, match="missing columns"):
        S.read_table(spark, path, "id int, more string", fmt="parquet")


def test_digests_are_named_by_the_path_from_the_root(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0.txt").write_text(folder)
    found = S.file_digest(spark, f"file://{tmp_path}")
    assert sorted(r.file for r in found.collect()) == ["x/part-0.txt", "y/part-0.txt"]
    assert {r.status for r in S.manifest_diff(found, found).collect()} == {"same"}


def test_digests_are_those_of_the_bytes(spark, tmp_path):
    """Names with spaces and percent signs, an empty file, and one above 2 GB (sparse, so it takes no disk)."""
    contents = {"a b%20c#.bin": b"\x00\xff" * 5, "empty.bin": b"", "block.bin": b"z" * S.BLOCK + b"y"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    zeros = hashlib.sha256()
    with open(tmp_path / "large.bin", "wb") as large:
        large.truncate((2 << 30) + 5)
    for _ in range(1 << 11):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(5))
    want = {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}
    got = {r.file: r for r in S.file_digest(spark, str(tmp_path)).collect()}
    assert {name: r.sha256 for name, r in got.items()} == {**want, "large.bin": zeros.hexdigest()}
    assert got["large.bin"].bytes == (2 << 30) + 5 and got["empty.bin"].bytes == 0


def test_evidence_must_exist_lead_to_a_number_and_name_its_kind(spark):
    documents = spark.createDataFrame([("a.json", '{"x": {"y.z": 1.5, "t": "word"}}'), ("b.json", "{}"), ("b.json", "{}")],
                                      "file string, content string")
    claims = spark.createDataFrame([
        ("good", "a.json", ["x", "y.z"], 1.5, "real"), ("far", "a.json", ["x", "no"], 1.5, "real"),
        ("text", "a.json", ["x", "t"], 1.5, "real"), ("off", "a.json", ["x", "y.z"], 1.4, " "),
        ("twice", "b.json", ["x"], 1.0, "real"), ("lost", "c.json", ["x"], 1.0, "real")],
        "id string, file string, keys array<string>, value double, data_kind string")
    got = sorted((r.id, r.status) for r in V.claim_evidence(claims, documents).collect())
    assert got == [("far", "keys_lead_nowhere"), ("lost", "file_missing"), ("off", "evidence_differs"), ("off", "kind_missing"),
                   ("text", "not_a_number"), ("twice", "file_repeated"), ("twice", "keys_lead_nowhere")]


def test_each_breach_of_the_duration_tables_is_named(spark):
    import datetime as dt
    w = dt.date(2024, 3, 1)
    rows = [(w, m, i, 9, w + dt.timedelta(days=i), 10.0, 12.0) for m in T.DURATION_METHODS for i in range(3)]
    bad = [(w, "hour_median", 3, 24, w, 5.0, 5.0), (w, "hour_median", 4, None, w + dt.timedelta(days=14), float("inf"), -1.0),
           (w, "hour_median", 5, 0, None, None, 1.0), (w, "hour_median", 2, 0, w + dt.timedelta(days=13), 0.0, 0.0)]
    kinds = ("window_start date, method string, sample_index int, accept_hour int, accept_date date, actual_minutes double, "
             "prediction_minutes double")
    end = w + dt.timedelta(days=13)
    good_metrics = [(w, end, m, 7) for m in T.DURATION_METHODS]
    metric_kinds = "window_start date, window_end date, method string, known_training_records int"

    def problems(predictions, metrics):
        found = V.duration_tables_check(spark.createDataFrame(predictions, kinds), spark.createDataFrame(metrics, metric_kinds), 14)
        return sorted((r.key.split("|", 1)[-1], r.field, r.status) for r in found.collect())

    assert problems(rows, good_metrics) == []
    assert problems([], []) == []
    assert problems(rows + bad, good_metrics) == sorted([
        ("hour_median|3", "accept_hour", "not_an_hour"), ("hour_median|4", "accept_hour", "not_an_hour"),
        ("hour_median|4", "accept_date", "outside_window"), ("hour_median|4", "actual_minutes", "not_finite"),
        ("hour_median|4", "prediction_minutes", "negative"), ("hour_median|5", "actual_minutes", "not_finite"),
        ("hour_median|5", "accept_date", "outside_window"), ("hour_median|2", "sample_index", "repeated")])
    late = w + dt.timedelta(days=14)
    assert problems(rows, [(w, None, "global_median", 7), (w, end, "hour_median", 8), (late, late, "hour_median", 1)]) == sorted([
        ("global_median", "window_end", "wrong_end"), ("hour_median", "window_end", "wrong_end"),
        ("2024-03-01", "known_training_records", "unequal_training"), ("global_median", "method", "missing_method"),
        ("global_median", "method", "missing_method"), ("hour_median", "method", "missing_method")])


def test_published_links_must_lead_to_the_evidence(spark):
    links = {"good": "[a](task/s.json)", "dots": "[a](./x/../task/s.json)", "other": "[a](task2/s.json)", "up": "[a](../task/s.json)",
             "above": "[a](../../out/task/s.json)", "root": "[a](/out/task/s.json)", "site": "[a](http://h/s.json)",
             "query": "[a](task/s.json?x)", "mark": "[a](task/s.json#x)", "words": "task/s.json", "blank": "[a](task/ s.json)", "none": None}
    claims = spark.createDataFrame([(i, "out/task/s.json") for i in links], "id string, file string")
    published = spark.createDataFrame(list(links.items()), "id string, link string").where("id <> 'none'")
    got = {r.id: r.status for r in V.claim_links(claims, published, "out").collect()}
    assert got == {"other": "leads_elsewhere", "up": "leads_elsewhere", "above": "leads_elsewhere", "root": "not_relative",
                   "site": "not_relative", "query": "not_relative", "mark": "not_relative", "words": "not_a_link",
                   "blank": "not_a_link", "none": "not_published"}


def test_stored_labels_of_all_methods_and_seeds(spark):
    """Right tables give no row; a fault in each table is found under its name."""
    features = spark.createDataFrame([(p, i, 1 + i % 4, 10.0 * (i % 3) + (p == "later") * (i % 2), 5 + i) for p in ("first", "later")
                                      for i in range(12)], "period string, customer_id int, orders int, business_volume double, recency_days int")
    z = [f"z_{c}" for c in G.FEATURES]
    wide = (G.volume_bands(G.standardize(features, reference="first"), "first")
            .withColumn("kmeans_fixed", F.col("customer_id") % 3).withColumn("kmeans_refit", F.col("orders") % 2)).cache()
    methods = ["kmeans_fixed", "kmeans_refit", "volume_fixed", "volume_refit"]
    labels = G.assignment_long(wide, methods).cache()
    metrics = G.long_drift(labels.join(wide.select("period", "customer_id", *z, F.col("volume_refit").alias("rule")),
                                       ["period", "customer_id"]), z, "first").cache()
    first = wide.where("period = 'first'")
    seeds = first.select("customer_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed"), "kmeans_fixed").select(
        "seed", "customer_id", F.when((F.col("seed") == 1) & (F.col("customer_id") < 3), 0).otherwise(F.col("kmeans_fixed")).alias("cluster"))
    least = G.adjusted_rand(seeds.join(first.select("customer_id", "kmeans_fixed"), "customer_id"), "kmeans_fixed", "cluster", ["seed"])
    one = {(r.period, r.method): r for r in metrics.collect()}
    values = {"single_initialization_minimum_ari": least.agg(F.min("ari")).first()[0],
              "first_customer_silhouette": one["first", "kmeans_fixed"].silhouette,
              "customer_fixed_model_time_ari": one["later", "kmeans_fixed"].ari_to_first_period}

    def tables(labels=labels, metrics=metrics, seeds=seeds, values=values):
        summary = spark.createDataFrame(list(values.items()), "name string, value double")
        return {(r.table, r.field, r.status) for r in V.recompute_drift(features, labels, metrics, seeds, summary, "first").collect()}

    assert tables() == set()
    wrong = F.when((F.col("period") == "later") & (F.col("method") == "kmeans_fixed"), 0.99).otherwise(F.col("ari_to_first_period"))
    lost = seeds.where("NOT (seed = 1 AND customer_id = 11)")
    found = tables(metrics=metrics.withColumn("ari_to_first_period", wrong), seeds=lost,
                   values={**values, "customer_fixed_model_time_ari": 0.99})
    assert {("metrics", "ari_to_first_period", "differs"), ("seeds", None, "missing"), ("summary", "value", "differs")} <= found
    relabelled = labels.withColumn("cluster", F.when((F.col("method") == "volume_fixed") & (F.col("customer_id") == 5), 9)
                                   .otherwise(F.col("cluster"))).where("NOT (method = 'kmeans_refit' AND customer_id = 0)")
    found = tables(labels=relabelled)
    assert {("assignments", "cluster", "differs"), ("assignments", None, "missing"), ("metrics", "k", "differs")} <= found
