import hashlib
import json

import pytest

from cargolens.operators import contracts as K, verify as V
from cargolens.sources import tables as S


def test_csv_contract_keeps_ids_and_refuses_missing_columns(spark, tmp_path):
    path = tmp_path / "volume.csv"
    path.write_text("﻿customer_id,business_volume\n001,2.5\n1,3\n", encoding="utf-8")
    df = S.read_table(spark, str(path), S.SCHEMAS["business_volume"])
    assert sorted(r.customer_id for r in df.collect()) == ["001", "1"]
    with pytest.raises(S.ContractError):
        S.read_table(spark, str(path), S.SCHEMAS["cities"])
    path.write_text("customer_id,business_volume\n1,many\n", encoding="utf-8")
    with pytest.raises(Exception):
        S.read_table(spark, str(path), S.SCHEMAS["business_volume"]).collect()


def test_json_catalogue(spark, tmp_path):
    entry = {f: f"{f} text" for f in ("id", "title", "url")}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"resources": [entry, {**entry, "id": "b", "title": "Straße"}]}, indent=1), encoding="utf-8")
    df = S.read_table(spark, str(path), "id STRING, title STRING, url STRING", fmt="json")
    assert df.columns == ["id", "title", "url"] and df.count() == 2
    assert [r.id for r in K.catalog_search(df, keyword="TITLE", searched=("title",)).collect()] == ["id text"]


def test_csv_sink_has_six_decimals(spark, tmp_path):
    S.write_table(spark.createDataFrame([("a", 1 / 3), ("b", None)], "k string, v double").coalesce(1), str(tmp_path / "o"), "csv")
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text == "k,v\na,0.333333\nb,\n" or text == 'k,v\na,0.333333\nb,""\n'


def test_digest_and_manifest(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    actual = S.file_digest(spark, str(tmp_path), "*.txt")
    digest = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.txt", "b.txt")}
    assert {r.file: r.sha256 for r in actual.collect()} == digest
    recorded = spark.createDataFrame([("a.txt", "0" * 64, "input"), ("c.txt", "1" * 64, "input")],
                                     "file string, sha256 string, digest_group string")
    got = {(r.file, r.status) for r in S.manifest_diff(recorded, actual, ["input", "result"]).collect()}
    assert got == {("a.txt", "changed"), ("b.txt", "not_recorded"), ("c.txt", "missing_file"), (None, "empty_group")}


def test_catalog_rules(spark):
    fields = ["id", "url", "priority", "checked_at"]
    rows = [("a", "https://x.org/1", "P0", "2024-02-29"), ("b", "ftp://x.org", "P1", "2024-02-01"),
            ("c", "https://no.invalid/", "P2", "2024-02-01"), ("d", "https:///p", "P3", "2024-02-30"),
            ("e", " ", "P0", "2024-02-01"), ("f", "https://x.org/1", "P0", "24-02-01")]
    got = {(r.id, r.rule) for r in K.catalog_quality(spark.createDataFrame(rows, fields), fields).collect()}
    assert got == {("b", "url_scheme_or_host"), ("c", "url_reserved_host"), ("d", "url_scheme_or_host"), ("d", "priority"),
                   ("d", "date"), ("e", "blank"), ("f", "date"), ("a", "duplicate"), ("f", "duplicate")}


def test_copied_answer_and_late_feature(spark):
    df = spark.createDataFrame([(10.0, 10.0, 1.0), (20.0, 20.0, 1.0), (30.0, 30.0, 1.0)], "y double, leak double, x double")
    got = {r.candidate: (r.mae, r.copies_answer) for r in K.answer_as_feature(df, "y", ["leak", "x"]).collect()}
    assert got["leak"] == (0.0, True) and got["constant_mean"] == (20 / 3, False)
    late = spark.createDataFrame([("2025-01-03", "2025-01-02"), ("2025-01-02", "2025-01-02")], "a string, p string")
    assert K.late_features(late, "a", "p").count() == 1 and K.point_in_time(late, "a", "p").count() == 1


def test_finite_sign_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (0.0,), (-2.0,)], "v double")
    assert K.finite_check(df, ["v"]).count() == 2
    assert K.sign_check(df.where("v < 9"), "v").count() == 1 and K.sign_check(df.where("v < 9"), "v", True).count() == 2
    with pytest.raises(S.ContractError):
        K.require_rows(df.where("v = 77"), "empty")


def test_diff_tolerance_and_key_problems(spark):
    kinds = "k string, v double, t string"
    stored = spark.createDataFrame([("a", 1.0, "x"), ("b", 5.0, "x"), ("c", 1.0, "x"), ("c", 1.0, "x"), ("z", 1.0, "x")], kinds)
    fresh = spark.createDataFrame([("a", 1.0 + 1e-6, "x"), ("b", 5.1, "y"), ("c", 1.0, "x"), ("m", 2.0, "x")], kinds)
    got = {(r.key, r.field, r.status) for r in V.tolerant_diff(stored, fresh, ["k"], ["v"], ["t"]).collect()}
    assert got == {("b", "v", "differs"), ("b", "t", "differs"), ("c", None, "repeated"), ("z", None, "extra"),
                   ("m", None, "missing")}


def test_claims_and_links(spark):
    claims = spark.createDataFrame([("ok", 1.25, "1.2"), ("bad", 1.26, "1.2"), ("word", 1.0, "one"), ("gone", 2.0, "2")],
                                   "id string, value double, display_value string")
    shown = spark.createDataFrame([("ok", "1.2"), ("bad", "1.3"), ("word", "one"), ("new", "4")], "id string, shown string")
    results = spark.createDataFrame([("ok", 1.25), ("bad", 1.26), ("word", 1.0), ("gone", 3.0)], "id string, result_value double")
    got = {(r.id, r.status) for r in V.claim_trace(claims, shown, results).collect()}
    assert got == {("bad", "display_differs"), ("bad", "shown_differs"), ("word", "not_decimal"),
                   ("gone", "not_published"), ("gone", "result_differs"), ("new", "unregistered")}
    pages = spark.createDataFrame([(1, "http://h.org/a?x=1", '<a href="/b"><a href="#t"><a href="mailto:q"><a href="/c#z">'),
                                   (2, "http://h.org/b", "")], "page_id int, url string, html string")
    assert [(r.page_id, r.target) for r in V.broken_links(pages).collect()] == [(1, "http://h.org/c")]
