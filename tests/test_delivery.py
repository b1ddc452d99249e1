import datetime as dt
import random
from statistics import median

import pytest

from cargolens.operators import contracts as K, delivery as T, verify as V
from cargolens.sources.tables import ContractError

KINDS = "order_id int, accept_time timestamp_ntz, delivery_time timestamp_ntz"


def at(text):
    return dt.datetime.fromisoformat(text)


def records(spark, rows):
    return T.duration_minutes(spark.createDataFrame(rows, KINDS))


def test_only_delivered_records_are_mature(spark):
    noon = at("2023-05-10 12:00")
    hours = [(-30, -2), (-30, -1), (-13, -12), (-13, -11), (-40, None), (-12, -11), (3, 5)]  # midnight is at -12
    rows = [(i, noon + dt.timedelta(hours=a), b and noon + dt.timedelta(hours=b)) for i, (a, b) in enumerate(hours)]
    known = T.mature_history(records(spark, rows), ["2023-05-10"])
    assert known.count() == 0
    assert sorted(r.order_id for r in T.mature_history(records(spark, rows), ["2023-05-11"]).collect()) == [0, 1, 2, 3, 5, 6]
    early = records(spark, [(9, noon - dt.timedelta(days=2), at("2023-05-09 23:59:59")), (8, noon - dt.timedelta(days=2),
                                                                                         at("2023-05-10 00:00:00"))])
    assert [r.order_id for r in T.mature_history(early, ["2023-05-10"]).collect()] == [9]


def test_hours_with_too_few_records_use_the_global_median(spark):
    rng, rows = random.Random(6), []
    counts = {3: 12, 4: 11, 17: 40}
    for hour, n in counts.items():
        for i in range(n):
            t = at("2023-04-01 00:00") + dt.timedelta(days=i % 9, hours=hour, seconds=i)
            rows.append((len(rows), t, t + dt.timedelta(minutes=rng.randrange(5, 500))))
    minutes = {h: [(b - a).total_seconds() / 60 for _, a, b in rows if a.hour == h] for h in counts}
    whole = median([m for v in minutes.values() for m in v])
    got = {r.accept_hour: r for r in T.duration_hour_median(records(spark, rows), ["2023-06-01"], 12).collect()}
    assert len(got) == 24 and got[4].hour_records == 11
    assert {h: r.hour_median for h, r in got.items()} == {h: median(minutes[h]) if counts.get(h, 0) >= 12 else whole
                                                          for h in range(24)}


def test_pending_labels_stop_the_score(spark):
    """Nine quick deliveries a day and one that takes five days: complete, still open, never delivered."""
    rows = [(10 * d + i, at("2023-03-01 09:00") + dt.timedelta(days=d, minutes=i), at("2023-03-01 09:30") + dt.timedelta(days=d, minutes=i))
            for d in range(30) for i in range(9)]
    slow = [(900, at("2023-03-11 20:00"), at("2023-03-16 20:00")), (901, at("2023-03-25 20:00"), None)]
    df = records(spark, rows + slow)
    starts = ["2023-03-10", "2023-03-17", "2023-03-24", "2023-06-01"]
    status = {str(r.window_start): (r.accepted_records, r.pending_records, r.status) for r in
              T.score_status(df, starts, 7, "2023-03-31").collect()}
    assert status == {"2023-03-10": (64, 0, "scored"), "2023-03-17": (63, 0, "scored"), "2023-03-24": (64, 1, "labels pending"),
                      "2023-06-01": (0, 0, "no test records")}
    metrics = T.duration_metrics(T.duration_predictions(df, starts, 7, "2023-03-31")).collect()
    assert {(str(r.window_start), r.method): r.test_records for r in metrics} == {
        (w, m): n for w, n in (("2023-03-10", 64), ("2023-03-17", 63)) for m in T.DURATION_METHODS}
    first = next(r for r in metrics if str(r.window_start) == "2023-03-10" and r.method == "global_median")
    assert first.records_over_360_minutes == 1 and first.mae_over_360_minutes == 5 * 24 * 60 - 30
    # Observed until the slow record was still on its way, the first window is refused as well.
    assert T.duration_predictions(df, starts[:1], 7, "2023-03-15").count() == 0
    known = {str(r.window_start): r.all_test_labels_known_after for r in T.label_maturity(df, starts, 7, "2023-03-31").collect()}
    assert known["2023-03-24"] is None and known["2023-03-10"] == at("2023-03-16 20:00")
    with pytest.raises(ContractError):
        T.require_mature(T.label_maturity(df, starts, 7, "2023-03-31"))


def test_both_methods_score_the_same_records(spark):
    rows = [(i, at("2023-03-01 09:00") + dt.timedelta(hours=7 * i), at("2023-03-01 10:00") + dt.timedelta(hours=7 * i)) for i in range(80)]
    scored = T.duration_predictions(records(spark, rows), ["2023-03-12"], 7)
    assert sorted(r.sample_index for r in scored.where("method = 'hour_median'").collect()) == list(range(24))
    assert V.paired_methods_check(scored).count() == 0
    lost = scored.where("not (method = 'hour_median' and sample_index = 5)")
    assert [r.only_in for r in V.paired_methods_check(lost).collect()] == ["global_median"]


def test_zero_error_has_no_relative_improvement(spark):
    df = spark.createDataFrame([("global_median", 5, 0.0), ("hour_median", 5, 0.0)],
                               "method string, test_records int, mae_minutes double")
    assert T.improvement_pct(df).first().improvement_pct is None


def test_times_are_read_strictly(spark):
    raw = spark.createDataFrame([(1, "228", "02-28 10:00:00", "03-01 09:00:00"), (2, "301", "02-29 10:00:00", "03-01 09:00:00")],
                                "order_id int, ds string, accept_time string, delivery_time string")
    ok = T.parse_delivery_times(raw.where("order_id = 1"), 2022).first()
    assert ok.ds == dt.date(2022, 2, 28) and ok.accept_time == at("2022-02-28 10:00:00")
    bad = T.unparsed_times(raw, 2022).collect()
    assert [(r.order_id, r.field) for r in bad] == [(2, "accept_time")]
    with pytest.raises(Exception):
        T.parse_delivery_times(raw, 2022).collect()


def test_negative_and_repeated_records_are_refused(spark):
    bad = records(spark, [(1, at("2022-01-02 00:00"), at("2022-01-01 23:00"))])
    with pytest.raises(ContractError):
        T.check_records(bad)
    twice = records(spark, [(1, at("2022-01-01 00:00"), at("2022-01-01 01:00"))] * 2)
    assert K.dup_keys(twice, ["order_id"]).count() == 1
    with pytest.raises(ContractError):
        T.check_records(twice)
