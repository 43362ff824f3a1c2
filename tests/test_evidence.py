"""Evidence, statistics and the labelled-flow classifier: queries against DuckDB, rules against known cases."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import audit, classifier, evidence, features, quality, risk
from flowsentry.plans.queries import ORACLE, QUERIES
from flowsentry.sources.flows import read_baselines, read_daily, write_baselines
from tests import test_flows
from tests.test_flows import FOLDER, window

NAMES = ["evidence_rows_added", "parse_event_times", "classify_range_totals", "evidence_export", "live_totals", "evidence_slice", "flows_without_network_noise", "training_statistics", "baseline_score_limits", "baseline_json", "model_prepared", "model_split", "model_oversampled", "model_window_features", "risk_new_windows", "risk_alerts", "quality_time_gaps", "quality_longest_gaps", "calib_sessions", "accuracy_reasons"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{FOLDER}/events.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_evidence_query_equals_sql(spark, duck, name):
    assert name in QUERIES and name in ORACLE
    test_flows.test_query_equals_sql(spark, duck, name)


@pytest.mark.parametrize(("reasons", "signals", "heuristic", "several"), [(["flag_dns_flood", "dns rate"], ["dns"], 1, 0), (["risk with connections"], ["risk"], 1, 0), (["connections with risk", "risk"], ["connections", "risk"], 1, 0), (["flag_brute_force", "failed rate", "risk"], ["failed_connections", "flag", "risk"], 1, 1), (["anomaly", "trusted source"], ["anomaly", "other"], 0, 1), ([], [], 0, 0)])
def test_signal_families(spark, reasons, signals, heuristic, several):
    row = audit.signal_families(spark.createDataFrame([(reasons, 0.0)], "reasons array<string>, anomaly_score double")).first()
    assert (row["signals"], row["heuristic_only"], row["several_signals"]) == (signals, heuristic, several)


def test_trusted_sources_are_a_reason(spark):
    row = window(spark, risk_score=35.0)
    plain, marked = (risk.classified(row, trusted=t).first() for t in ((), ("192.168.50.60",)))
    assert plain["reasons"] == ["risk"] and marked["reasons"] == ["risk", "trusted source"] and marked["confidence"] < plain["confidence"]


def test_event_times(spark):
    rows = spark.createDataFrame([(" ", "2026-06-14 03:22:11", None), ("2026-06-14T03:22:11+03:00", "x", None), (None, None, 60), ("soon", None, 60), (None, " ", None)], "a string, b string, ts long")
    got = [r[0] for r in rows.select(evidence.event_time(("a", "b"), "ts")).collect()]
    at = datetime.datetime(2026, 6, 14, 3, 22, 11)
    assert got == [at, at, datetime.datetime(1970, 1, 1, 0, 1), None, None]


def test_daily_files_and_baselines(spark, tmp_path):
    rows = spark.range(6).select("id", F.concat(F.lit("2026-06-1"), (F.col("id") % 3).cast("string")).alias("date"))
    rows.write.partitionBy("date").parquet(f"{tmp_path}/days")
    count = lambda **k: {(r["source_date"], r["n"]) for r in read_daily(spark, f"{tmp_path}/days", **k).groupBy("source_date").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count() == {(f"2026-06-1{i}", 2) for i in range(3)} and count(last=1) == {("2026-06-12", 2)} and count(days=["2026-06-10", "2026-07-01"]) == {("2026-06-10", 2)}
    write_baselines(spark.createDataFrame([("a", 5), ("b", None)], "src_ip string, n long"), f"{tmp_path}/wrapped")
    spark.createDataFrame([('{"c": {"n": 7}}',)], "value string").write.text(f"{tmp_path}/plain")
    read = lambda name: {tuple(r) for r in read_baselines(spark, f"{tmp_path}/{name}", "n long").collect()}
    assert read("wrapped") == {("a", 5), ("b", None)} and read("plain") == {("c", 7)}


def test_noise_of_networks_and_gaps(spark):
    rows = spark.createDataFrame([(" 10.0.0.255 ", 80), ("10.0.0.1", 80), (None, 80)], "dst_ip string, dst_port int")
    assert [r["dst_ip"] for r in features.without_noise_of(rows, ["10.0.0.0/24", "fe80::/10"]).collect()] == ["10.0.0.1", None]
    times = [0, 1, 200, 201, 7500, 7501]
    gaps = quality.time_gaps(spark.createDataFrame([(t * 60_000_000,) for t in times], "ts_us long"), 60)
    assert [tuple(r)[1:] for r in quality.longest_gaps(gaps).collect()] == [(7299 * 60_000_000, 2, 7299 * 60_000_000, "warn"), (199 * 60_000_000, 2, 7299 * 60_000_000, "warn")]


def test_evaluation_and_snapshots(spark):
    rows = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")], "label string, predicted string")
    got = {r["label"]: r for r in classifier.evaluation(rows).collect()}
    assert got["a"]["precision"] == 0.75 and got["a"]["recall"] == 0.75 and got["b"]["recall"] == 1.0 and got["c"]["f1"] == 0.0
    assert abs(got["b"]["f1"] - 0.8) < 1e-12 and all(abs(r["accuracy"] - 5 / 7) < 1e-12 for r in got.values())
    shots = [spark.createDataFrame([("x", n)], "dataset string, rows long") for n in (9, 4)]
    assert evidence.rows_added(*shots).first()["added"] == 0 and evidence.rows_added(*shots[::-1]).first()["added"] == 5


def test_nearest_neighbours():
    points = np.random.default_rng(7).normal(size=(40, 3)) * [1, 10, 100]
    unit = points / points.std(axis=0)
    for i, near in enumerate(classifier.nearest(points, 5)):
        order = np.argsort(((unit - unit[i]) ** 2).sum(axis=1))
        assert set(near.tolist()) == set(order[1:6].tolist())
    assert classifier.nearest(points[:1], 5).shape == (1, 0) and classifier.nearest(points[:3], 5).shape == (3, 2)


def test_small_classes_spread_over_tasks(spark):
    """Classes of six and of one row against 20,000: as many rows each, between rows of the class, from seeds of 1,000 copies at most."""
    rng = np.random.default_rng(3)
    rows = [("big", i, *rng.normal(size=len(classifier.NAMES)).tolist()) for i in range(20_000)]
    rows += [("six", 10**6 + i, *(rng.normal(size=len(classifier.NAMES)) + 50).tolist()) for i in range(6)] + [("one", 10**7, *[9.0] * len(classifier.NAMES))]
    train = spark.createDataFrame(rows, ["label", "id", *classifier.NAMES])
    made = classifier.oversampled(train, "id")
    first, last = classifier.NAMES[0], classifier.NAMES[-1]
    got = {r["label"]: r for r in made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("low"), F.max(first).alias("high"), F.count_distinct(last).alias("different")).collect()}
    six = [r[2] for r in rows if r[0] == "six"]
    assert {r["n"] for r in got.values()} == {20_000} and got["one"]["low"] == got["one"]["high"] == 9
    assert min(six) <= got["six"]["low"] and got["six"]["high"] <= max(six) and got["six"]["different"] > 19_000 and got["big"]["different"] == 20_000
    parts = classifier.seeds(train, "id")
    assert parts.agg(F.max("copies")).first()[0] == 1000 and parts.groupBy("label").count().filter("count >= 20").count() == 2
    again = classifier.oversampled(train.repartition(7), "id")
    total = lambda df: df.filter("label = 'six'").select(F.round(F.sum(first), 6)).first()[0]
    assert total(made) == total(again)


def test_classifier_learns_and_prepares(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "abc"[i % 3] if i % 10 else "a", *(float(x) + (i % 3 if i % 10 else 0) for x in rng.random(10))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"{n} double" for n in classifier.NAMES))
    parts = classifier.split(frame, "id").cache()
    assert parts.filter("part = 'test'").count() == sum(int(n * 20 // 100) for n in (r["n"] for r in frame.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()))
    more = classifier.oversampled(parts.filter("part = 'train'"), "id")
    assert len({r["n"] for r in more.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}) == 1
    model = classifier.trained(more, trees=5, depth=4)
    assert all(r["f1"] > 0.9 for r in classifier.evaluation(classifier.predicted(parts.filter("part = 'test'"), model)).collect())
    assert classifier.predicted(frame, model, 0.7).filter("confidence <= 0.7").isEmpty() and abs(sum(v for _, v in classifier.importance(model)) - 1) < 1e-6
    raw = spark.createDataFrame([(" Web Attack � XSS ", 1.0, float("inf")), ("BENIGN", 1.0, 1.0), ("Bot", 2.0, 3.0), ("Bot", 2.0, float("nan"))], "` Label` string, ` Destination Port` double, `Flow Duration ` double")
    for c in list(classifier.FEATURES)[2:]:
        raw = raw.withColumn(f" {c}", F.lit(0))
    assert [tuple(r)[:3] for r in classifier.prepared(raw.withColumn("Flow Bytes/s", F.lit(1))).collect()] == [("Bot", 2.0, 3.0)]
