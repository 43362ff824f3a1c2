"""Network-traffic queries against DuckDB on the same tables, and rules against known cases."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsentry.functions.expressions import CLASSES
from flowsentry.operators import anomaly, calibrate, features, pauses, quality, risk, state, stored_model
from flowsentry.plans import queries
from flowsentry.plans.queries import ORACLE, QUERIES
from flowsentry.sources.flows import flows, parse_auth_log, parse_conn_log, parse_firewall_log, read_alerts, write_alerts
from flowsentry.streaming import keyed, runs

FOLDER = "/root/testdata/sf0.01"
CHECKED = ["windows_features", "windows_network_wide", "baseline_profile", "risk_score", "risk_explain", "classify_events", "classify_trusted", "state_combined", "perimeter_cooldown", "auth_levels", "quality_sudden_drops", "accuracy_sequences", "accuracy_signals", "calib_metrics", "calib_attack_validation", "route_fingerprints", "parse_connections", "stream_window_counts"]

#: No 10-minute bucket of this folder falls below half the mean; test_sudden_drops has buckets that do.
EMPTY_HERE = {"quality_sudden_drops"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{FOLDER}/events.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    text = lambda v: "" if pd.isna(v) else repr(float(v)) if not isinstance(v, str) else v
    rows = lambda df: sorted(tuple(map(text, r)) for r in df[columns].itertuples(index=False))
    assert rows(ours) == rows(theirs) and (len(ours) or name in EMPTY_HERE)


def window(spark, **values):
    row = {"src_ip": "192.168.50.60", "k": 0, "ts_us": 0, "connections_30s": 1, "unique_dst_ports_30s": 1, "unique_dst_ports_1m": 1, "unique_dst_ips_30s": 1, "failed_conn_rate_30s": 0.0, "dns_rate_30s": 0.0, "burst_score_30s": 0.0, "bytes_per_sec_30s": 0.0, "flag_port_scan": 0, "flag_brute_force": 0, "flag_burst": 0, "flag_dns_flood": 0, "anomaly_score": 0.0, "risk_score": 25.0} | values
    return spark.createDataFrame([row])


@pytest.mark.parametrize(("values", "expected"), [({"unique_dst_ips_30s": 54, "unique_dst_ports_30s": 3}, "LOW_SIGNAL_REVIEW"), ({"flag_port_scan": 1, "unique_dst_ports_30s": 20}, "PORT_SCAN"), ({"flag_port_scan": 1, "unique_dst_ports_1m": 20}, "PORT_SCAN"), ({"flag_port_scan": 1, "unique_dst_ports_30s": 19}, "LOW_SIGNAL_REVIEW"), ({"dns_rate_30s": 2.0}, "DNS_ANOMALY"), ({"failed_conn_rate_30s": 0.9, "connections_30s": 12}, "FAILED_CONNECTION_PATTERN"), ({"risk_score": 35.0}, "UNKNOWN_SUSPICIOUS"), ({"flag_burst": 1}, "DOS_LIKE_BURST")])
def test_classes(spark, values, expected):
    row = risk.classified(window(spark, **values)).first()
    assert row["attack_type"] == expected in CLASSES and row["reasons"]


def test_sequences_split_at_long_gaps_and_cooldown_is_greedy(spark):
    rows = spark.createDataFrame([("a", "X", i, t * 1_000_000) for i, t in enumerate((0, 30, 300))], "src_ip string, attack_type string, k long, ts_us long")
    assert [r["persistence"] for r in calibrate.sequences(rows).orderBy("k").collect()] == [2, 2, 1]
    times = spark.createDataFrame([("a", t * 1_000_000) for t in (0, 30, 660)], "src_ip string, ts_us long")
    assert pauses.cooldown(times, ["src_ip"], 600_000_000).count() == 2


def test_routing_fails_closed(spark):
    rows = window(spark, flag_port_scan=1, unique_dst_ports_30s=101).withColumns({"attack_type": F.lit("PORT_SCAN"), "confidence": F.lit(0.7)})
    assert calibrate.routed(rows).first()["decision"] == "actionable"
    gone = rows.withColumn("unique_dst_ports_30s", F.lit(None).cast("long")).withColumn("unique_dst_ports_1m", F.lit(-1))
    assert calibrate.routed(gone).first()["decision"] == "evidence missing"


def test_parsers_skip_what_is_malformed(spark):
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    good = "\t".join(["1.5", "C1", "192.168.1.2", "1", "8.8.8.8", "53", "udp", "-", "bad"] + ["-"] * 13)
    row = parse_conn_log(text("#fields", good, "too\tfew")).collect()
    assert len(row) == 1 and row[0]["ts"] == 1.5 and row[0]["duration"] is None and row[0]["service"] is None
    auth = parse_auth_log(text("x sshd[1]: Failed password for root from 203.0.113.9 port 1 ssh2", "x sshd[1]: Failed password for root from 192.168.1.9 port 1 ssh2", "x sshd[1]: Accepted password for bob from 192.168.1.9 port 1 ssh2", "noise")).collect()
    assert [(r["outcome"], r["ip"]) for r in auth] == [("fail", "203.0.113.9"), ("success", "192.168.1.9")]
    wall = parse_firewall_log(text("k FW_WAN IN=eth0 SRC=1.1.1.1 DST=2.2.2.2 PROTO=TCP DPT=22", "k FW_WAN SRC=1.1.1.1 DPT=22", "k FW_WAN SRC=1.1.1.1 DST=2.2.2.2 DPT=x")).collect()
    assert [(r["src"], r["dst_port"]) for r in wall] == [("1.1.1.1", 22)]


def test_alerts_round_trip(spark, tmp_path):
    write_alerts(spark.createDataFrame([("2024-05-01 10:00:00", "scan"), ("bad", None)], "time string, alert_type string"), str(tmp_path / "alerts"))
    got = read_alerts(spark.read.text(str(tmp_path / "alerts")).select("value").unionAll(spark.createDataFrame([("old line",)], "value string"))).collect()
    assert sorted((r["alert_type"] or "", r["severity"] or "") for r in got) == [("legacy-log", ""), ("scan", "INFO"), ("unknown", "INFO")]


def test_networks_and_repeats(spark):
    rows = spark.createDataFrame([("192.168.50.7",), ("192.168.51.7",), ("10.9.9.9",), ("nope",), (None,)], "ip string")
    assert [r[0] for r in rows.select(features.in_networks("ip", ["192.168.50.0/24", "10.0.0.0/8"])).collect()] == [True, False, True, False, False]


def test_forest_ranks_an_outlier_first(spark):
    import numpy as np

    x = np.vstack([np.random.default_rng(1).normal(size=(300, 3)), [[9, 9, 9]]])
    rng = np.random.default_rng(2)
    forest = [anomaly.grow(x[rng.choice(301, 256, replace=False)], rng) for _ in range(60)]
    assert anomaly.raw_scores(x, forest).argmax() == 300


def test_sources_have_their_own_anomaly_limits(spark, monkeypatch):
    raw = [("noisy", k, 0.8 + k % 100 / 1000) for k in range(1000)] + [("quiet", k, 0.65 if k == 7 else 0.1) for k in range(2000)] + [("few", 0, 0.9), ("few", 1, 0.0), ("few", 2, 1.0)]
    monkeypatch.setattr(queries, "stored_fit", lambda spark, d: stored_model.Model("made", None, [], spark.createDataFrame([(0.0, 1.0)], "low double, high double")))
    monkeypatch.setattr(queries, "scores_of", lambda spark, d, model: spark.createDataFrame(raw, "src_ip string, k long, raw double"))
    got = {(r["src_ip"], r["k"]): r for r in QUERIES["anomaly_normalise"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(raw)
    assert {x for x, r in got.items() if r["is_anomaly"]} == {("quiet", 7), ("few", 0), ("few", 2)}
    assert got["few", 0]["anomaly_score"] == pytest.approx((0.9 - 0.66) / 0.34) and got["noisy", 99]["anomaly_score"] == 0


def test_risk_takes_the_adjusted_scores(spark):
    folder = "/root/testdata/sf0.001"
    scores = lambda name: {(r["src_ip"], r["k"]): r["anomaly_score"] for r in QUERIES[name](spark, folder).collect()}
    assert scores("risk_with_anomaly") == scores("anomaly_normalise") != {}


def test_perimeter_stream_equals_batch(spark, tmp_path):
    rows = features.without_noise(flows(spark, FOLDER)).select("src_ip", "ts_us", "event_id", "dst_port")
    end = spark.createDataFrame([("end", 10**12, 0, 1)], rows.schema)  # takes the watermark past all flows
    rows.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {(r["src_ip"], r["ts_us"]) for r in runs.run_to_end(keyed.perimeter_alerts(stream)).collect()}
    assert got == {(r["src_ip"], r["ts_us"]) for r in pauses.cooldown(state.perimeter_scans(rows), ["src_ip"], 30_000_000).collect()} != set()


def test_readiness(spark):
    schema = "event_id long, ts_us long, src_ip string, dst_ip string, dst_port int, proto string, conn_state string, orig_bytes long, resp_bytes long, duration double"
    hour = 3_600_000_000
    row = lambda i, at, dst="10.0.0.1": (i, at, "192.168.1.2", dst, 80, "tcp", "SF", 1, 1, 0.5)
    several = spark.createDataFrame([row(1, 0), row(2, 0), row(3, 7 * hour), row(4, 30 * hour, None)], schema)
    seen = spark.range(5).toDF("n")
    judge = lambda frame, **least: quality.readiness(frame, seen, **least).first().asDict()
    got = judge(several, days=2, records=4, least_windows=5)
    assert [got[c] for c in ("days", "records", "windows", "gaps", "sparse_columns", "repeats")] == [2, 4, 5, 2, 1, 1]
    assert got["share"] == 0.75 and got["verdict"] == "ready" and got["more_days"] == 0  # (1 + 1 + 1 + .5 + .5 + .5) / 6
    assert judge(several, days=2, records=9, least_windows=5) | {"share": 0} == got | {"share": 0, "verdict": "not ready", "more_days": 3}
    empty = judge(several.limit(0))
    assert empty["verdict"] == "not ready" and empty["more_days"] is None and empty["records"] == 0


def test_sudden_drops(spark):
    counts = [10, 10, 0, 10, 3, 10, 4]  # mean 6.71: half of it is 3.36
    rows = [(bucket * 600_000_000 + k,) for bucket, n in enumerate(counts) for k in range(n)]
    drops = lambda rows: {tuple(r) for r in quality.sudden_drops(spark.createDataFrame(rows, "ts_us long"), 0.5).collect()}
    assert drops(rows) == {(2, 0), (4, 3)}
    assert drops(rows[:20]) == set() and drops([]) == set()
