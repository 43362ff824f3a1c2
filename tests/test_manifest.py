"""Manifest scoping against a plain reading of each session."""

import json

from flowsentry.operators import manifest
from flowsentry.sources.flows import read_manifest

DAY = 1_780_000_000_000_000 // 86_400_000_000 * 86_400_000_000  # a midnight


def text(us):
    import datetime

    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)).isoformat()


def made(spark, tmp_path):
    date = text(DAY)[:10]
    rows = [(date, i, f"10.0.0.{i % 3}", DAY + i * 30_000_000) for i in range(200)]
    bounds = lambda a, b, added=None: {"risk": {"start_row": a, "stop_row": b, "rows_added": b - a if added is None and a is not None and b is not None else added}}
    normal = lambda a, b, **k: {"label": "Normal", "date": date, "source_ips": ["10.0.0.0", "10.0.0.1"], "row_boundaries": bounds(a, b), **k}
    attack = lambda **k: {"label": "attack", "date": date, "expected_classes": ["PORT_SCAN"], "source_ips": [], **k}
    sessions = [
        normal(0, 40), normal(30, 60, source_ips=["10.0.0.1"]), normal(5, 5), normal(9, 3), normal(190, 201), normal(0, 9, source_ips=[]), normal(0, 9, date=""),
        normal(0, 9, date="2031-01-01"), normal(0, 9, row_boundaries=bounds(0, 9, 0)), normal(0, 9, source_ips=["1.1.1.1"]), normal(None, 9, row_boundaries=bounds(None, 9, 3)),
        attack(row_boundaries=bounds(100, 110)), attack(time_start=text(DAY + 3_600_000_000) + "+03:00", time_end=text(DAY + 4_200_000_000)), attack(time_start=text(DAY + 5_900_000_000), source_ips=["10.0.0.2"]),
        attack(expected_classes=[]), attack(row_boundaries=bounds(5, 2)), attack(row_boundaries=bounds(5, 9, 0)), {"label": "other", "date": date},
    ]
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"sessions": [{"session_id": str(i), "scenario": f"s{i}", **s} for i, s in enumerate(sessions)]}))
    frame = spark.createDataFrame(rows, "date string, row long, src_ip string, ts_us long")
    return frame, manifest.checked(manifest.sessions(read_manifest(spark, str(path), manifest.SESSION)), manifest.days(frame))


def test_sessions_scope_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "ROWS", 16)
    frame, found = made(spark, tmp_path)
    normal, attack = manifest.session_rows(frame, found, "normal"), manifest.session_rows(frame, found, "attack")
    assert {(r["row"], r["session_index"]) for r in normal.collect()} == {(i, 0) for i in range(40) if i % 3 < 2} | {(i, 1) for i in range(40, 60) if i % 3 == 1}
    assert {(r["row"], r["session_index"]) for r in attack.collect()} == {(i, 11) for i in range(100, 110)} | {(i, 12) for i in range(120, 141)} | {(i, 13) for i in range(197, 200) if i % 3 == 2}
    reasons = {r["session_index"]: r["excluded"] for r in manifest.outcomes(found, normal).collect()}
    assert reasons == {
        0: None, 1: None, 2: "no rows added", 3: "no rows added", 4: "row bounds beyond the table", 5: "no sources", 6: "no date", 7: "no table of its day", 8: "no rows added", 9: "no rows matched",
        10: "missing row bounds", 11: None, 12: None, 13: None, 14: "no expected classes", 15: "no rows added", 16: "no rows added", 17: "unknown label",
    }


def test_empty_manifest(spark, tmp_path):
    frame, _ = made(spark, tmp_path)
    path = tmp_path / "none.json"
    path.write_text('{"sessions": []}')
    found = manifest.checked(manifest.sessions(read_manifest(spark, str(path), manifest.SESSION)), manifest.days(frame))
    rows = manifest.session_rows(frame, found, "normal")
    assert rows.collect() == [] and manifest.outcomes(found, rows).filter("session_index IS NOT NULL").collect() == []


def test_detection_counts_and_timing(spark, tmp_path):
    frame, found = made(spark, tmp_path)
    start = DAY + 3_600_000_000  # of session 12
    kept = [
        ("p", 11, "PORT_SCAN", DAY, 1), ("p", 12, "DNS_ANOMALY", start - 29_500_000, 0), ("p", 12, "PORT_SCAN", start + 5, 0),
        ("q", 12, "PORT_SCAN", start + 61_900_000, 1), ("q", 13, "OTHER", DAY, 0),
    ]
    rows = spark.createDataFrame(kept, "policy string, session_index int, attack_type string, ts_us long, strong int")
    policies = spark.createDataFrame([("p",), ("q",), ("none",)], "policy string")
    out = manifest.detection(rows, found, policies, "strong = 1", ("PORT_SCAN",)).collect()
    got = {(r["policy"], r["session_index"]): r for r in out}
    assert set(got) == {(p, s) for p in ("p", "q", "none") for s in (11, 12, 13)} and len(out) == 9
    pick = lambda p, s: tuple(got[p, s][c] for c in ("found", "missed", "recall", "detected", "alerts_found", "alerts_missed", "alert_recall", "delay_raw_s", "delay_s", "timing"))
    assert pick("p", 11) == (1, "", 100.0, "PORT_SCAN", 1, "", 100.0, None, None, "unavailable")  # without a start
    assert pick("p", 12) == (1, "", 100.0, "DNS_ANOMALY,PORT_SCAN", 0, "PORT_SCAN", 0.0, -29, 0, "overlapping window")
    assert pick("q", 12) == (1, "", 100.0, "PORT_SCAN", 1, "", 100.0, 61, 61, "")
    assert pick("q", 13) == (0, "PORT_SCAN", 0.0, "OTHER", 0, "PORT_SCAN", 0.0, -5900, None, "before the session")
    assert pick("none", 12) == (0, "PORT_SCAN", 0.0, "", 0, "PORT_SCAN", 0.0, None, None, "unavailable")


def test_leading_names(spark):
    from flowsentry.operators import reports

    rows = [("a", f"s{i % 7}") for i in range(40)] + [("a", None)] * 9 + [("b", "x"), (None, "y"), (None, "y"), (None, "z")]
    frame = spark.createDataFrame(rows, "key string, name string")
    got = {r["key"]: r["top"] for r in reports.leading(frame, ["key"], "name", 3, "top").collect()}
    assert got == {"a": "s0:6,s1:6,s2:6", "b": "x:1", None: "y:2,z:1"}
