"""The check lists on made flows with each fault, and without rows."""

from pyspark.sql import functions as F

from flowsentry.operators import checks

SCHEMA = "event_id long, ts_us long, src_ip string, dst_ip string, dst_port int, proto string, conn_state string, orig_bytes long, resp_bytes long, duration double"
MINUTE = 60_000_000


def flow(i, at, **k):
    row = {"event_id": i, "ts_us": at, "src_ip": "192.168.1.2", "dst_ip": f"10.0.0.{i % 30}", "dst_port": i % 500, "proto": ("tcp", "udp", "icmp")[i % 3], "conn_state": "SF", "orig_bytes": i, "resp_bytes": 1, "duration": 0.5}
    return tuple((row | k).values())


def of(frame, check):
    return {r["check"]: (r["value"], r["outcome"]) for r in check(frame).collect()}


def test_integrity_checks(spark):
    good = [flow(i, i * MINUTE // 2) for i in range(200)]
    assert {o for _, o in of(spark.createDataFrame(good, SCHEMA), checks.integrity_checks).values()} == {"pass"}
    bad = [flow(i, i * MINUTE // 2, proto="tcp", dst_ip="10.0.0.1", orig_bytes=0, resp_bytes=None, conn_state=None) for i in range(60)]
    bad += [flow(60, 59 * MINUTE // 2, dst_ip="10.0.0.1", dst_port=59, proto="tcp", orig_bytes=0, resp_bytes=0), flow(61, 200 * MINUTE, proto="tcp", dst_ip="10.0.0.1"), flow(62, MINUTE, proto="tcp", dst_ip="10.0.0.2")]
    got = of(spark.createDataFrame(bad, SCHEMA).drop("duration"), checks.integrity_checks)
    assert got["required_columns"] == (1, "fail") and got["time_gaps"] == (170.5, "warn") and got["timestamp_order"] == (1, "warn") and got["duplicates"] == (1, "warn")
    assert [got[c][1] for c in ("minimum_records", "missing_values", "protocol_variety", "ip_variety", "zero_bytes", "sudden_drop")] == ["pass", "warn", "warn", "warn", "warn", "warn"]
    row = checks.integrity_summary(checks.integrity_checks(spark.createDataFrame(bad, SCHEMA))).first()
    assert (row["passed"], row["warned"], row["failed"], row["score"], row["status"]) == (2, 8, 0, 6, "warn")
    middle = spark.createDataFrame([flow(0, 0), flow(1, 90 * MINUTE)], SCHEMA)
    assert of(middle, checks.integrity_checks)["time_gaps"] == (90.0, "info")


def test_daily_grades(spark):
    rows = [flow(i, i * 20 * MINUTE, dst_ip=f"192.168.0.{i % 25}" if i % 2 else f"10.0.0.{i % 25}") for i in range(600)]
    got = of(spark.createDataFrame(rows, SCHEMA), checks.daily_grades)
    assert got == {"quantity": (600, "60"), "missing_values": (0, "100"), "repeated_features": (0, "100"), "protocols": (3, "100"), "destinations": (50, "100"), "longest_gap": (20, "60"), "hours": (24, "100"), "external": (50, "100")}


def test_column_quality(spark):
    frame = spark.createDataFrame([(1.0, None, 1), (float("-inf"), "a", 2), (2.0, "b", 3), (2.0, "b", 3)], "x double, s string, `Flow Bytes/s` int")
    assert of(frame, checks.column_quality) == {"sparse_columns": (1, "0.5"), "leaky_columns": (1, "0"), "repeated_rows": (25, "0.5"), "infinite_columns": (1, "0.5")}
    assert {o for _, o in of(frame.select(F.lit(1).alias("a"), F.monotonically_increasing_id().alias("b")), checks.column_quality).values()} == {"1"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = of(none, checks.integrity_checks)
    assert [got[c] for c in ("minimum_records", "duplicates", "time_gaps", "sudden_drop")] == [(0, "warn"), (0, "pass"), (None, "pass"), (0, "pass")]
    assert of(none, checks.daily_grades)["longest_gap"] == (None, "50") and of(none, checks.column_quality)["repeated_rows"] == (0, "1")
