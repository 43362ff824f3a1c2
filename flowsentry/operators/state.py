"""Correlation over time: victim and outbound profiles, perimeter scans, login levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.expressions import SENSITIVE_PORTS, is_noise, rounded
from flowsentry.operators.timelines import previous, running_sum, swept
from flowsentry.sources.tables import durable

AGO = {"30s": 30_000_000, "5m": 300_000_000, "1h": 3_600_000_000}
_FAILED = "conn_state IN ('S0', 'REJ')"


def recent(flows: DataFrame, hours: int = 24, as_of_us: int | None = None) -> DataFrame:
    """Flows without noise of the last hours before the last flow, with their age in microseconds; or before as_of_us, later flows left out."""
    clean = flows.filter(f"NOT {is_noise()}")
    if as_of_us is not None:
        aged = clean.filter(F.col("ts_us") <= as_of_us).withColumn("age", F.lit(as_of_us) - F.col("ts_us"))
    else:
        end = clean.agg(F.max("ts_us").alias("as_of"))
        aged = clean.crossJoin(F.broadcast(end)).withColumn("age", F.col("as_of") - F.col("ts_us")).drop("as_of")
    return aged.filter(F.col("age") <= hours * 3_600_000_000)


def victims(flows: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Profile of each local destination: distinct ports and failures over 30 s, 5 min, 1 h and all memory."""
    rows = recent(flows, as_of_us=as_of_us).filter("dst_ip LIKE '192.168.%'")
    by_port = rows.groupBy("dst_ip", "dst_port").agg(F.min("age").alias("age"), *[F.sum(F.expr(f"CASE WHEN {_FAILED} AND age <= {a} THEN 1 ELSE 0 END")).alias(f"f_{n}") for n, a in AGO.items()], F.sum(F.expr(f"CASE WHEN {_FAILED} THEN 1 ELSE 0 END")).alias("f_all"))
    return by_port.groupBy("dst_ip").agg(
        *[F.sum(F.expr(f"CASE WHEN age <= {a} THEN 1 ELSE 0 END")).alias(f"ports_{n}") for n, a in AGO.items()],
        *[F.sum(f"f_{n}").alias(f"fails_{n}") for n in AGO],
        *[F.sum(F.expr(f"CASE WHEN dst_port = 22 THEN f_{n} ELSE 0 END")).alias(f"ssh_fails_{n}") for n in ("5m", "1h")],
        F.count(F.lit(1)).alias("ports_all"),
        F.sum("f_all").alias("fails_all"),
        F.max(F.expr(f"CASE WHEN dst_port IN ({', '.join(map(str, SENSITIVE_PORTS))}) THEN 1 ELSE 0 END")).alias("sensitive"),
    )


VICTIM_SCORES = {
    "scan_severity": "least(greatest(CASE WHEN ports_30s >= 5 THEN least(ports_30s / 5e1, 1e0) ELSE 0e0 END, CASE WHEN ports_5m >= 10 THEN least(ports_5m / 1e2, 1e0) ELSE 0e0 END, CASE WHEN ports_1h >= 20 THEN least(ports_1h / 2e2, 1e0) ELSE 0e0 END) * CASE WHEN sensitive = 1 THEN 13e-1 ELSE 1e0 END, 1e0)",
    "fail_severity": "greatest(CASE WHEN fails_30s >= 10 THEN least(fails_30s / 5e1, 1e0) ELSE 0e0 END, CASE WHEN fails_5m >= 20 THEN least(fails_5m / 1e2, 1e0) ELSE 0e0 END, CASE WHEN fails_1h >= 40 THEN least(fails_1h / 2e2, 1e0) ELSE 0e0 END)",
    "ssh_severity": "greatest(CASE WHEN ssh_fails_5m >= 5 THEN least(ssh_fails_5m / 2e1, 1e0) ELSE 0e0 END, CASE WHEN ssh_fails_1h >= 15 THEN least(ssh_fails_1h / 5e1, 1e0) ELSE 0e0 END)",
}
VICTIM_RISK = rounded("least(5e-1 * scan_severity + 4e-1 * fail_severity + 45e-2 * ssh_severity, 1e0)", 4)


def outbound(flows: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Profile of each local source towards others: DNS flows of the last hour, successes, external and internal destinations."""
    rows = recent(flows, as_of_us=as_of_us).filter("src_ip LIKE '192.168.%' AND dst_ip <> src_ip")
    by_ip = rows.groupBy("src_ip", "dst_ip").agg(F.sum(F.expr(f"CASE WHEN dst_port = 53 AND age <= {AGO['1h']} THEN 1 ELSE 0 END")).alias("dns"), F.sum(F.expr("CASE WHEN dst_port <> 53 AND conn_state = 'SF' THEN 1 ELSE 0 END")).alias("good"))
    return by_ip.groupBy("src_ip").agg(F.sum("dns").alias("dns_1h"), F.sum("good").alias("successes"), F.sum(F.expr("CASE WHEN dst_ip LIKE '192.168.%' THEN 0 ELSE 1 END")).alias("external_ips"), F.sum(F.expr("CASE WHEN dst_ip LIKE '192.168.%' THEN 1 ELSE 0 END")).alias("internal_ips"))


OUTBOUND_SCORES = {
    "recon_severity": "CASE WHEN dns_1h >= 50 AND successes <= 10 THEN least(dns_1h / 2e2, 1e0) ELSE 0e0 END",
    "external_severity": "CASE WHEN external_ips >= 15 THEN least(external_ips / 5e1, 1e0) ELSE 0e0 END",
    "lateral_severity": "CASE WHEN internal_ips >= 4 THEN least(internal_ips / 1e1, 1e0) ELSE 0e0 END",
}
OUTBOUND_RISK = rounded("least(2e-1 * recon_severity + 25e-2 * external_severity + 35e-2 * lateral_severity, 1e0)", 4)


def _patterns(scores: dict[str, str]) -> str:
    return f"concat_ws(',', {', '.join(f"CASE WHEN {c} > 0 THEN '{c[:-9]}' END" for c in scores)})"


def victim_risk(profiles: DataFrame) -> DataFrame:
    return profiles.selectExpr("dst_ip AS host", *[f"{e} AS {c}" for c, e in VICTIM_SCORES.items()]).selectExpr("host", "'victim' AS role", f"{VICTIM_RISK} AS state_risk", f"{_patterns(VICTIM_SCORES)} AS patterns")


def outbound_risk(profiles: DataFrame) -> DataFrame:
    return profiles.selectExpr("src_ip AS host", *[f"{e} AS {c}" for c, e in OUTBOUND_SCORES.items()]).selectExpr("host", "'outbound' AS role", f"{OUTBOUND_RISK} AS state_risk", f"{_patterns(OUTBOUND_SCORES)} AS patterns")


def either_risk(profiles: DataFrame, *kept: str) -> DataFrame:
    """(kept, host, role, state_risk, patterns) of rows with the measures of both roles, of which that of role counts."""
    scored = profiles.selectExpr(*kept, "host", "role", *[f"{e} AS {c}" for c, e in (VICTIM_SCORES | OUTBOUND_SCORES).items()])
    return scored.selectExpr(*kept, "host", "role", f"CASE role WHEN 'victim' THEN {VICTIM_RISK} ELSE {OUTBOUND_RISK} END AS state_risk", f"CASE role WHEN 'victim' THEN {_patterns(VICTIM_SCORES)} ELSE {_patterns(OUTBOUND_SCORES)} END AS patterns")


def state_risk(flows: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Hosts with a state risk above 0, as victims or sources, with their patterns; as of the last flow or of as_of_us."""
    return victim_risk(victims(flows, as_of_us)).unionByName(outbound_risk(outbound(flows, as_of_us))).filter("state_risk > 0")


def perimeter_scans(rows: DataFrame, threshold: int = 5, window_us: int = 30_000_000) -> DataFrame:
    """(src_ip, ts_us, event_id, ports): rows at which a source has reached threshold distinct ports in the trailing window, both ends included; a null port is none.

    A port is present from a first sight until window_us after the last sight that no longer gap follows; the ports at a
    time are a running sum of such beginnings and ends in time buckets, so no set of ports is ever held."""
    width = max(64 * window_us, 1)
    seen = durable(rows.select("src_ip", "ts_us", "event_id", "dst_port"))
    sights = durable(seen.filter("dst_port IS NOT NULL").groupBy("src_ip", "dst_port", "ts_us").agg(F.count(F.lit(1)).alias("n")))
    paired = previous(sights, ["src_ip", "dst_port"], "ts_us", "ts_us", width, "before")
    starts = paired.filter(f"before IS NULL OR ts_us - before > {window_us}")
    ends = starts.filter("before IS NOT NULL").selectExpr("src_ip", f"before + {window_us + 1} AS ts_us", "-1L AS delta")
    last = sights.groupBy("src_ip", "dst_port").agg((F.max("ts_us") + window_us + 1).alias("ts_us")).selectExpr("src_ip", "ts_us", "-1L AS delta")
    deltas = starts.selectExpr("src_ip", "ts_us", "1L AS delta").unionByName(ends).unionByName(last)
    found = swept(seen.select("src_ip", "ts_us", "event_id"), deltas, ["src_ip"], width, "ports")
    return found.filter(F.col("ports") >= threshold).select("src_ip", "ts_us", "event_id", "ports")


def login_levels(logins: DataFrame, window_us: int = 60_000_000) -> DataFrame:
    """Level changes from rows (ip, ts_us, event_id, outcome): 3, 5, 10 failures in under a minute since the last success warn, alert, ban.

    Failures of one time count together, and the first of them changes the level. Successes number an address's segments;
    inside a segment a failure adds 1 when it comes and takes it back window_us later. Both are running sums over time
    buckets of one window, each of which hands the next a number, so an address is never one task."""
    segment = durable(running_sum(durable(logins.select("ip", "ts_us", "event_id", "outcome")).withColumn("good", F.when(F.col("outcome") == "success", 1).otherwise(0)), ["ip"], "ts_us", "good", window_us, "segment", ("event_id",)))
    fails = durable(segment.filter("outcome = 'fail'").groupBy("ip", "segment", "ts_us").agg(F.count(F.lit(1)).alias("c"), F.min("event_id").alias("event_id")))
    deltas = fails.selectExpr("ip", "segment", "ts_us", "c AS delta").unionByName(fails.selectExpr("ip", "segment", f"ts_us + {window_us} AS ts_us", "-c AS delta"))
    counted = swept(fails.select("ip", "segment", "ts_us", "event_id"), deltas, ["ip", "segment"], window_us, "n")
    rank = F.when(F.col("n") >= 10, 3).when(F.col("n") >= 5, 2).when(F.col("n") >= 3, 1)
    ranked = durable(counted.withColumn("rank", rank).filter("rank IS NOT NULL"))
    changed = previous(ranked, ["ip", "segment"], "ts_us", "rank", 64 * window_us, "last").filter("last IS NULL OR rank <> last")
    return changed.select("ip", "ts_us", "event_id", "n", F.element_at(F.array(F.lit("warn"), F.lit("alert"), F.lit("ban")), F.col("rank")).alias("level"))


def active_bans(levels: DataFrame, as_of_us: int, hours: int = 24) -> DataFrame:
    """Addresses whose last ban is younger than hours, with the time left."""
    bans = levels.filter("level = 'ban'").groupBy("ip").agg(F.max("ts_us").alias("banned_us"))
    left = F.col("banned_us") + hours * 3_600_000_000 - as_of_us
    return bans.withColumn("left_us", left).filter(F.col("left_us") > 0)
