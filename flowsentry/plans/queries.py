"""All queries by name, each a function of (spark, folder), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.expressions import ACTIONABLE, CLASSES, DECISION, FLAGS, LEVELS, RULES, SENSITIVE_PORTS, TRUSTED, reason_texts, rounded
from flowsentry.operators import anomaly, audit, baselines, calibrate, features, pauses, quality, risk, state, stored_model, windows
from flowsentry.plans import oracle as o
from flowsentry.sources.flows import CONN_FIELDS, DNS_FIELDS, SSL_FIELDS, flows, parse_auth_log, parse_conn_log, parse_dns_log, parse_firewall_log, parse_ssl_log, read_alerts
from flowsentry.sources.tables import durable, shared_path
from flowsentry.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def flagged_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.with_flags(windows.window_features(flows(spark, d)))


def risk_of(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    return risk.risk_rows(baselines.with_thresholds(flagged_windows(spark, d), baselines.profiles(f)))


def events_of(spark: SparkSession, d: str, **options) -> DataFrame:
    return risk.classified(risk_of(spark, d), risk.source_ports(flows(spark, d)), **options)


@query(f"WITH {o.WINDOWS} SELECT * FROM windows")
def windows_features(spark, d):
    return windows.window_features(flows(spark, d))


@query(f"WITH {o.WINDOWS} SELECT src_ip, k, flag_port_scan, flag_brute_force, flag_burst, flag_dns_flood, flag_any FROM flagged")
def windows_flags(spark, d):
    return flagged_windows(spark, d).select("src_ip", "k", *FLAGS, "flag_any")


@query(f"WITH {o.WINDOWS} SELECT src_ip, k, ts_us, connections_5m, flag_any FROM flagged f WHERE k = (SELECT max(k) FROM flagged g WHERE g.src_ip = f.src_ip)")
def windows_latest(spark, d):
    return windows.latest(flagged_windows(spark, d)).select("src_ip", "k", "ts_us", "connections_5m", "flag_any")


@query(f"WITH {o.WINDOWS} SELECT src_ip, count(*) AS windows, CAST(sum(flag_any) AS BIGINT) AS flagged, max(connections_30s) AS max_connections, {rounded('CAST(sum(connections_30s) AS BIGINT) * 1e0 / count(*)', 4)} AS avg_connections, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in FLAGS)} FROM flagged GROUP BY src_ip")
def windows_summary(spark, d):
    return windows.summary(flagged_windows(spark, d))


@query(f"WITH {o.FLOWS_SQL}, {o.CLEAN}, {o.BUCKETS} SELECT src_ip, bucket, n, ports, {rounded('outbound', 6)} AS outbound, CAST(dns_1m AS BIGINT) AS dns_1m FROM buckets")
def baseline_buckets(spark, d):
    return baselines.buckets(flows(spark, d)).selectExpr("src_ip", "bucket", "n", "ports", f"{rounded('outbound', 6)} AS outbound", "dns_1m")


@query(f"WITH {o.FLOWS_SQL}, {o.CLEAN}, {o.PROFILES} SELECT * FROM profiles")
def baseline_profile(spark, d):
    return baselines.profiles(flows(spark, d))


@query(f"WITH {o.FLOWS_SQL}, {o.CLEAN}, {o.PROFILES} SELECT count(*) AS sources, CAST(sum(use_per_ip) AS BIGINT) AS own_baseline, CAST(sum(1 - use_per_ip) AS BIGINT) AS fallback FROM profiles")
def baseline_coverage(spark, d):
    return baselines.coverage(baselines.profiles(flows(spark, d)))


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, thr_connections, thr_ports, thr_entropy, thr_burst, thr_dns, score_scan, score_burst, score_dns, score_external FROM risk")
def risk_components(spark, d):
    return risk_of(spark, d).select("src_ip", "k", "thr_connections", "thr_ports", "thr_entropy", "thr_burst", "thr_dns", "score_scan", "score_burst", "score_dns", "score_external")


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, component_anomaly, component_scan, component_burst, component_dns, component_external, risk_score, risk_level FROM risk")
def risk_score(spark, d):
    return risk_of(spark, d).select("src_ip", "k", "component_anomaly", "component_scan", "component_burst", "component_dns", "component_external", "risk_score", "risk_level")


@query(f"WITH {o.EVENTS} SELECT src_ip, k, repeated, attack_type, confidence FROM events_")
def classify_events(spark, d):
    return events_of(spark, d).select("src_ip", "k", "repeated", "attack_type", "confidence")


# Sources and features

_PROTO = "CASE WHEN dst_port = 53 THEN 'udp' ELSE 'tcp' END"
_FLOWS = f"WITH {o.FLOWS_SQL}, f AS (SELECT *, {_PROTO} AS proto FROM flows), {o.CLEAN}"


@query(f"{_FLOWS} SELECT event_id, ts_us, src_ip, dst_ip, dst_port, proto, conn_state, orig_bytes, resp_bytes, duration FROM f")
def flows_table(spark, d):
    return flows(spark, d).drop("service")


@query(f"{_FLOWS} SELECT event_id, {', '.join(f'{rounded(e, 6) if c == 'bytes_ratio' else e} AS {c}' for c, e in features.CONNECTION.items())} FROM f")
def features_connections(spark, d):
    return features.connection_features(flows(spark, d)).selectExpr("event_id", *[f"{rounded(c, 6)} AS {c}" if c == "bytes_ratio" else c for c in features.CONNECTION])


@query(f"{_FLOWS} SELECT event_id, src_ip, dst_ip, dst_port FROM clean")
def flows_without_noise(spark, d):
    return features.without_noise(flows(spark, d)).select("event_id", "src_ip", "dst_ip", "dst_port")


@query(f"{_FLOWS} SELECT DISTINCT src_ip FROM flows WHERE src_ip LIKE '192.168.%'")
def flows_local_sources(spark, d):
    return features.local_sources(flows(spark, d))


@query(f"{_FLOWS} SELECT event_id, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY ts_us, src_ip, dst_ip, dst_port ORDER BY event_id) AS r FROM flows) c WHERE r = 1")
def flows_cleaned(spark, d):
    return features.cleaned(flows(spark, d)).select("event_id", "ts_us")


@query(f"{_FLOWS} SELECT event_id FROM clean WHERE ts_us > 3000000000")
def flows_collected(spark, d):
    f = flows(spark, d)
    return features.collected(f, f.filter("ts_us <= 3000000000")).select("event_id")


@query(f"{_FLOWS} SELECT event_id, ts_us FROM flows WHERE ts_us BETWEEN 3000000000 AND 4000000000 AND dst_ip = '192.168.50.1'")
def flows_time_slice(spark, d):
    return features.between(flows(spark, d), 3_000_000_000, 4_000_000_000, dst_ip="192.168.50.1").select("event_id", "ts_us")


@query(f"{_FLOWS} SELECT event_id, CAST(split_part(dst_ip, '.', 1) = '192' AS INTEGER) AS monitored FROM flows")
def flows_in_networks(spark, d):
    return flows(spark, d).select("event_id", features.in_networks("dst_ip", ["192.168.50.0/24", "10.0.0.0/8"]).cast("int").alias("monitored"))


def conn_lines(f: DataFrame) -> DataFrame:
    """Flows as lines of a connection log."""
    values = {"ts": F.format_string("%.6f", F.col("ts_us") / 1e6), "uid": F.concat(F.lit("C"), F.col("event_id").cast("string")), "src_ip": F.col("src_ip"), "dst_ip": F.col("dst_ip"), "dst_port": F.col("dst_port").cast("string"), "proto": F.col("proto"), "service": F.col("service"), "duration": F.col("duration").cast("string"), "orig_bytes": F.col("orig_bytes").cast("string"), "resp_bytes": F.col("resp_bytes").cast("string"), "conn_state": F.col("conn_state")}
    return f.select(F.concat_ws("\t", *[values.get(c, F.lit("-")) for c in CONN_FIELDS]).alias("value"))


@query(f"{_FLOWS} SELECT concat('C', CAST(event_id AS VARCHAR)) AS uid, ts_us, src_ip, dst_port, CASE WHEN dst_port = 53 THEN 'dns' WHEN dst_port = 22 THEN 'ssh' END AS service, CAST(orig_bytes AS DOUBLE) AS orig_bytes, CAST(NULL AS VARCHAR) AS history FROM flows")
def parse_connections(spark, d):
    return parse_conn_log(conn_lines(flows(spark, d))).selectExpr("uid", "CAST(round(ts * 1000000) AS BIGINT) AS ts_us", "src_ip", "CAST(dst_port AS BIGINT) AS dst_port", "service", "orig_bytes", "history")


@query(f"{_FLOWS} SELECT event_id, length(dst_ip) + 8 AS query_length, 4 AS query_dots, CASE WHEN conn_state = 'SF' THEN 1 ELSE 0 END AS dns_success, 1 AS qtype_A FROM flows WHERE dst_port = 53")
def parse_dns(spark, d):
    values = {"ts": F.format_string("%.6f", F.col("ts_us") / 1e6), "uid": F.col("event_id").cast("string"), "src_ip": F.col("src_ip"), "query": F.concat("dst_ip", F.lit(".example")), "qtype_name": F.lit("A"), "rcode_name": F.when(F.col("conn_state") == "SF", "NOERROR").otherwise("NXDOMAIN")}
    lines = flows(spark, d).filter("dst_port = 53").select(F.concat_ws("\t", *[values.get(c, F.lit("-")) for c in DNS_FIELDS]).alias("value"))
    return features.dns_features(parse_dns_log(lines)).selectExpr("CAST(uid AS BIGINT) AS event_id", "CAST(query_length AS BIGINT) AS query_length", "query_dots", "dns_success", "qtype_A")


@query(f"{_FLOWS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS tls_13, CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS tls_old, length(dst_ip) AS sni_length FROM flows WHERE dst_port = 443")
def parse_tls(spark, d):
    version = F.when(F.col("event_id") % 3 == 0, "TLSv13").when(F.col("event_id") % 3 == 1, "TLSv10").otherwise("-")
    values = {"ts": F.format_string("%.6f", F.col("ts_us") / 1e6), "uid": F.col("event_id").cast("string"), "version": version, "server_name": F.col("dst_ip")}
    lines = flows(spark, d).filter("dst_port = 443").select(F.concat_ws("\t", *[values.get(c, F.lit("-")) for c in SSL_FIELDS[:14]]).alias("value"))
    return features.ssl_features(parse_ssl_log(lines)).selectExpr("CAST(uid AS BIGINT) AS event_id", "tls_13", "tls_old", "CAST(sni_length AS BIGINT) AS sni_length")


_LOGINS = f"{_FLOWS}, logins AS (SELECT CASE WHEN dst_ip LIKE '203%' THEN dst_ip ELSE '203.0.113.200' END AS ip, ts_us, event_id, CASE WHEN conn_state = 'SF' THEN 'success' ELSE 'fail' END AS outcome FROM flows WHERE dst_port IN (22, 2222) OR (dst_port = 80 AND event_id % 5 = 0))"


def logins(f: DataFrame) -> DataFrame:
    """Login attempts: flows to login ports (and some web logins), by the remote address."""
    return f.filter("dst_port IN (22, 2222) OR (dst_port = 80 AND event_id % 5 = 0)").selectExpr("CASE WHEN dst_ip LIKE '203%' THEN dst_ip ELSE '203.0.113.200' END AS ip", "ts_us", "event_id", "CASE WHEN conn_state = 'SF' THEN 'success' ELSE 'fail' END AS outcome")


@query(f"{_LOGINS} SELECT outcome, concat('user', CAST(event_id % 7 AS VARCHAR)) AS user_name, ip, event_id FROM logins")
def parse_auth(spark, d):
    user = F.concat(F.lit("user"), (F.col("event_id") % 7).cast("string"))
    line = F.when(F.col("outcome") == "success", F.concat(F.lit("Accepted password for "), user, F.lit(" from "), "ip", F.lit(" port "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("Failed password for invalid user "), user, F.lit(" from "), "ip", F.lit(" port "), F.col("event_id").cast("string")))
    return parse_auth_log(logins(flows(spark, d)).select(F.concat(F.lit("Jun 14 03:22:11 host sshd[1]: "), line, F.lit(" ssh2")).alias("value"))).select("outcome", F.col("user").alias("user_name"), "ip", F.regexp_extract("line", r"port (\d+)", 1).cast("long").alias("event_id"))


@query(f"{_FLOWS} SELECT src_ip AS src, dst_ip AS dst, CAST(dst_port AS INTEGER) AS dst_port, upper(proto) AS proto, 'eth0' AS interface FROM f")
def parse_firewall(spark, d):
    line = F.concat(F.lit("kernel: FW_WAN IN=eth0 OUT= SRC="), "src_ip", F.lit(" DST="), "dst_ip", F.lit(" LEN=60 PROTO="), F.upper("proto"), F.lit(" SPT=40000 DPT="), F.col("dst_port").cast("string"), F.lit(" SYN URGP=0"))
    return parse_firewall_log(flows(spark, d).select(line.alias("value")))


@query(f"WITH {o.EVENTS} SELECT CAST(ts_us AS VARCHAR) AS time, 'flowsentry' AS source, attack_type AS alert_type FROM events_ UNION ALL SELECT NULL, NULL, 'legacy-log' FROM events_ WHERE k % 10 = 0")
def parse_alerts(spark, d):
    events = events_of(spark, d)
    lines = events.select(F.to_json(F.struct(F.col("ts_us").cast("string").alias("time"), F.lit("flowsentry").alias("source"), F.col("attack_type").alias("alert_type"))).alias("value"))
    return read_alerts(lines.unionAll(events.filter("k % 10 = 0").select(F.concat(F.lit("old line "), "src_ip").alias("value")))).select("time", "source", "alert_type")


# More window and risk queries


@query(f"""WITH {o.FLOWS_SQL}, {o.CLEAN}, e AS (SELECT min(ts_us) + 300000000 AS t0, max(ts_us) AS b FROM flows), g AS (SELECT k, t0 + k * 30000000 AS ts_us FROM (SELECT t0, unnest(range(0, CAST(floor((b + 30000000 - t0) / 30000000) AS BIGINT) + 1)) AS k FROM e) x),
{', '.join(f"c_{h} AS (SELECT g.k, f.src_ip, count(*) AS c FROM g JOIN clean f ON f.ts_us >= g.ts_us - {m * 30_000_000} AND f.ts_us < g.ts_us GROUP BY 1, 2), s_{h} AS (SELECT k, sum(c) AS n, max(c) AS m FROM c_{h} GROUP BY 1)" for h, m in o.HORIZONS.items())}
SELECT g.k, g.ts_us, {', '.join(f"CAST(coalesce(s_{h}.n, 0) AS BIGINT) AS connections_{h}, CAST(coalesce(s_{h}.m, 0) AS BIGINT) AS busiest_{h}" for h in o.HORIZONS)} FROM g {' '.join(f'LEFT JOIN s_{h} ON s_{h}.k = g.k' for h in o.HORIZONS)}""")
def windows_network_wide(spark, d):
    return windows.network_windows(flows(spark, d))


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, thr_connections, thr_ports, thr_dns FROM risk")
def baseline_lookup(spark, d):
    return risk_of(spark, d).select("src_ip", "k", "thr_connections", "thr_ports", "thr_dns")


_PART = "CASE WHEN {c} >= 1 THEN {t} END"
_EXPLAIN = f"""CASE WHEN risk_level = 'NORMAL' THEN 'normal traffic' ELSE (SELECT coalesce(string_agg(t, ' | ' ORDER BY p DESC, i), 'unusual pattern') FROM (VALUES (component_anomaly, 0, 'unusual behaviour'), (component_scan, 1, concat(CASE WHEN flag_port_scan = 1 AND (unique_dst_ports_30s >= 20 OR unique_dst_ports_1m >= 20) THEN 'possible port scan' ELSE 'more ports than usual' END, ' (', CAST(unique_dst_ports_30s AS VARCHAR), ' ports)')), (component_burst, 2, concat('connection burst (', CAST(connections_30s AS VARCHAR), ' in 30s)')), (component_dns, 3, 'high DNS rate')) v(p, i, t) WHERE p >= 1) END"""


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, {_EXPLAIN} AS explanation FROM risk")
def risk_explain(spark, d):
    return risk.explained(risk_of(spark, d)).select("src_ip", "k", "explanation")


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, risk_score, risk_level FROM risk WHERE risk_score >= 20")
def risk_alerts(spark, d):
    """From 20 on here: without anomaly scores hardly a window of the given tables reaches the usual 30."""
    return risk.alerts(risk_of(spark, d), 20).select("src_ip", "k", "risk_score", "risk_level")


_LEVEL_COUNTS = ", ".join(f"CAST(sum(CASE WHEN risk_level = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x.lower()}" for x in LEVELS)


@query(f"WITH {o.RISK_ROWS} SELECT *, CASE WHEN critical + alert <= 5 THEN 'ok' WHEN critical + alert <= 15 THEN 'warn' ELSE 'bad' END AS budget, {', '.join(f'floor({x.lower()} * 1e3 / rows + 0.5) / 10 AS {x.lower()}_percent' for x in LEVELS)} FROM (SELECT count(*) AS rows, {_LEVEL_COUNTS}, max(risk_score) AS max_risk, {rounded('avg(risk_score)', 4)} AS mean_risk, {rounded('avg(anomaly_score)', 4)} AS mean_anomaly FROM risk) x")
def risk_daily_summary(spark, d):
    return risk.daily_summary(risk_of(spark, d))


@query(f"WITH {o.RISK_ROWS} SELECT ts_us // 600000000 AS period, {_LEVEL_COUNTS}, max(risk_score) AS max_risk FROM risk GROUP BY 1")
def risk_history_pivot(spark, d):
    rows = risk_of(spark, d).withColumn("period", F.floor(F.col("ts_us") / 600_000_000).cast("long"))
    pivot = rows.groupBy("period").pivot("risk_level", list(LEVELS)).agg(F.count(F.lit(1))).na.fill(0)
    return pivot.select("period", *[F.col(x).alias(x.lower()) for x in LEVELS]).join(rows.groupBy("period").agg(F.max("risk_score").alias("max_risk")), "period")


# Classes

_TRUSTED = f"WITH {o.RISK_ROWS}, {o.PORTS}, {o.events('events_', TRUSTED + ('192.168.50.19',))}"
_ORDER = "confidence DESC, risk_score DESC, anomaly_score DESC, connections_30s DESC, src_ip, k"


@query(f"{_TRUSTED} SELECT src_ip, k, attack_type, {rounded('confidence', 4)} AS confidence FROM events_")
def classify_trusted(spark, d):
    return events_of(spark, d, trusted=TRUSTED + ("192.168.50.19",)).selectExpr("src_ip", "k", "attack_type", f"{rounded('confidence', 4)} AS confidence")


@query(f"WITH {o.EVENTS} SELECT c.attack_type, CAST(count(e.k) AS BIGINT) AS events, max(e.confidence) AS max_confidence, max(e.risk_score) AS max_risk FROM (VALUES {', '.join(f'({c!r})' for c in CLASSES)}) c(attack_type) LEFT JOIN events_ e ON e.attack_type = c.attack_type GROUP BY 1")
def classify_day_summary(spark, d):
    return risk.class_counts(events_of(spark, d))


@query(f"WITH {o.EVENTS} SELECT src_ip, k, attack_type, confidence FROM events_ ORDER BY CASE WHEN attack_type = 'LOW_SIGNAL_REVIEW' THEN 1 ELSE 0 END, {_ORDER} LIMIT 10")
def classify_top_display(spark, d):
    return risk.top_display(events_of(spark, d)).select("src_ip", "k", "attack_type", "confidence")


@query(f"WITH {o.EVENTS}, g AS (SELECT attack_type, count(*) AS events FROM events_ WHERE confidence >= 0.65 GROUP BY 1) SELECT attack_type, events FROM g WHERE attack_type <> 'LOW_SIGNAL_REVIEW' OR (SELECT count(*) FROM g WHERE attack_type <> 'LOW_SIGNAL_REVIEW') = 0")
def classify_high_confidence(spark, d):
    return risk.high_confidence(events_of(spark, d))


# State

_RECENT = f"{_FLOWS}, recent AS (SELECT *, (SELECT max(ts_us) FROM clean) - ts_us AS age FROM clean)"
_F = "conn_state IN ('S0', 'REJ')"
_VICTIMS = f"""{_RECENT}, victims AS (SELECT dst_ip, {', '.join(f"count(DISTINCT CASE WHEN age <= {a} THEN dst_port END) AS ports_{n}, CAST(sum(CASE WHEN {_F} AND age <= {a} THEN 1 ELSE 0 END) AS BIGINT) AS fails_{n}" for n, a in state.AGO.items())},
{', '.join(f"CAST(sum(CASE WHEN {_F} AND dst_port = 22 AND age <= {state.AGO[n]} THEN 1 ELSE 0 END) AS BIGINT) AS ssh_fails_{n}" for n in ('5m', '1h'))}, count(DISTINCT dst_port) AS ports_all, CAST(sum(CASE WHEN {_F} THEN 1 ELSE 0 END) AS BIGINT) AS fails_all,
max(CASE WHEN dst_port IN ({', '.join(map(str, SENSITIVE_PORTS))}) THEN 1 ELSE 0 END) AS sensitive FROM recent WHERE age <= 86400000000 AND dst_ip LIKE '192.168.%' GROUP BY 1),
outbound AS (SELECT src_ip, CAST(sum(CASE WHEN dst_port = 53 AND age <= 3600000000 THEN 1 ELSE 0 END) AS BIGINT) AS dns_1h, CAST(sum(CASE WHEN dst_port <> 53 AND conn_state = 'SF' THEN 1 ELSE 0 END) AS BIGINT) AS successes, count(DISTINCT CASE WHEN dst_ip NOT LIKE '192.168.%' THEN dst_ip END) AS external_ips, count(DISTINCT CASE WHEN dst_ip LIKE '192.168.%' THEN dst_ip END) AS internal_ips FROM recent WHERE age <= 86400000000 AND dst_ip <> src_ip GROUP BY 1)"""


@query(f"{_VICTIMS} SELECT * FROM victims")
def state_victim(spark, d):
    return state.victims(flows(spark, d))


@query(f"{_VICTIMS} SELECT * FROM outbound")
def state_outbound(spark, d):
    return state.outbound(flows(spark, d))


def _scored(table: str, host: str, role: str, scores: dict, total: str) -> str:
    return f"SELECT host, role, {total} AS state_risk, concat_ws(',', {', '.join(f'''CASE WHEN {c} > 0 THEN '{c[:-9]}' END''' for c in scores)}) AS patterns FROM (SELECT {host} AS host, '{role}' AS role, {', '.join(f'{e} AS {c}' for c, e in scores.items())} FROM {table}) x"


@query(f"{_VICTIMS} SELECT * FROM ({_scored('victims', 'dst_ip', 'victim', state.VICTIM_SCORES, state.VICTIM_RISK)} UNION ALL {_scored('outbound', 'src_ip', 'outbound', state.OUTBOUND_SCORES, state.OUTBOUND_RISK)}) y WHERE state_risk > 0")
def state_combined(spark, d):
    return state.state_risk(flows(spark, d))


@query(f"{_VICTIMS} SELECT CAST(coalesce(sum(CASE WHEN state_risk >= 0.7 THEN 1 ELSE 0 END), 0) AS BIGINT) AS high, CAST(coalesce(sum(CASE WHEN state_risk >= 0.4 AND state_risk < 0.7 THEN 1 ELSE 0 END), 0) AS BIGINT) AS medium, CAST(coalesce(sum(CASE WHEN state_risk > 0 AND state_risk < 0.4 THEN 1 ELSE 0 END), 0) AS BIGINT) AS low FROM ({_scored('victims', 'dst_ip', 'victim', state.VICTIM_SCORES, state.VICTIM_RISK)} UNION ALL {_scored('outbound', 'src_ip', 'outbound', state.OUTBOUND_SCORES, state.OUTBOUND_RISK)}) y")
def state_history(spark, d):
    n = lambda c: F.coalesce(F.sum(F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END")), F.lit(0))
    return state.state_risk(flows(spark, d)).agg(n("state_risk >= 0.7D").alias("high"), n("state_risk >= 0.4D AND state_risk < 0.7D").alias("medium"), n("state_risk > 0 AND state_risk < 0.4D").alias("low"))


_SCANS = f"{_FLOWS}, scans AS (SELECT a.src_ip, a.ts_us, a.event_id, count(DISTINCT b.dst_port) AS ports FROM clean a JOIN clean b ON b.src_ip = a.src_ip AND b.ts_us BETWEEN a.ts_us - 30000000 AND a.ts_us GROUP BY 1, 2, 3 HAVING count(DISTINCT b.dst_port) >= 5)"


@query(f"{_SCANS} SELECT * FROM scans")
def perimeter_port_scan(spark, d):
    return state.perimeter_scans(features.without_noise(flows(spark, d)))


def _cooled(ctes: str, table: str, keys: str, pause: int) -> str:
    on = " AND ".join(f"a.{k} = e.{k}" for k in keys.split(", "))
    return f"{ctes.replace('WITH', 'WITH RECURSIVE', 1)}, emitted AS (SELECT {keys}, min(ts_us) AS ts_us FROM {table} GROUP BY {keys} UNION ALL SELECT {', '.join(f'e.{k}' for k in keys.split(', '))}, min(a.ts_us) AS ts_us FROM emitted e JOIN {table} a ON {on} AND a.ts_us >= e.ts_us + {pause} GROUP BY {', '.join(f'e.{k}' for k in keys.split(', '))}, e.ts_us) SELECT {keys}, ts_us FROM emitted"


@query(_cooled(_SCANS, "scans", "src_ip", 30_000_000))
def perimeter_cooldown(spark, d):
    return pauses.cooldown(state.perimeter_scans(features.without_noise(flows(spark, d))), ["src_ip"], 30_000_000)


_LEVELS = f"""{_LOGINS}, seg AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY ip ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM logins),
cnt AS (SELECT *, count(*) OVER (PARTITION BY ip, s ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM seg WHERE outcome = 'fail'),
lev AS (SELECT *, CASE WHEN n >= 10 THEN 3 WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 1 END AS r FROM cnt),
prv AS (SELECT *, lag(r) OVER (PARTITION BY ip, s ORDER BY ts_us, event_id) AS l FROM lev WHERE r IS NOT NULL),
levels AS (SELECT ip, ts_us, event_id, n, CASE r WHEN 1 THEN 'warn' WHEN 2 THEN 'alert' ELSE 'ban' END AS level FROM prv WHERE l IS NULL OR l <> r)"""


@query(f"{_LEVELS} SELECT * FROM levels")
def auth_levels(spark, d):
    return state.login_levels(logins(flows(spark, d)))


@query(f"{_LEVELS} SELECT ip, max(ts_us) AS banned_us, max(ts_us) + 86400000000 - 7000000000 AS left_us FROM levels WHERE level = 'ban' GROUP BY 1 HAVING max(ts_us) + 86400000000 > 7000000000")
def auth_bans(spark, d):
    return state.active_bans(state.login_levels(logins(flows(spark, d))), 7_000_000_000)


# Quality


@query(f"{_FLOWS} {' UNION ALL '.join(f'''SELECT '{c}' AS column_name, {rounded(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100', 4)} AS null_percent FROM f''' for c in quality.REQUIRED)}")
def quality_nulls(spark, d):
    return quality.null_shares(flows(spark, d))


@query(f"{_FLOWS}, g AS (SELECT count(*) AS n FROM flows GROUP BY ts_us, src_ip, dst_ip, dst_port) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS repeats, {rounded('sum(n - 1) * 1e2 / sum(n)', 4)} AS percent FROM g")
def quality_duplicates(spark, d):
    return quality.duplicates(flows(spark, d))


_GAPS = f"{_FLOWS}, g AS (SELECT lag(ts_us) OVER (ORDER BY ts_us) AS start_us, ts_us - lag(ts_us) OVER (ORDER BY ts_us) AS gap_us FROM flows), long AS (SELECT start_us, gap_us FROM g WHERE gap_us > 3000000)"


@query(f"{_GAPS} SELECT start_us, gap_us FROM long")
def quality_time_gaps(spark, d):
    """Gaps of more than 3 seconds; the given flows have none of minutes."""
    return quality.time_gaps(flows(spark, d), 3 / 60)


@query(f"{_GAPS} SELECT start_us, gap_us, (SELECT count(*) FROM long) AS gaps, (SELECT max(gap_us) FROM long) AS longest_us, 'info' AS grade FROM long ORDER BY gap_us DESC, start_us LIMIT 5")
def quality_longest_gaps(spark, d):
    return quality.longest_gaps(quality.time_gaps(flows(spark, d), 3 / 60))


@query(f"{_FLOWS}, g AS (SELECT src_ip, ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS gap FROM flows) SELECT src_ip, count(*) AS gaps, max(gap) AS longest_us FROM g WHERE gap > 30000000 GROUP BY 1")
def quality_source_gaps(spark, d):
    return quality.source_gaps(flows(spark, d), 30)


@query(f"{_FLOWS}, g AS (SELECT src_ip, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY src_ip ORDER BY event_id) THEN 1 ELSE 0 END AS late FROM flows) SELECT src_ip, CAST(sum(late) AS BIGINT) AS late FROM g GROUP BY 1")
def quality_order(spark, d):
    return quality.out_of_order(flows(spark, d))


@query(f"{_FLOWS} SELECT count(DISTINCT proto) AS protocols, count(DISTINCT dst_ip) AS destinations, CAST(sum(CASE WHEN orig_bytes + resp_bytes = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_byte_rows, count(*) AS rows FROM f")
def quality_variety(spark, d):
    return quality.variety(flows(spark, d))


@query(f"{_FLOWS} SELECT CAST(sum(CASE WHEN dst_ip = '224.0.0.251' THEN 1 ELSE 0 END) AS BIGINT) AS by_ip, CAST(sum(CASE WHEN dst_port = 5353 THEN 1 ELSE 0 END) AS BIGINT) AS by_port, count(*) AS rows FROM flows")
def quality_noise(spark, d):
    return quality.noise_shares(flows(spark, d))


@query(f"{_FLOWS}, e AS (SELECT min(ts_us) AS a, max(ts_us) AS b FROM flows), x AS (SELECT unnest(range(0, (b - a) // 600000000 + 1)) AS bucket FROM e), c AS (SELECT (ts_us - (SELECT a FROM e)) // 600000000 AS bucket, count(*) AS n FROM flows GROUP BY 1), y AS (SELECT x.bucket, coalesce(c.n, 0) AS n FROM x LEFT JOIN c ON c.bucket = x.bucket) SELECT bucket, CAST(n AS BIGINT) AS n FROM y WHERE n < 0.5 * (SELECT avg(n) FROM y)")
def quality_sudden_drops(spark, d):
    return quality.sudden_drops(flows(spark, d), 0.5)


@query(f"{_FLOWS} SELECT proto, count(*) AS n, {rounded('count(*) * 1e2 / (SELECT count(*) FROM f)', 2)} AS percent FROM f GROUP BY 1")
def quality_activity(spark, d):
    return quality.activity(flows(spark, d))


@query(f"{_FLOWS} SELECT ts_us // 3600000000 AS hour, count(*) AS n FROM flows GROUP BY 1")
def quality_hourly(spark, d):
    return quality.hourly(flows(spark, d))


@query(f"{_FLOWS} SELECT dst_ip, count(*) AS n FROM flows WHERE dst_ip NOT LIKE '192.168.%' GROUP BY 1 ORDER BY n DESC, dst_ip LIMIT 5")
def quality_top_external(spark, d):
    return quality.top_external(flows(spark, d))


@query(f"WITH {o.WINDOWS} SELECT src_ip, count(*) AS windows, CASE WHEN count(*) >= 100 THEN 1 ELSE 0 END AS enough FROM windows GROUP BY 1")
def quality_window_coverage(spark, d):
    return quality.window_coverage(windows.window_features(flows(spark, d)))


@query(f"WITH {o.WINDOWS} {' UNION ALL '.join(f'''SELECT '{c}' AS feature, {rounded(f'avg({c})', 4)} AS mean, {rounded(f'quantile_cont({c}, 0.99)', 4)} AS p99, CAST(max({c}) AS DOUBLE) AS most, CASE WHEN max({c}) > min({c}) THEN 1 ELSE 0 END AS varies FROM windows''' for c in quality.HEALTH)}")
def quality_feature_health(spark, d):
    return quality.feature_health(windows.window_features(flows(spark, d)))


_STEP = lambda c, a, b: f"CASE WHEN {c} >= {a} THEN 100 WHEN {c} >= {b} THEN 60 ELSE 20 END"


@query(f"{_FLOWS}, x AS (SELECT count(*) AS n, count(DISTINCT proto) AS protocols, count(DISTINCT dst_ip) AS destinations, count(DISTINCT ts_us // 3600000000) AS hours FROM f), y AS (SELECT *, {_STEP('n', 5000, 1000)} AS quantity, {_STEP('protocols', 3, 2)} AS protocol_score, {_STEP('destinations', 50, 10)} AS destination_score, {_STEP('hours', 12, 4)} AS hour_score FROM x) SELECT *, (quantity + protocol_score + destination_score + hour_score) / 4e0 AS score FROM y")
def quality_grade(spark, d):
    return quality.grade(flows(spark, d))


_OUTCOMES = {"n >= 50": "fail", "nulls <= 0.05": "warn", "protocols >= 2": "warn", "destinations >= 2": "warn", "zero <= 0.8": "warn"}
_CHECKS = " UNION ALL ".join(f"SELECT CASE WHEN {test} THEN 'pass' ELSE '{other}' END AS outcome FROM x" for test, other in _OUTCOMES.items())


@query(f"{_FLOWS}, x AS (SELECT count(*) AS n, count(DISTINCT proto) AS protocols, count(DISTINCT dst_ip) AS destinations, avg(CASE WHEN orig_bytes + resp_bytes = 0 THEN 1e0 ELSE 0e0 END) AS zero, avg(CASE WHEN src_ip IS NULL OR dst_ip IS NULL OR ts_us IS NULL THEN 1e0 ELSE 0e0 END) AS nulls FROM f), c AS ({_CHECKS}), y AS (SELECT count(*) FILTER (WHERE outcome = 'pass') AS pass, count(*) FILTER (WHERE outcome = 'warn') AS warn, count(*) FILTER (WHERE outcome = 'fail') AS fail, count(*) AS total FROM c) SELECT pass, warn, fail, CAST(floor((pass * 10 + warn * 5) * 1e0 / total + 5e-1) AS BIGINT) AS score, CASE WHEN fail > 0 THEN 'fail' WHEN warn > 2 THEN 'warn' ELSE 'pass' END AS status FROM y")
def quality_integrity(spark, d):
    return quality.integrity(flows(spark, d))


_SPARSE = " + ".join(f"CASE WHEN (SELECT avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) FROM f) > 0.1 THEN 1 ELSE 0 END" for c in quality.REQUIRED)


@query(f"WITH {o.WINDOWS}, f AS (SELECT *, {_PROTO} AS proto FROM flows), g AS (SELECT ts_us - lag(ts_us) OVER (ORDER BY ts_us) AS gap FROM flows), r AS (SELECT count(*) - 1 AS more FROM f GROUP BY {', '.join(quality.REQUIRED)}), x AS (SELECT (SELECT count(DISTINCT ts_us // 86400000000) FROM flows) AS days, (SELECT count(*) FROM flows) AS records, (SELECT count(*) FROM windows) AS windows, (SELECT count(*) FROM g WHERE gap > 21600000000) AS gaps, CAST({_SPARSE} AS BIGINT) AS sparse_columns, CAST((SELECT coalesce(sum(more), 0) FROM r) AS BIGINT) AS repeats) SELECT *, {', '.join(quality.readiness_rules(3, 10_000, 5_000))} FROM x")
def quality_readiness(spark, d):
    return quality.readiness(flows(spark, d), windows.window_features(flows(spark, d)))


# Audits

_AUDIT = f"WITH {o.RISK_ROWS}, days AS (SELECT *, {audit.LABEL} AS label FROM (SELECT ts_us // 86400000000 AS day, count(*) AS windows, count(DISTINCT src_ip) AS sources, max(risk_score) AS max_risk, {rounded('(max(ts_us) - min(ts_us)) / 36e8', 4)} AS hours, {', '.join(f'CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}' for n, c in audit.COUNTS.items())} FROM risk GROUP BY 1) x)"


@query(f"{_AUDIT} SELECT * FROM days")
def audit_day(spark, d):
    return audit.day_audit(risk_of(spark, d))


@query(f"{_AUDIT} SELECT *, CASE WHEN suspicious > 0 THEN 'no' WHEN incomplete > 0 OR clean < 3 THEN 'not yet' ELSE 'manual review' END AS recommendation FROM (SELECT CAST(sum(CASE WHEN label = 'SUSPICIOUS_VALIDATION' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious, CAST(sum(CASE WHEN label = 'INCOMPLETE' THEN 1 ELSE 0 END) AS BIGINT) AS incomplete, CAST(sum(CASE WHEN label = 'CANDIDATE_CLEAN' THEN 1 ELSE 0 END) AS BIGINT) AS clean FROM days) x")
def audit_retrain(spark, d):
    return audit.retraining(audit.day_audit(risk_of(spark, d)))


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, risk_score, rank FROM (SELECT src_ip, k, risk_score, row_number() OVER (PARTITION BY src_ip ORDER BY risk_score DESC, anomaly_score DESC, connections_30s DESC, k) AS rank FROM risk) x WHERE rank <= 3")
def audit_top_windows(spark, d):
    return audit.top_windows(risk_of(spark, d), 3).select("src_ip", "k", "risk_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {o.EVENTS} SELECT src_ip, count(*) AS rows, {', '.join(f'max({c}) AS max_{c}' for c in ('risk_score', 'anomaly_score', 'failed_conn_rate_30s', 'connections_30s', 'dns_rate_30s'))}, min(ts_us) AS first_us, max(ts_us) AS last_us FROM events_ GROUP BY 1")
def audit_suspicious_sources(spark, d):
    return audit.suspicious_sources(events_of(spark, d))


@query(f"WITH {o.EVENTS} {' UNION ALL '.join(f'''SELECT '{n}' AS measure, {e} AS bucket, count(*) AS n FROM events_ GROUP BY 2''' for n, e in audit.RANGES.items())}")
def accuracy_distributions(spark, d):
    return audit.distributions(events_of(spark, d))


_REASONS = " UNION ALL ".join([*(f"SELECT src_ip, k, anomaly_score, attack_type, '{t}' AS reason FROM events_ WHERE attack_type = '{a}' AND {c}" for a, cs in [*((k, v[1]) for k, v in RULES.items()), ("BOT_LIKE_BEHAVIOR", risk.BOT)] for c, t in reason_texts(cs)), "SELECT src_ip, k, anomaly_score, attack_type, 'risk' FROM events_ WHERE attack_type = 'UNKNOWN_SUSPICIOUS' AND risk_score >= 30", "SELECT src_ip, k, anomaly_score, attack_type, 'anomaly' FROM events_ WHERE attack_type = 'UNKNOWN_SUSPICIOUS' AND anomaly_score >= 35e-2", "SELECT src_ip, k, anomaly_score, attack_type, 'risk in review range' FROM events_ WHERE attack_type = 'LOW_SIGNAL_REVIEW' AND risk_score >= 20 AND risk_score < 30", "SELECT src_ip, k, anomaly_score, attack_type, 'weak indicators' FROM events_ WHERE attack_type = 'LOW_SIGNAL_REVIEW'"])


@query(f"WITH {o.EVENTS}, reasons AS ({_REASONS}) SELECT reason, count(*) AS n, {rounded('count(*) * 1e2 / (SELECT count(*) FROM events_)', 2)} AS percent FROM reasons GROUP BY 1")
def accuracy_reasons(spark, d):
    return audit.reason_counts(events_of(spark, d))


# Written out by hand, as is the Spark side: which family each reason is of.
_FAMILY = "CASE WHEN reason = 'anomaly' THEN 'anomaly' WHEN reason IN ('risk', 'risk with connections', 'risk in review range') THEN 'risk' WHEN reason IN ('connections', 'connections with risk', 'connections with failures') THEN 'connections' WHEN reason = 'failed rate' THEN 'failed_connections' WHEN reason IN ('dns rate', 'flag_dns_flood') THEN 'dns' WHEN reason IN ('ports in 30s', 'ports in 1m') THEN 'scan_spread' WHEN reason IN ('flag_burst', 'flag_port_scan', 'flag_brute_force') THEN 'flag' WHEN reason = 'burst with support' THEN 'burst' WHEN reason = 'bytes with support' THEN 'bytes_rate' WHEN reason = 'ssh evidence' THEN 'ssh_context' WHEN reason = 'repeated source' THEN 'repeated_source' ELSE 'other' END"


@query(f"WITH {o.EVENTS}, reasons AS ({_REASONS}), fam AS (SELECT DISTINCT src_ip, k, anomaly_score, {_FAMILY} AS family FROM reasons) SELECT src_ip, k, string_agg(family, ',' ORDER BY family) AS signals, CASE WHEN min(anomaly_score) = 0 AND sum(CASE WHEN family = 'anomaly' THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS heuristic_only, CASE WHEN count(DISTINCT CASE WHEN family <> 'risk' THEN family END) >= 2 THEN 1 ELSE 0 END AS several_signals FROM fam GROUP BY 1, 2")
def accuracy_signals(spark, d):
    return audit.signal_families(events_of(spark, d)).select("src_ip", "k", F.array_join("signals", ",").alias("signals"), "heuristic_only", "several_signals")


@query(f"WITH {o.EVENTS} SELECT attack_type, count(*) AS n, CAST(sum(CASE WHEN anomaly_score = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_anomaly, count(DISTINCT src_ip) AS sources, {', '.join(f'min({c}) AS min_{c}, {rounded(f'quantile_cont({c}, 0.5)', 4)} AS median_{c}, max({c}) AS max_{c}' for c in ('confidence', 'risk_score'))} FROM events_ GROUP BY 1")
def accuracy_classes(spark, d):
    return audit.class_breakdown(events_of(spark, d))


@query(f"WITH {o.EVENTS}, i AS (SELECT *, k - row_number() OVER (PARTITION BY src_ip, attack_type ORDER BY k) AS island FROM events_), r AS (SELECT src_ip, attack_type, island, count(*) AS run, min(ts_us) AS a, max(ts_us) AS b, max(risk_score) AS m, max(confidence) AS mc FROM i GROUP BY 1, 2, 3) SELECT src_ip, attack_type, CAST(sum(run) AS BIGINT) AS n, min(a) AS first_us, max(b) AS last_us, max(run) AS longest_run, max(m) AS max_risk, max(mc) AS max_confidence FROM r GROUP BY 1, 2 HAVING sum(run) >= 2")
def accuracy_sequences(spark, d):
    return audit.repeated_sequences(events_of(spark, d))


@query(f"WITH {o.RISK_ROWS} {' UNION ALL '.join(f'''SELECT '{c}' AS feature, {', '.join(f'{rounded(f'quantile_cont({c}, {q})', 6)} AS p{int(q * 100)}' for q in (0.5, 0.75, 0.9, 0.95, 0.99))}, CAST(max({c}) AS DOUBLE) AS most FROM risk''' for c in audit.QUANTILE_FEATURES)}")
def accuracy_quantiles(spark, d):
    return audit.feature_quantiles(risk_of(spark, d))


@query(f"WITH {o.EVENTS}, t AS (SELECT attack_type, count(*) AS c FROM events_ GROUP BY 1) SELECT (SELECT count(*) FROM risk) AS rows, (SELECT count(*) FROM risk WHERE anomaly_score = 0) AS zero_anomaly, (SELECT count(*) FROM events_) AS suspicious, (SELECT attack_type FROM t ORDER BY c DESC, attack_type DESC LIMIT 1) AS top_class, {rounded('(SELECT count(*) FROM events_) * 1e2 / (SELECT count(*) FROM risk)', 4)} AS percent")
def accuracy_headline(spark, d):
    return audit.headline(risk_of(spark, d), events_of(spark, d))


# Calibration

_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
_EARLIER = f"{o.RISK_ROWS}, {o.PORTS}, {o.events('events_', (), True)}"
_GOOD = "start_row IS NOT NULL AND stop_row > start_row AND stop_row <= rows AND src_ip IS NOT NULL AND NOT (label = 'attack' AND expected IS NULL)"
_SESSIONS = f"""spans AS (SELECT src_ip, row_number() OVER (ORDER BY src_ip) - 1 AS r, count(*) AS n FROM windows GROUP BY 1),
sessions AS (SELECT 3 * r AS session, 'normal' AS label, src_ip, 0 AS start_row, CASE WHEN r % 6 = 4 THEN 0 ELSE n // 3 END AS stop_row, CAST(NULL AS VARCHAR) AS expected, n AS rows FROM spans
  UNION ALL SELECT 3 * r + 1, 'normal', src_ip, n // 4, CASE WHEN r % 6 = 5 THEN NULL WHEN r % 6 = 2 THEN n // 8 - 1 ELSE n // 2 END, NULL, n FROM spans
  UNION ALL SELECT 3 * r + 2, 'attack', src_ip, n // 2, CASE WHEN r % 6 = 2 THEN n + 5 ELSE n END, CASE r % 6 WHEN 3 THEN NULL WHEN 0 THEN 'FAILED_CONNECTION_PATTERN' WHEN 1 THEN 'DNS_ANOMALY' ELSE 'LOW_SIGNAL_REVIEW' END, n FROM spans),
policies({', '.join(calibrate.POLICY_COLUMNS)}) AS (VALUES {_VALUES(calibrate.POLICIES)})"""


def _scope(table: str, label: str) -> str:
    return f"(SELECT * FROM (SELECT t.*, s.session, s.expected, row_number() OVER (PARTITION BY t.src_ip, t.k ORDER BY s.session) AS ord FROM {table} t JOIN (SELECT * FROM sessions WHERE {_GOOD} AND label = '{label}') s ON s.src_ip = t.src_ip AND t.k >= s.start_row AND t.k < s.stop_row) z WHERE ord = 1)"


def _replay(source: str) -> str:
    return f"seq AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, attack_type ORDER BY ts_us, k ROWS UNBOUNDED PRECEDING) AS sequence FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip, attack_type ORDER BY ts_us, k) <= 90000000 THEN 0 ELSE 1 END AS fresh FROM {source} a) b), per AS (SELECT *, count(*) OVER (PARTITION BY src_ip, attack_type, sequence) AS persistence FROM seq), replay AS (SELECT *, {calibrate.KEPT} AS kept FROM per CROSS JOIN policies)"


_NORMAL_EVENTS, _ATTACK_EVENTS = _scope("events_", "normal"), _scope("events_", "attack")


def sessions_of(spark, d):
    return calibrate.derived_sessions(windows.window_features(flows(spark, d)))


@query(f"WITH {o.WINDOWS}, {_SESSIONS} SELECT session, label, src_ip, CASE WHEN start_row IS NULL OR stop_row IS NULL THEN 'missing bounds' WHEN stop_row < start_row THEN 'bounds out of order' WHEN stop_row > rows THEN 'beyond row count' WHEN stop_row = start_row THEN 'no rows added' WHEN src_ip IS NULL THEN 'no sources' WHEN label = 'attack' AND expected IS NULL THEN 'no expected class' END AS excluded FROM sessions")
def calib_sessions(spark, d):
    return calibrate.validated_sessions(sessions_of(spark, d)).select("session", "label", "src_ip", "excluded")


@query(f"WITH {o.RISK_ROWS}, {_SESSIONS} SELECT src_ip, k, session, risk_score FROM {_scope('risk', 'normal')} x")
def calib_normal_rows(spark, d):
    return calibrate.scoped(risk_of(spark, d), sessions_of(spark, d), "normal").select("src_ip", "k", "session", "risk_score")


@query(f"WITH {_EARLIER}, {_SESSIONS}, {_replay('events_')} SELECT src_ip, k, attack_type, CAST(sequence AS BIGINT) AS sequence, persistence FROM per")
def calib_sequences(spark, d):
    return calibrate.sequences(events_of(spark, d, earlier=True)).select("src_ip", "k", "attack_type", "sequence", "persistence")


@query(f"WITH {_EARLIER}, {_SESSIONS}, {_replay('events_')} SELECT policy, src_ip, k, attack_type, kept FROM replay")
def calib_replay(spark, d):
    return calibrate.replayed(events_of(spark, d, earlier=True)).select("policy", "src_ip", "k", "attack_type", "kept")


@query(f"WITH {_EARLIER}, {_SESSIONS}, {_replay('events_')} SELECT policy, attack_type, CAST(sum(kept) AS BIGINT) AS retained, CAST(sum(1 - kept) AS BIGINT) AS removed FROM replay GROUP BY 1, 2")
def calib_by_class(spark, d):
    return calibrate.by_class(events_of(spark, d, earlier=True))


_METRICS = f"""{_EARLIER}, {_SESSIONS}, {_replay('events_')}, kept_rows AS (SELECT policy, src_ip, attack_type, ts_us FROM replay WHERE kept = 1),
emitted AS (SELECT policy, src_ip, attack_type, min(ts_us) AS ts_us FROM kept_rows GROUP BY 1, 2, 3 UNION ALL SELECT e.policy, e.src_ip, e.attack_type, min(a.ts_us) AS ts_us FROM emitted e JOIN kept_rows a ON a.policy = e.policy AND a.src_ip = e.src_ip AND a.attack_type = e.attack_type AND a.ts_us >= e.ts_us + 600000000 GROUP BY e.policy, e.src_ip, e.attack_type, e.ts_us),
counts AS (SELECT policy, CAST(sum(kept) AS BIGINT) AS kept, count(*) AS cur, count(DISTINCT CASE WHEN kept = 1 THEN src_ip END) AS sources, CAST(sum(CASE WHEN kept = 1 AND {ACTIONABLE} THEN 1 ELSE 0 END) AS BIGINT) AS actionable FROM replay GROUP BY 1),
als AS (SELECT policy, count(*) AS alerts FROM emitted GROUP BY 1),
metrics AS (SELECT *, CASE WHEN percent <= 1 AND alerts <= 5 THEN 1 ELSE 0 END AS target_met FROM (SELECT c.policy, kept, sources, actionable, CAST(coalesce(alerts, 0) AS BIGINT) AS alerts, {rounded('kept * 1e2 / (SELECT count(*) FROM risk)', 4)} AS percent, {rounded('(cur - kept) * 1e2 / cur', 4)} AS reduction FROM counts c LEFT JOIN als ON als.policy = c.policy) m)"""


def metrics_of(spark, d):
    return calibrate.policy_metrics(events_of(spark, d, earlier=True), risk_of(spark, d))


@query(f"WITH RECURSIVE {_METRICS} SELECT * FROM metrics")
def calib_metrics(spark, d):
    return metrics_of(spark, d)


@query(f"WITH RECURSIVE {_METRICS} SELECT * FROM metrics ORDER BY target_met DESC, percent, alerts, reduction DESC, policy LIMIT 1")
def calib_best_policy(spark, d):
    return calibrate.best_policy(metrics_of(spark, d))


_VALIDATION = f"{_replay(_ATTACK_EVENTS)}, seen AS (SELECT policy, session, string_agg(DISTINCT attack_type, ',' ORDER BY attack_type) AS classes, max(CASE WHEN attack_type = expected THEN 1 ELSE 0 END) AS hit, min(CASE WHEN attack_type = expected THEN k END) AS first_row FROM replay WHERE kept = 1 GROUP BY 1, 2), validation AS (SELECT p.policy, s.session, s.expected, coalesce(n.classes, '') AS classes, coalesce(n.hit, 0) AS hit, (n.first_row - s.start_row) * 30 AS delay_s FROM policies p CROSS JOIN (SELECT * FROM sessions WHERE {_GOOD} AND label = 'attack') s LEFT JOIN seen n ON n.policy = p.policy AND n.session = s.session)"


@query(f"WITH {_EARLIER}, {_SESSIONS}, {_VALIDATION} SELECT * FROM validation")
def calib_attack_validation(spark, d):
    return calibrate.attack_validation(events_of(spark, d, earlier=True), sessions_of(spark, d))


@query(f"WITH {_EARLIER}, {_SESSIONS}, {_VALIDATION} SELECT policy, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS expected_sessions, {rounded('sum(hit) * 1e2 / count(*)', 2)} AS recall FROM validation GROUP BY 1")
def calib_recall(spark, d):
    events = events_of(spark, d, earlier=True)
    return calibrate.readiness(calibrate.attack_validation(events, sessions_of(spark, d)), metrics_of(spark, d)).select("policy", "hits", "expected_sessions", "recall")


@query(f"WITH {_EARLIER}, {_SESSIONS}, {_VALIDATION}, m AS (WITH RECURSIVE {_METRICS} SELECT policy, target_met FROM metrics), r AS (SELECT policy, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS expected_sessions FROM validation GROUP BY 1) SELECT policy, hits, expected_sessions, floor(hits * 1e4 / expected_sessions + 0.5) / 1e2 AS recall, coalesce(target_met, 0) AS target_met, CASE WHEN hits = expected_sessions AND target_met = 1 THEN 1 ELSE 0 END AS ready, concat_ws(',', CASE WHEN hits < expected_sessions THEN 'missed sessions' END, CASE WHEN coalesce(target_met, 0) = 0 THEN 'targets not met' END) AS reasons FROM r LEFT JOIN m USING (policy)")
def calib_readiness(spark, d):
    events = events_of(spark, d, earlier=True)
    return calibrate.readiness(calibrate.attack_validation(events, sessions_of(spark, d)), calibrate.policy_metrics(events, risk_of(spark, d)))


@query(f"WITH {o.RISK_ROWS}, {o.PORTS}, {o.events('events_')}, {o.events('earlier', (), True)} SELECT c.src_ip, c.k, e.attack_type AS earlier_type, c.attack_type AS current_type, CASE WHEN e.attack_type = c.attack_type THEN 1 ELSE 0 END AS same FROM events_ c JOIN earlier e ON e.src_ip = c.src_ip AND e.k = c.k")
def calib_reproduction(spark, d):
    return calibrate.compared(events_of(spark, d, earlier=True), events_of(spark, d))


@query(f"""WITH {_EARLIER}, {_SESSIONS}, fc AS (SELECT * FROM events_ WHERE attack_type = 'FAILED_CONNECTION_PATTERN'), {_replay('fc')}, s AS (SELECT src_ip, count(*) AS n, sum(CASE WHEN connections_30s < 5 THEN 1 ELSE 0 END) AS small, max(persistence) AS p FROM per GROUP BY 1), t AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, CAST(coalesce(sum(small), 0) AS BIGINT) AS small, CAST(coalesce(max(n), 0) AS BIGINT) AS largest_source, CAST(coalesce(max(p), 0) AS BIGINT) AS longest FROM s)
SELECT *, concat_ws(',', CASE WHEN rows > 0 AND small * 2 >= rows THEN 'small denominators' END, CASE WHEN rows > 0 AND largest_source * 10 >= rows * 7 THEN 'one source' END, CASE WHEN longest >= 3 THEN 'persistent' END) AS causes FROM t""")
def calib_failed_analysis(spark, d):
    return calibrate.failed_analysis(events_of(spark, d, earlier=True))


# Routing

_ROUTED = f"{o.EVENTS}, routed AS (SELECT *, {DECISION} AS decision FROM events_)"


@query(f"WITH {_ROUTED} SELECT src_ip, k, decision FROM routed")
def route_decisions(spark, d):
    return calibrate.routed(events_of(spark, d)).select("src_ip", "k", "decision")


@query(f"WITH {_ROUTED} SELECT src_ip, k, sha256(concat_ws('|', CAST(ts_us AS VARCHAR), src_ip, attack_type, printf('%.4f', confidence), printf('%.4f', risk_score))) AS fingerprint FROM routed")
def route_fingerprints(spark, d):
    return calibrate.routed(events_of(spark, d)).select("src_ip", "k", "fingerprint")


@query(f"WITH {_ROUTED} SELECT src_ip, k FROM routed WHERE k % 3 <> 0")
def route_unsent(spark, d):
    routed = calibrate.routed(events_of(spark, d))
    return calibrate.unsent(routed, routed.filter("k % 3 = 0")).select("src_ip", "k")


@query(f"WITH {_ROUTED} SELECT decision, CASE WHEN decision = 'actionable' THEN 'baselined' ELSE 'reviewed' END AS state, count(*) AS n FROM routed GROUP BY 1, 2")
def route_primed(spark, d):
    routed = calibrate.routed(events_of(spark, d))
    return calibrate.primed(routed).join(routed.select("fingerprint", "decision"), "fingerprint").groupBy("decision", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_ROUTED}, act AS (SELECT src_ip, attack_type, ts_us, k, CAST(risk_score AS DOUBLE) AS risk_score, row_number() OVER (PARTITION BY src_ip, attack_type ORDER BY ts_us, k) AS place FROM routed WHERE decision = 'actionable'),
sent AS (SELECT * FROM act WHERE place = 1 UNION ALL SELECT a.* FROM (SELECT s.src_ip, s.attack_type, min(n.place) AS place FROM sent s JOIN act n ON n.src_ip = s.src_ip AND n.attack_type = s.attack_type AND n.place > s.place AND (n.ts_us >= s.ts_us + 600000000 OR n.risk_score >= s.risk_score + 10) GROUP BY s.src_ip, s.attack_type, s.place) x JOIN act a ON a.src_ip = x.src_ip AND a.attack_type = x.attack_type AND a.place = x.place)
SELECT src_ip, attack_type, ts_us, k, risk_score FROM sent""")
def route_due(spark, d):
    return calibrate.due_alerts(calibrate.routed(events_of(spark, d)))


@query()
def route_payloads(spark, d):
    return calibrate.payloads(events_of(spark, d)).select("src_ip", "k", "message")


# Models


@query(f"WITH {o.WINDOWS}, a AS (SELECT * FROM windows WHERE connections_5m > 0) {' UNION ALL '.join(f'''SELECT '{c}' AS feature, {rounded(f'quantile_cont({c}, 0.5)', 6)} AS median, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1e0 ELSE {rounded(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)', 6)} END AS iqr FROM a''' for c in anomaly.FEATURES)}")
def anomaly_scale(spark, d):
    return anomaly.scaling(windows.window_features(flows(spark, d))).selectExpr("feature", f"{rounded('median', 6)} AS median", f"{rounded('iqr', 6)} AS iqr")


def stored_fit(spark, d):
    """A model of the earlier half of the windows' time, stored and loaded again."""
    rows = windows.window_features(flows(spark, d))
    half = rows.agg(F.floor((F.min("ts_us") + F.max("ts_us")) / 2).alias("half"))
    return stored_model.fit(rows.join(F.broadcast(half), F.col("ts_us") <= F.col("half")), shared_path(spark, "model"), "first")  # half has one row


def scores_of(spark, d, model=None):
    return stored_model.raw_of(windows.window_features(flows(spark, d)), model or stored_fit(spark, d))


def adjusted_scores(spark, d):
    """Scores between the fit's limits, above each source's own if_p999, or above the global limit for sources with too few windows."""
    model = stored_fit(spark, d)
    found = durable(anomaly.normalised(scores_of(spark, d, model), model.limits.select("low", "high")))
    return anomaly.adjusted(found, baselines.with_score_limits(baselines.profiles(flows(spark, d)), found))


@query()
def anomaly_score(spark, d):
    return anomaly.contaminated(scores_of(spark, d))


@query()
def anomaly_normalise(spark, d):
    return adjusted_scores(spark, d)


@query()
def risk_with_anomaly(spark, d):
    f = flows(spark, d)
    scores = adjusted_scores(spark, d).select("src_ip", "k", "anomaly_score")
    rows = flagged_windows(spark, d).join(scores, ["src_ip", "k"])
    return risk.risk_rows(baselines.with_thresholds(rows, baselines.profiles(f))).select("src_ip", "k", "anomaly_score", "risk_score", "risk_level")


@query(f"{_FLOWS} SELECT src_ip, (ts_us // 30000000 + 1) * 30 AS window_end, count(*) AS connections, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS ips, {rounded(f'sum(CASE WHEN {_F} THEN 1 ELSE 0 END) * 1e0 / count(*)', 4)} AS failed_rate FROM clean GROUP BY 1, 2")
def stream_window_counts(spark, d):
    out = live.window_counts(flows(spark, d).withColumn("ts", F.timestamp_micros("ts_us")))
    return out.select("src_ip", F.unix_seconds("window_end").alias("window_end"), "connections", F.col("ports").cast("long").alias("ports"), F.col("ips").cast("long").alias("ips"), "failed_rate")


from flowsentry.plans import check_queries, evidence_queries, feature_queries, live_queries, manifest_queries, model_queries, report_queries  # noqa: E402, F401  add their queries
