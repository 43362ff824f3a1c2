"""Scalar rules as SQL expressions that Spark and ANSI engines read alike.

Numbers with an exponent are doubles; plain decimals stay exact. Rounding is floor(x * 10^n + 0.5) / 10^n.
"""

from __future__ import annotations

STEP_US, SECOND_US = 30_000_000, 1_000_000
#: Horizon name -> steps.
HORIZONS = {"30s": 1, "1m": 2, "5m": 10}

# Fixed values.
NOISE_IPS = ("224.0.0.251", "224.0.0.1", "192.168.68.255", "192.168.1.255", "255.255.255.255", "ff02::fb", "ff02::1:3", "ff02::1", "ff02::2", "ff02::16")
NOISE_PORTS = (137, 138, 139, 5353, 1900, 5355)
SENSITIVE_PORTS = (21, 22, 23, 25, 80, 443, 445, 1433, 3306, 3389, 8080)
CLASSES = ("DOS_LIKE_BURST", "PORT_SCAN", "SSH_BRUTE_FORCE_OR_LOGIN_PATTERN", "FAILED_CONNECTION_PATTERN", "DNS_ANOMALY", "BOT_LIKE_BEHAVIOR", "UNKNOWN_SUSPICIOUS", "LOW_SIGNAL_REVIEW")
GLOBAL_THRESHOLDS = {"connections": 35.0, "ports": 5.0, "entropy": 0.115, "burst": 0.287, "dns": 2.117}
TRUSTED = ("192.168.50.12",)


def rounded(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 5e-1) / 1e{n})"


def is_noise(dst: str = "dst_ip", port: str = "dst_port") -> str:
    return f"(coalesce({dst}, '') IN ({', '.join(repr(x) for x in NOISE_IPS)}) OR coalesce({port}, -1) IN ({', '.join(map(str, NOISE_PORTS))}))"


def is_local(ip: str) -> str:
    return f"({ip} LIKE '192.168.%')"


#: Flags over window features.
FLAGS = {
    "flag_port_scan": "CASE WHEN unique_dst_ports_30s > 15 THEN 1 ELSE 0 END",
    "flag_brute_force": "CASE WHEN failed_conn_rate_1m * connections_1m / greatest(unique_dst_ips_1m, 1) > 15 AND unique_dst_ips_1m <= 3 AND unique_dst_ports_1m > 1 THEN 1 ELSE 0 END",
    "flag_burst": "CASE WHEN connections_30s > 90 THEN 1 ELSE 0 END",
    "flag_dns_flood": "CASE WHEN dns_rate_1m * 60 > 120 THEN 1 ELSE 0 END",
}
FLAG_ANY = "greatest(flag_port_scan, flag_brute_force, flag_burst, flag_dns_flood)"

#: Scores over flagged windows with thresholds thr_* and an anomaly_score.
SCORES = {
    "score_scan": rounded("least(least(unique_dst_ports_30s / greatest(thr_ports * 3e0, 1e0), 1e0) * 5e-1 + least(port_entropy_30s / greatest(thr_entropy * 3e0, 1e-3), 1e0) * 3e-1 + flag_port_scan * 2e-1, 1e0)", 4),
    "score_burst": rounded("least(least(burst_score_30s / greatest(thr_burst * 3e0, 1e-3), 1e0) * 5e-1 + least(connections_30s / greatest(thr_connections * 3e0, 1e0), 1e0) * 3e-1 + flag_burst * 2e-1, 1e0)", 4),
    "score_dns": rounded("least(least(dns_rate_1m * 6e1 / greatest(thr_dns * 6e0, 1e0), 1e0) * 7e-1 + flag_dns_flood * 3e-1, 1e0)", 4),
    "score_external": rounded("CASE WHEN outbound_ratio_30s < 95e-2 THEN 0e0 ELSE least((outbound_ratio_30s - 95e-2) / 5e-2, 1e0) END", 4),
}
COMPONENTS = {f"component_{k}": rounded(f"{w}e0 * {s}", 2) for k, w, s in (("anomaly", 35, "anomaly_score"), ("scan", 30, "score_scan"), ("burst", 20, "score_burst"), ("dns", 15, "score_dns"), ("external", 0, "score_external"))}
RISK = rounded("least(35e0 * anomaly_score + 30e0 * score_scan + 20e0 * score_burst + 15e0 * score_dns, 1e2)", 2)
LEVEL = "CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'ALERT' WHEN risk_score >= 30 THEN 'INVESTIGATE' ELSE 'NORMAL' END"
LEVELS = ("CRITICAL", "ALERT", "INVESTIGATE", "NORMAL")

#: Rows worth classifying.
SUSPICIOUS = "(coalesce(risk_score, 0e0) >= 20 OR coalesce(anomaly_score, 0e0) >= 35e-2 OR coalesce(failed_conn_rate_30s, 0e0) >= 8e-1 OR coalesce(connections_30s, 0) >= 80 OR coalesce(dns_rate_30s, 0e0) >= 1)"


def _count(*conditions: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions) + ")"


def _confidence(base: str, n: str, cap: str) -> str:
    return f"least({cap}, {base} + 0.04 * least({n}, 5))"


_SSH = "(coalesce(ctx_port, '') = '22' OR coalesce(ctx_service, '') LIKE '%ssh%')"
_RISKY = "(risk_score >= 20 OR anomaly_score >= 35e-2)"
#: Class -> (condition, conditions behind its reasons, base, cap); in the order in which ties are decided.
RULES = {
    "DOS_LIKE_BURST": ("n_reasons > 0", ("flag_burst = 1", "connections_30s >= 120 AND risk_score >= 20", f"burst_score_30s >= 8e-1 AND {_RISKY}", f"bytes_per_sec_30s >= 100000 AND {_RISKY}"), "0.58", "0.86"),
    "PORT_SCAN": ("flag_port_scan = 1 AND (unique_dst_ports_30s >= 20 OR unique_dst_ports_1m >= 20)", ("flag_port_scan = 1", "unique_dst_ports_30s >= 20", "unique_dst_ports_1m >= 20", "connections_30s >= 80 AND failed_conn_rate_30s >= 3e-1", "risk_score >= 30 AND connections_30s >= 50"), "0.58", "0.90"),
    "SSH_BRUTE_FORCE_OR_LOGIN_PATTERN": (f"{_SSH} AND failed_conn_rate_30s >= 8e-1 AND connections_30s >= 20 AND {_RISKY}", (_SSH, "flag_brute_force = 1", "failed_conn_rate_30s >= 8e-1", "connections_30s >= 20", "risk_score >= 20", "anomaly_score >= 35e-2", "repeated >= 5"), "0.62", "0.88"),
    "FAILED_CONNECTION_PATTERN": (f"NOT {_SSH} AND failed_conn_rate_30s >= 8e-1 AND (connections_30s >= 10 OR repeated >= 5 OR flag_brute_force = 1)", ("failed_conn_rate_30s >= 8e-1", "connections_30s >= 10", "repeated >= 5", "flag_brute_force = 1"), "0.44", "0.72"),
    "DNS_ANOMALY": ("dns_rate_30s >= 1", ("flag_dns_flood = 1", "dns_rate_30s >= 1", "anomaly_score >= 35e-2", "risk_score >= 20"), "0.55", "0.86"),
}
_BOT = ("anomaly_score >= 35e-2", "repeated >= 3", "risk_score >= 20", "failed_conn_rate_30s >= 5e-1", "connections_30s >= 30")
#: Scan rule of the earlier policy, for replay.
EARLIER_SCAN = "(flag_port_scan = 1 OR ((unique_dst_ports_30s >= 10 OR unique_dst_ips_30s >= 10) AND (connections_30s >= 50 OR failed_conn_rate_30s >= 3e-1 OR risk_score >= 20)))"
_TEXTS = {
    "flag_burst = 1": "flag_burst",
    "flag_port_scan = 1": "flag_port_scan",
    "flag_brute_force = 1": "flag_brute_force",
    "flag_dns_flood = 1": "flag_dns_flood",
    "connections_30s >= 120 AND risk_score >= 20": "connections with risk",
    f"burst_score_30s >= 8e-1 AND {_RISKY}": "burst with support",
    f"bytes_per_sec_30s >= 100000 AND {_RISKY}": "bytes with support",
    "unique_dst_ports_30s >= 20": "ports in 30s",
    "unique_dst_ports_1m >= 20": "ports in 1m",
    "connections_30s >= 80 AND failed_conn_rate_30s >= 3e-1": "connections with failures",
    "risk_score >= 30 AND connections_30s >= 50": "risk with connections",
    _SSH: "ssh evidence",
    "failed_conn_rate_30s >= 8e-1": "failed rate",
    "failed_conn_rate_30s >= 5e-1": "failed rate",
    "connections_30s >= 10": "connections",
    "connections_30s >= 20": "connections",
    "connections_30s >= 30": "connections",
    "risk_score >= 20": "risk",
    "risk_score >= 30": "risk",
    "anomaly_score >= 35e-2": "anomaly",
    "repeated >= 3": "repeated source",
    "repeated >= 5": "repeated source",
    "dns_rate_30s >= 1": "dns rate",
}


def reason_texts(conditions: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(c, _TEXTS[c]) for c in conditions]


def classification(earlier: bool = False, trusted: tuple[str, ...] = ()) -> dict[str, str]:
    """Columns to add to suspicious rows, in dependency order: n_<k> and conf_<k> of each class, attack_type, confidence."""
    out: dict[str, str] = {}
    is_trusted = f"src_ip IN ({', '.join(repr(x) for x in trusted)})" if trusted else "1 = 0"
    for i, (name, (condition, reasons, base, cap)) in enumerate(RULES.items()):
        n = _count(*reasons)
        if earlier and name == "PORT_SCAN":
            condition = EARLIER_SCAN
        conf, marked = _confidence(base, n, cap), "1 = 0"
        if name == "SSH_BRUTE_FORCE_OR_LOGIN_PATTERN":
            conf = f"CASE WHEN {is_trusted} AND NOT (failed_conn_rate_30s >= 95e-2 AND connections_30s >= 50 AND risk_score >= 30) THEN greatest(0.35, {conf} - 0.12) ELSE {conf} END"
        elif name == "FAILED_CONNECTION_PATTERN":
            conf = f"CASE WHEN {is_trusted} THEN greatest(0.25, {conf} - 0.10) ELSE {conf} END"
            marked = is_trusted
        if name == "SSH_BRUTE_FORCE_OR_LOGIN_PATTERN":
            marked = f"{is_trusted} AND NOT (failed_conn_rate_30s >= 95e-2 AND connections_30s >= 50 AND risk_score >= 30)"
        # That a source is trusted is a reason more, for ties.
        out[f"n_{i}"] = n if not trusted or marked == "1 = 0" else f"({n} + CASE WHEN {marked} THEN 1 ELSE 0 END)"
        out[f"conf_{i}"] = f"CASE WHEN {condition.replace('n_reasons', n)} THEN CAST({conf} AS DOUBLE) END"
    clear = " AND ".join(f"conf_{i} IS NULL" for i in range(5))
    out["n_5"] = _count(*_BOT)
    out["conf_5"] = f"CASE WHEN n_5 >= 3 AND {clear} THEN CAST({_confidence('0.44', 'n_5', '0.74')} AS DOUBLE) END"
    # Highest confidence, then most reasons, then the first rule.
    rank = {i: f"coalesce(conf_{i}, -1e0) * 1000 + n_{i} - {i} * 1e-2" for i in range(6)}
    best = f"greatest({', '.join(rank.values())})"
    unknown = "(risk_score >= 30 OR anomaly_score >= 35e-2)"
    low = "1 + " + _count("risk_score >= 20 AND risk_score < 30")
    none = " AND ".join(f"conf_{i} IS NULL" for i in range(6))
    out["attack_type"] = f"CASE WHEN {none} THEN CASE WHEN {unknown} THEN 'UNKNOWN_SUSPICIOUS' ELSE 'LOW_SIGNAL_REVIEW' END " + " ".join(f"WHEN {best} = {rank[i]} THEN '{CLASSES[i]}'" for i in range(6)) + " END"
    lone = f"CASE WHEN {unknown} THEN {_confidence('0.42', _count('risk_score >= 30', 'anomaly_score >= 35e-2'), '0.62')} ELSE {_confidence('0.25', low, '0.49')} END"
    lone = f"CASE WHEN {is_trusted} THEN greatest(0.25, {lone} - 0.05) ELSE {lone} END"
    out["confidence"] = f"CASE WHEN {none} THEN CAST({lone} AS DOUBLE) ELSE greatest({', '.join(f'coalesce(conf_{i}, 0e0)' for i in range(6))}) END"
    return out


#: Decision of alert routing, in order; evidence that is missing or not a count fails closed.
def _count_ok(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} >= 0)"


ACTIONABLE = f"(attack_type = 'PORT_SCAN' AND flag_port_scan = 1 AND (({_count_ok('unique_dst_ports_30s')} AND unique_dst_ports_30s >= 20) OR ({_count_ok('unique_dst_ports_1m')} AND unique_dst_ports_1m >= 20)))"
DECISION = f"CASE WHEN attack_type IS NULL THEN 'missing class' WHEN attack_type <> 'PORT_SCAN' THEN 'not an actionable class' WHEN coalesce(flag_port_scan, 0) <> 1 THEN 'flag not set' WHEN NOT {_count_ok('unique_dst_ports_30s')} AND NOT {_count_ok('unique_dst_ports_1m')} THEN 'evidence missing' WHEN {ACTIONABLE} THEN 'actionable' ELSE 'below threshold' END"
