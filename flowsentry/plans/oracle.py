"""The queries' results as ANSI SQL over the same tables, written from definitions (windows by range joins)."""

from __future__ import annotations

from flowsentry.functions.expressions import COMPONENTS, FLAG_ANY, FLAGS, HORIZONS, LEVEL, RISK, SCORES, SUSPICIOUS, classification, is_noise, rounded
from flowsentry.operators.baselines import LOOKUP, PERCENTILES
from flowsentry.operators.windows import features
from flowsentry.sources.flows import FLOWS_SQL

CLEAN = f"clean AS (SELECT * FROM flows WHERE NOT {is_noise()})"
ENDS = "ends AS (SELECT src_ip, min(ts_us) + least(30000000, greatest(max(ts_us) - min(ts_us), 1000000)) AS t0, max(ts_us) AS b FROM flows WHERE src_ip LIKE '192.168.%' GROUP BY src_ip HAVING count(*) >= 10)"
GRID = "grid AS (SELECT src_ip, k, t0 + k * 30000000 AS ts_us FROM (SELECT src_ip, t0, unnest(range(0, CAST(floor((b + 30000000 - t0) / 30000000) AS BIGINT) + 1)) AS k FROM ends) g)"


def _horizon(h: str, m: int) -> str:
    w = m * 30_000_000
    return f"""
in_{h} AS (SELECT g.src_ip, g.k, f.event_id, f.dst_port, f.dst_ip, f.conn_state, f.orig_bytes, f.resp_bytes, f.duration, (f.ts_us - lag(f.ts_us) OVER (PARTITION BY g.src_ip, g.k ORDER BY f.ts_us, f.event_id)) / 1e6 AS gap
  FROM grid g JOIN clean f ON f.src_ip = g.src_ip AND f.ts_us >= g.ts_us - {w} AND f.ts_us < g.ts_us),
port_{h} AS (SELECT src_ip, k, sum(c * log2(c)) AS plogp FROM (SELECT src_ip, k, dst_port, count(*) AS c FROM in_{h} GROUP BY 1, 2, 3) p GROUP BY 1, 2),
sum_{h} AS (SELECT src_ip, k, count(*) AS n_{h}, sum(CASE WHEN conn_state IN ('REJ', 'S0') THEN 1 ELSE 0 END) AS failed_{h}, sum(CASE WHEN dst_port = 53 THEN 1 ELSE 0 END) AS dns_{h}, sum(CASE WHEN dst_ip LIKE '192.168.%' THEN 0 ELSE 1 END) AS external_{h},
  sum(orig_bytes + resp_bytes) AS bytes_{h}, sum(duration) AS duration_{h}, count(gap) AS gaps_{h}, coalesce(sum(gap), 0) AS gap_sum_{h}, coalesce(sum(gap * gap), 0) AS gap_squares_{h}, count(DISTINCT dst_port) AS ports_{h}, count(DISTINCT dst_ip) AS ips_{h} FROM in_{h} GROUP BY 1, 2)"""


_SUMS = ("n", "failed", "dns", "external", "bytes", "duration", "gaps", "gap_sum", "gap_squares", "ports", "ips")
_LEFT = " ".join(f"LEFT JOIN sum_{h} USING (src_ip, k) LEFT JOIN port_{h} ON port_{h}.src_ip = grid.src_ip AND port_{h}.k = grid.k" for h in HORIZONS)
_ZERO = ", ".join([*(f"coalesce({c}_{h}, 0) AS {c}_{h}" for h in HORIZONS for c in _SUMS), *(f"coalesce(port_{h}.plogp, 0) AS plogp_{h}" for h in HORIZONS)])
WINDOWS = ", ".join([FLOWS_SQL, CLEAN, ENDS, GRID, *(_horizon(h, m) for h, m in HORIZONS.items())]) + f""",
zeroed AS (SELECT grid.src_ip AS src_ip, grid.k AS k, grid.ts_us AS ts_us, {_ZERO} FROM grid {_LEFT}),
windows AS (SELECT src_ip, k, ts_us, {", ".join(f"{e} AS {c}" for h, m in HORIZONS.items() for c, e in features(h, m * 30).items())} FROM zeroed),
flagged AS (SELECT *, {FLAG_ANY} AS flag_any FROM (SELECT *, {", ".join(f"{e} AS {c}" for c, e in FLAGS.items())} FROM windows) w)"""
BUCKETS = "buckets AS (SELECT src_ip, ts_us // 30000000 AS bucket, count(*) AS n, count(DISTINCT dst_port) AS ports, avg(CASE WHEN dst_ip LIKE '192.168.%' THEN 0e0 ELSE 1e0 END) AS outbound, 2 * sum(CASE WHEN dst_port = 53 THEN 1 ELSE 0 END) AS dns_1m FROM clean GROUP BY 1, 2)"
_Q = ", ".join(f"{rounded(f'quantile_cont({c}, {q})', 6)} AS {s}_{p}" for s, (c, ps) in PERCENTILES.items() for p, q in ps.items())
PROFILES = f"""{BUCKETS},
per_bucket AS (SELECT src_ip, {_Q}, CAST(max(n) AS DOUBLE) AS connections_30s_max, CAST(max(ports) AS DOUBLE) AS unique_dst_ports_30s_max, CAST(max(dns_1m) AS DOUBLE) AS dns_rate_1m_max, {rounded("avg(outbound)", 6)} AS outbound_ratio_30s_mean FROM buckets GROUP BY 1),
per_flow AS (SELECT src_ip, count(*) AS flow_count, {rounded("quantile_cont(orig_bytes, 0.99)", 6)} AS orig_bytes_p99, max(orig_bytes) AS orig_bytes_max, {rounded("quantile_cont(duration, 0.99)", 6)} AS duration_p99 FROM clean GROUP BY 1),
profiles AS (SELECT *, CASE WHEN flow_count >= 500 THEN 1 ELSE 0 END AS use_per_ip, CASE WHEN flow_count < 500 THEN 'flows below 500' END AS reason FROM per_flow JOIN per_bucket USING (src_ip))"""
_STEPS = [SCORES, COMPONENTS, {"risk_score": RISK}, {"risk_level": LEVEL}]


def _layers(source: str, steps: list[dict[str, str]]) -> str:
    for i, step in enumerate(steps):
        source = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM {source} x{i})"
    return source


RISK_ROWS = f"""{WINDOWS}, {PROFILES},
thresholds AS (SELECT f.*, 0e0 AS anomaly_score, {", ".join(f"{e} AS {c}" for c, e in LOOKUP.items())} FROM flagged f LEFT JOIN (SELECT src_ip, use_per_ip, connections_30s_p999, unique_dst_ports_30s_p999, dns_rate_1m_p999 FROM profiles) p USING (src_ip)),
risk AS (SELECT * FROM {_layers("thresholds", _STEPS)} r)"""
PORTS = "source_ports AS (SELECT src_ip, CAST(dst_port AS VARCHAR) AS ctx_port FROM (SELECT src_ip, dst_port, row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_port) AS r FROM flows GROUP BY 1, 2) p WHERE r = 1)"


def events(name: str = "events_", trusted: tuple[str, ...] = (), earlier: bool = False) -> str:
    steps = [{c: e} for c, e in classification(earlier, trusted).items()]
    return f"""{name}base AS (SELECT r.*, ctx_port, CASE WHEN ctx_port = '22' THEN 'ssh' END AS ctx_service, count(*) OVER (PARTITION BY r.src_ip) AS repeated FROM risk r LEFT JOIN source_ports p ON p.src_ip = r.src_ip WHERE {SUSPICIOUS}),
{name} AS (SELECT * FROM {_layers(f"{name}base", steps)} e)"""


EVENTS = f"{RISK_ROWS}, {PORTS}, {events()}"
