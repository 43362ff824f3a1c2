"""Full feature vectors of connections and of the whole network's windows, with SQL written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.expressions import HORIZONS
from flowsentry.operators import features, windows
from flowsentry.plans import oracle as o
from flowsentry.plans.queries import _FLOWS, query
from flowsentry.sources.flows import flows

#: Packet measures that the events table has not, made from it; some are null.
_MADE = {"orig_pkts": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE orig_bytes {div} 60 END", "resp_pkts": "resp_bytes {div} 90", "orig_ip_bytes": "orig_bytes + 40", "resp_ip_bytes": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE resp_bytes + 40 END", "missed_bytes": "event_id % 3"}


@query(f"""{_FLOWS}, m AS (SELECT *, {', '.join(f'CAST({e.format(div="//")} AS BIGINT) AS {c}' for c, e in _MADE.items())}, make_timestamp(ts_us) AS tm FROM f)
SELECT event_id, ts_us, src_ip, dst_ip, coalesce(duration, 0) AS duration, coalesce(orig_bytes, 0) AS orig_bytes, coalesce(resp_bytes, 0) AS resp_bytes, coalesce(orig_pkts, 0) AS orig_pkts, coalesce(resp_pkts, 0) AS resp_pkts, coalesce(orig_ip_bytes, 0) AS orig_ip_bytes,
coalesce(resp_ip_bytes, 0) AS resp_ip_bytes, coalesce(missed_bytes, 0) AS missed_bytes, coalesce(dst_port, 0) AS dst_port, floor(resp_bytes * 1e0 / (orig_bytes + 1) * 1e6 + 0.5) / 1e6 AS bytes_ratio, floor(resp_pkts * 1e0 / (orig_pkts + 1) * 1e6 + 0.5) / 1e6 AS pkts_ratio,
floor(orig_bytes * 1e0 / (orig_pkts + 1) * 1e6 + 0.5) / 1e6 AS avg_orig_pkt_size, floor(resp_bytes * 1e0 / (resp_pkts + 1) * 1e6 + 0.5) / 1e6 AS avg_resp_pkt_size, CAST(proto = 'tcp' AS INTEGER) AS proto_tcp, CAST(proto = 'udp' AS INTEGER) AS proto_udp, CAST(proto = 'icmp' AS INTEGER) AS proto_icmp,
CAST(conn_state = 'S0' AS INTEGER) AS conn_state_S0, CAST(conn_state = 'SF' AS INTEGER) AS conn_state_SF, CAST(conn_state = 'REJ' AS INTEGER) AS conn_state_REJ, CAST(conn_state = 'OTH' AS INTEGER) AS conn_state_OTH, CAST(coalesce(dst_port, 0) < 1024 AS INTEGER) AS is_well_known_port,
CAST(dst_port = 80 AS INTEGER) AS is_http, CAST(dst_port = 443 AS INTEGER) AS is_https, CAST(dst_port = 53 AS INTEGER) AS is_dns, CAST(dst_port = 22 AS INTEGER) AS is_ssh, CAST(NOT starts_with(dst_ip, '192.168.') AS INTEGER) AS is_external, hour(tm) AS hour_of_day, (dayofweek(tm) + 6) % 7 AS day_of_week, CAST(hour(tm) < 6 AS INTEGER) AS is_night FROM m""")
def features_vector(spark, d):
    found = features.connection_vector(flows(spark, d).selectExpr("*", *[f"CAST({e.format(div='DIV')} AS BIGINT) AS {c}" for c, e in _MADE.items()]))
    ratios = ("bytes_ratio", *features.PACKETS)
    return found.select(*[F.expr(f"floor({c} * 1e6 + 5e-1) / 1e6").alias(c) if c in ratios else F.col(c) for c in found.columns])


_NETWORK = ", ".join([o.FLOWS_SQL, o.CLEAN.replace("SELECT *", "SELECT * REPLACE ('network' AS src_ip)", 1), "ends AS (SELECT 'network' AS src_ip, min(ts_us) + 300000000 AS t0, max(ts_us) AS b FROM flows)", o.GRID, *(o._horizon(h, m) for h, m in HORIZONS.items())]) + o.WINDOWS[o.WINDOWS.index(",\nzeroed AS"):]


@query(f"WITH {_NETWORK} SELECT * EXCLUDE (src_ip) FROM flagged")
def windows_network_features(spark, d):
    return windows.network_features(flows(spark, d))
