"""Streams over the events table, run to its end, with SQL written out by hand: each row as of its own time, up to the watermark."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import baselines, features
from flowsentry.plans import oracle as o
from flowsentry.plans.queries import _LEVELS, _SCANS, _cooled, logins, query
from flowsentry.sources.flows import flows, live_flows
from flowsentry.sources.tables import shared_path
from flowsentry.streaming import keyed, runs
from flowsentry.streaming import risk as live_risk
from flowsentry.streaming import windows as live_windows
from flowsentry.streaming import state as live_state


def _mark(table: str, shift: int = 0) -> str:
    return f"(SELECT (max(ts_us) - {shift}) // 1000 * 1000 - 60000000 FROM {table})"


_STATE = f"""WITH {o.FLOWS_SQL}, {o.CLEAN}, ticks AS (SELECT unnest(range(600000000, {_mark('clean', 1)} + 1, 600000000)) AS tick_us),
seen AS (SELECT c.*, t.tick_us, t.tick_us + 1 - c.ts_us AS age, CASE WHEN conn_state IN ('S0', 'REJ') THEN 1 ELSE 0 END AS failed FROM clean c JOIN ticks t ON c.ts_us <= t.tick_us AND t.tick_us + 1 - c.ts_us <= 86400000000),
v AS (SELECT tick_us, dst_ip AS host, count(DISTINCT CASE WHEN age <= 30000000 THEN dst_port END) AS p1, count(DISTINCT CASE WHEN age <= 300000000 THEN dst_port END) AS p2, count(DISTINCT CASE WHEN age <= 3600000000 THEN dst_port END) AS p3,
  sum(CASE WHEN age <= 30000000 THEN failed ELSE 0 END) AS f1, sum(CASE WHEN age <= 300000000 THEN failed ELSE 0 END) AS f2, sum(CASE WHEN age <= 3600000000 THEN failed ELSE 0 END) AS f3,
  sum(CASE WHEN dst_port = 22 AND age <= 300000000 THEN failed ELSE 0 END) AS s2, sum(CASE WHEN dst_port = 22 AND age <= 3600000000 THEN failed ELSE 0 END) AS s3,
  max(CASE WHEN dst_port IN (21, 22, 23, 25, 80, 443, 445, 1433, 3306, 3389, 8080) THEN 1.3e0 ELSE 1e0 END) AS more FROM seen WHERE dst_ip LIKE '192.168.%' GROUP BY 1, 2),
vs AS (SELECT tick_us, host, least(greatest(CASE WHEN p1 >= 5 THEN least(p1 / 50e0, 1e0) ELSE 0e0 END, CASE WHEN p2 >= 10 THEN least(p2 / 100e0, 1e0) ELSE 0e0 END, CASE WHEN p3 >= 20 THEN least(p3 / 200e0, 1e0) ELSE 0e0 END) * more, 1e0) AS scan,
  greatest(CASE WHEN f1 >= 10 THEN least(f1 / 50e0, 1e0) ELSE 0e0 END, CASE WHEN f2 >= 20 THEN least(f2 / 100e0, 1e0) ELSE 0e0 END, CASE WHEN f3 >= 40 THEN least(f3 / 200e0, 1e0) ELSE 0e0 END) AS fail,
  greatest(CASE WHEN s2 >= 5 THEN least(s2 / 20e0, 1e0) ELSE 0e0 END, CASE WHEN s3 >= 15 THEN least(s3 / 50e0, 1e0) ELSE 0e0 END) AS ssh FROM v),
s AS (SELECT tick_us, src_ip AS host, sum(CASE WHEN dst_port = 53 AND age <= 3600000000 THEN 1 ELSE 0 END) AS dns, sum(CASE WHEN dst_port <> 53 AND conn_state = 'SF' THEN 1 ELSE 0 END) AS good,
  count(DISTINCT CASE WHEN dst_ip NOT LIKE '192.168.%' THEN dst_ip END) AS outer_ips, count(DISTINCT CASE WHEN dst_ip LIKE '192.168.%' THEN dst_ip END) AS inner_ips FROM seen WHERE src_ip LIKE '192.168.%' AND dst_ip <> src_ip GROUP BY 1, 2),
ss AS (SELECT tick_us, host, CASE WHEN dns >= 50 AND good <= 10 THEN least(dns / 200e0, 1e0) ELSE 0e0 END AS recon, CASE WHEN outer_ips >= 15 THEN least(outer_ips / 50e0, 1e0) ELSE 0e0 END AS ext, CASE WHEN inner_ips >= 4 THEN least(inner_ips / 10e0, 1e0) ELSE 0e0 END AS sideways FROM s),
both_roles AS (SELECT tick_us, host, 'victim' AS role, floor(least(0.5e0 * scan + 0.4e0 * fail + 0.45e0 * ssh, 1e0) * 1e4 + 0.5e0) / 1e4 AS state_risk, concat_ws(',', CASE WHEN scan > 0 THEN 'scan' END, CASE WHEN fail > 0 THEN 'fail' END, CASE WHEN ssh > 0 THEN 'ssh' END) AS patterns FROM vs
  UNION ALL SELECT tick_us, host, 'outbound', floor(least(0.2e0 * recon + 0.25e0 * ext + 0.35e0 * sideways, 1e0) * 1e4 + 0.5e0) / 1e4, concat_ws(',', CASE WHEN recon > 0 THEN 'recon' END, CASE WHEN ext > 0 THEN 'external' END, CASE WHEN sideways > 0 THEN 'lateral' END) FROM ss)
SELECT * FROM both_roles WHERE state_risk > 0"""


@query(_STATE)
def stream_state_risk(spark, d):
    return runs.run_to_end(live_state.live_state(live_flows(spark, d), every=600))


@query(f"{_LEVELS} SELECT * FROM levels WHERE ts_us < {_mark('logins')}")
def stream_auth_levels(spark, d):
    return runs.run_to_end(keyed.live_levels(logins(live_flows(spark, d))))


@query(f"{_cooled(_SCANS, 'scans', 'src_ip', 30_000_000)} WHERE ts_us < {_mark('clean')}")
def stream_perimeter_alerts(spark, d):
    return runs.run_to_end(keyed.perimeter_alerts(features.without_noise(live_flows(spark, d)))).drop("ports")


_TENTH = "tenth AS (SELECT src_ip, max(ts_us) AS tenth, (SELECT max(ts_us) FROM flows f WHERE f.src_ip = r.src_ip) AS last FROM (SELECT src_ip, ts_us, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, event_id) AS place FROM flows) r WHERE place <= 10 GROUP BY 1)"


@query(f"WITH {o.WINDOWS}, {_TENTH} SELECT w.* FROM windows w JOIN tenth USING (src_ip) WHERE w.ts_us > tenth AND w.ts_us <= {_mark('flows')} AND w.ts_us <= last + 30000000")
def stream_windows(spark, d):
    """All window features live. The stream also writes up to five minutes of empty windows after a source's last flow, which the batch's grid has not: those go here."""
    f = flows(spark, d).groupBy("src_ip").agg((F.max("ts_us") + 30_000_000).alias("end"))
    return runs.run_to_end(live_windows.live_windows(live_flows(spark, d))).join(f, "src_ip").filter("ts_us <= end").drop("end")


@query(f"WITH {o.RISK_ROWS}, {_TENTH} SELECT r.src_ip, r.k, r.risk_score, r.risk_level FROM risk r JOIN tenth USING (src_ip) WHERE r.ts_us > tenth AND r.ts_us <= {_mark('flows')} AND r.ts_us <= last + 30000000")
def stream_risk(spark, d):
    """Live windows scored by published baselines; empty windows after a source's last flow go, as in stream_windows."""
    folder, table = shared_path(spark, "baselines"), shared_path(spark, "live-risk")
    live_risk.publish(baselines.profiles(flows(spark, d)), folder, 1)
    live_risk.run_live_risk(live_windows.live_windows(live_flows(spark, d)), folder, table, shared_path(spark, "stream-checkpoint"))
    ends = flows(spark, d).groupBy("src_ip").agg((F.max("ts_us") + 30_000_000).alias("end"))
    return spark.read.parquet(table).join(ends, "src_ip").filter("ts_us <= end").select("src_ip", "k", "risk_score", "risk_level")
