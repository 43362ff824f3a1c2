"""Queries of the full check lists, with SQL written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import checks
from flowsentry.plans.evidence_queries import _PREPARED, labelled_flows
from flowsentry.plans.queries import _FLOWS, query
from flowsentry.sources.flows import flows

_HALF_UP = "floor({x} * 1e{n} + 0.5) / 1e{n}"
_GAP = "(SELECT max(g) / 60e6 FROM (SELECT ts_us - lag(ts_us) OVER (ORDER BY ts_us) AS g FROM f) z)"
_BUCKETS = "(SELECT count(*) FROM b WHERE n < 0.1 * (SELECT avg(n) FROM b) AND (SELECT count(*) FROM b) >= 3)"
_INTEGRITY = f"""{_FLOWS}, e AS (SELECT min(ts_us) AS a, max(ts_us) AS z FROM f), b AS (SELECT x.i, count(f.ts_us) AS n FROM (SELECT unnest(range(0, (z - a) // 600000000 + 1)) AS i, a FROM e) x LEFT JOIN f ON (f.ts_us - x.a) // 600000000 = x.i GROUP BY 1),
facts AS (SELECT count(*) AS n, (avg((ts_us IS NULL)::INT) + avg((src_ip IS NULL)::INT) + avg((dst_ip IS NULL)::INT) + avg((dst_port IS NULL)::INT) + avg((duration IS NULL)::INT) + avg((proto IS NULL)::INT) + avg((conn_state IS NULL)::INT)) * 100e0 / 7 AS missing,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT ts_us, src_ip, dst_ip, dst_port FROM f) u) AS repeats, {_GAP} AS gap, (SELECT count(*) FROM (SELECT ts_us - lag(ts_us) OVER (ORDER BY event_id) AS g FROM f) z WHERE g < 0) AS late,
  count(DISTINCT proto) AS kinds, count(DISTINCT dst_ip) AS peers, avg(CASE WHEN coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) = 0 THEN 1e0 ELSE 0e0 END) * 100 AS zero, {_BUCKETS} AS drops FROM f),
found AS (SELECT 'required_columns' AS "check", 0e0 AS value, 'pass' AS outcome FROM facts UNION ALL SELECT 'minimum_records', n, CASE WHEN n < 50 THEN 'warn' ELSE 'pass' END FROM facts UNION ALL SELECT 'missing_values', {_HALF_UP.format(x='missing', n=2)}, CASE WHEN missing > 5 THEN 'warn' ELSE 'pass' END FROM facts
  UNION ALL SELECT 'duplicates', repeats, CASE WHEN repeats * 1e2 / n > 1 THEN 'warn' ELSE 'pass' END FROM facts UNION ALL SELECT 'time_gaps', {_HALF_UP.format(x='gap', n=1)}, CASE WHEN gap > 120 THEN 'warn' WHEN gap > 60 THEN 'info' ELSE 'pass' END FROM facts
  UNION ALL SELECT 'timestamp_order', late, CASE WHEN late > 0 THEN 'warn' ELSE 'pass' END FROM facts UNION ALL SELECT 'protocol_variety', kinds, CASE WHEN kinds < 2 THEN 'warn' ELSE 'pass' END FROM facts UNION ALL SELECT 'ip_variety', peers, CASE WHEN peers < 3 THEN 'warn' ELSE 'pass' END FROM facts
  UNION ALL SELECT 'zero_bytes', {_HALF_UP.format(x='zero', n=1)}, CASE WHEN zero > 80 THEN 'warn' ELSE 'pass' END FROM facts UNION ALL SELECT 'sudden_drop', drops, CASE WHEN drops > 0 THEN 'warn' ELSE 'pass' END FROM facts)"""


@query(f"{_INTEGRITY} SELECT * FROM found")
def quality_integrity_checks(spark, d):
    return checks.integrity_checks(flows(spark, d))


@query(f"{_INTEGRITY}, s AS (SELECT count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE outcome = 'warn') AS warned, count(*) FILTER (WHERE outcome = 'fail') AS failed, count(*) AS checks FROM found) SELECT *, CAST(floor((passed * 10 + warned * 5) / checks + 0.5) AS BIGINT) AS score, CASE WHEN failed > 0 THEN 'fail' WHEN warned > 2 THEN 'warn' ELSE 'pass' END AS status FROM s")
def quality_integrity_summary(spark, d):
    return checks.integrity_summary(checks.integrity_checks(flows(spark, d)))


@query(f"""{_FLOWS}, g AS (SELECT * REPLACE (CAST(proto AS VARCHAR) AS proto), CASE WHEN dst_port = 53 THEN 'dns' WHEN dst_port = 22 THEN 'ssh' ELSE '-' END AS service FROM f),
facts AS (SELECT count(*) AS n, (avg((dst_port IS NULL)::INT) + avg((orig_bytes IS NULL)::INT) + avg((resp_bytes IS NULL)::INT) + avg((duration IS NULL)::INT)) * 25e0 AS missing, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT dst_port, conn_state, orig_bytes, resp_bytes, duration, proto, service FROM g) u)) * 1e2 / count(*) AS repeats,
  count(DISTINCT proto) AS kinds, count(DISTINCT dst_ip) AS peers, {_GAP} AS gap, count(DISTINCT ts_us // 3600000000 % 24) AS hours, avg(CASE WHEN starts_with(dst_ip, '192.168.') THEN 0e0 ELSE 1e0 END) * 100 AS outer_percent FROM g)
SELECT 'quantity' AS "check", CAST(n AS DOUBLE) AS value, CASE WHEN n >= 2000 THEN '100' WHEN n >= 500 THEN '60' ELSE '20' END AS outcome FROM facts UNION ALL SELECT 'missing_values', {_HALF_UP.format(x='missing', n=2)}, CASE WHEN missing <= 2 THEN '100' WHEN missing <= 10 THEN '60' ELSE '20' END FROM facts
UNION ALL SELECT 'repeated_features', {_HALF_UP.format(x='repeats', n=2)}, CASE WHEN repeats <= 2 THEN '100' WHEN repeats <= 5 THEN '60' ELSE '20' END FROM facts UNION ALL SELECT 'protocols', kinds, CASE WHEN kinds >= 3 THEN '100' WHEN kinds >= 2 THEN '60' ELSE '20' END FROM facts
UNION ALL SELECT 'destinations', peers, CASE WHEN peers >= 20 THEN '100' WHEN peers >= 3 THEN '60' ELSE '20' END FROM facts UNION ALL SELECT 'longest_gap', {_HALF_UP.format(x='gap', n=1)}, CASE WHEN gap <= 10 THEN '100' WHEN gap <= 60 THEN '60' ELSE '20' END FROM facts
UNION ALL SELECT 'hours', hours, CASE WHEN hours >= 12 THEN '100' WHEN hours >= 8 THEN '60' ELSE '20' END FROM facts UNION ALL SELECT 'external', {_HALF_UP.format(x='outer_percent', n=1)}, CASE WHEN outer_percent BETWEEN 20 AND 80 THEN '100' WHEN outer_percent > 5 THEN '60' ELSE '20' END FROM facts""")
def quality_daily_grades(spark, d):
    return checks.daily_grades(flows(spark, d))


@query(f"""{_PREPARED}, r AS (SELECT dst_port, CASE WHEN event_id % 9 = 0 THEN NULL ELSE duration END AS duration, CASE WHEN event_id % 101 = 0 THEN CAST('inf' AS DOUBLE) ELSE orig_bytes END AS orig_bytes, label FROM (SELECT event_id, dst_port, CAST(duration AS DOUBLE) AS duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes, (event_id * 7 + dst_port) % 9 AS label FROM flows) q)
SELECT 'sparse_columns' AS "check", CAST((avg((duration IS NULL)::INT) > 0.1)::INT AS DOUBLE) AS value, CASE WHEN avg((duration IS NULL)::INT) > 0.1 THEN '0.5' ELSE '1' END AS outcome FROM r UNION ALL SELECT 'leaky_columns', 1, '0'
UNION ALL SELECT 'repeated_rows', {_HALF_UP.format(x='x', n=2)}, CASE WHEN x >= 1 THEN '0.5' ELSE '1' END FROM (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r) u)) * 1e2 / count(*) AS x FROM r) y UNION ALL SELECT 'infinite_columns', max((orig_bytes = CAST('inf' AS DOUBLE))::INT), CASE WHEN max((orig_bytes = CAST('inf' AS DOUBLE))::INT) > 0 THEN '0.5' ELSE '1' END FROM r""")
def quality_columns(spark, d):
    """Labelled flows with a leaky column, a sparse one and one with infinite values."""
    rows = labelled_flows(spark, d)
    real = lambda c: F.col(c).cast("double")
    return checks.column_quality(rows.select(F.col(" Destination Port"), F.when(F.col("event_id") % 9 != 0, real(" Flow Duration")).alias("duration"), F.when(F.col("event_id") % 101 == 0, F.lit(float("inf"))).otherwise(real("Total Length of Fwd Packets")).alias("orig_bytes"), "` Label`", F.lit(1.0).alias("Flow Bytes/s")))
