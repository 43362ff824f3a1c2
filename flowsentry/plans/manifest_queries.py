"""Queries over a ground-truth manifest that is written from the windows and read back, with SQL by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.expressions import ACTIONABLE
from flowsentry.operators import calibrate, manifest, timelines, windows
from flowsentry.plans import oracle as o
from flowsentry.plans.queries import _replay, events_of, query
from flowsentry.sources.flows import flows, read_manifest
from flowsentry.sources.tables import durable, shared_path

_POLICIES = f"SELECT * FROM (VALUES {', '.join(map(str, calibrate.POLICIES))}) p({', '.join(calibrate.POLICY_COLUMNS)})"
#: Of every twelve sessions: normal ones with even numbers, attacks with odd ones, most with a fault. n is the day's rows.
_SESSIONS = 24


def day_rows(spark, d) -> DataFrame:
    """(date, row, src_ip, ts_us) of all windows, numbered by day in order of time and source, without sorting a day in one task."""
    rows = windows.window_features(flows(spark, d)).select(F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd").alias("date"), "src_ip", "ts_us")
    numbered = timelines.running_sum(durable(rows).withColumn("one", F.lit(1)), ["date"], "ts_us", "one", manifest.SPAN_US, "row", ("src_ip",))
    return durable(numbered.select("date", (F.col("row") - 1).alias("row"), "src_ip", "ts_us"))


def manifest_of(spark, rows: DataFrame) -> DataFrame:
    """Checked sessions of a manifest that is written as JSON, with offsets in its times, and read."""
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.min("date").alias("day"))
    j, kind = "j", "j % 12"
    start = f"{j} * n DIV 30"
    stop = f"CASE {kind} WHEN 8 THEN n + 5 WHEN 11 THEN {start} - 1 ELSE {start} + n DIV 20 END"
    wall = lambda c: f"concat(date_format(timestamp_micros({c}), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+03:00')"
    made = spark.range(_SESSIONS).withColumnRenamed("id", j).crossJoin(F.broadcast(whole)).selectExpr(
        j,
        f"""named_struct('session_id', CAST({j} AS STRING), 'label', CASE WHEN {j} % 2 = 0 THEN 'normal' ELSE 'attack' END, 'date', CASE {kind} WHEN 6 THEN '' WHEN 7 THEN '2031-01-01' ELSE day END,
        'source_ips', CASE WHEN {kind} = 10 THEN array('10.9.9.9') WHEN {kind} IN (1, 4, 9) THEN array() WHEN {kind} = 5 THEN array('192.168.50.13') ELSE array('192.168.50.10', '192.168.50.12', '192.168.50.15') END,
        'expected_classes', CASE WHEN {kind} = 3 THEN array() WHEN {kind} IN (1, 9) THEN array('PORT_SCAN', 'DNS_ANOMALY') WHEN {kind} = 5 THEN array('PORT_SCAN') ELSE array('FAILED_CONNECTION_PATTERN') END,
        'time_start', CASE WHEN {kind} IN (5, 9) THEN {wall(f'a + (b - a) * {j} DIV 30')} END, 'time_end', CASE WHEN {kind} = 5 THEN {wall(f'a + (b - a) * ({j} + 4) DIV 30')} END,
        'row_boundaries', CASE WHEN {kind} NOT IN (5, 9) THEN named_struct('risk', named_struct('start_row', {start}, 'stop_row', {stop}, 'rows_added', CASE WHEN {kind} = 2 THEN 0L ELSE 5L END)) END) AS s""",
    )
    folder = shared_path(spark, "manifest")
    text = made.agg(F.array_sort(F.collect_list(F.struct(j, "s"))).alias("all")).select(F.to_json(F.struct(F.transform("all", lambda x: x["s"]).alias("sessions"))).alias("value"))
    text.coalesce(1).write.text(folder)
    return manifest.checked(manifest.sessions(read_manifest(spark, folder, manifest.SESSION)), manifest.days(rows))


_SCOPED = f"""day_rows AS (SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS date, row_number() OVER (PARTITION BY ts_us // 86400000000 ORDER BY ts_us, src_ip) - 1 AS nr, src_ip, ts_us FROM windows),
whole AS (SELECT count(*) AS n, min(ts_us) AS a, max(ts_us) AS b, min(date) AS day FROM day_rows),
per_day AS (SELECT date, count(*) AS day_rows, max(ts_us) AS last_us FROM day_rows GROUP BY 1),
sess AS (SELECT j, j % 12 AS kind, CASE WHEN j % 2 = 0 THEN 'normal' ELSE 'attack' END AS label, CASE j % 12 WHEN 6 THEN NULL WHEN 7 THEN '2031-01-01' ELSE day END AS date,
  CASE WHEN j % 12 = 10 THEN ['10.9.9.9'] WHEN j % 12 IN (1, 4, 9) THEN [] WHEN j % 12 = 5 THEN ['192.168.50.13'] ELSE ['192.168.50.10', '192.168.50.12', '192.168.50.15'] END AS ips,
  j * n // 30 AS r0, CASE j % 12 WHEN 8 THEN n + 5 WHEN 11 THEN j * n // 30 - 1 ELSE j * n // 30 + n // 20 END AS r1, a + (b - a) * j // 30 AS t0, CASE WHEN j % 12 = 5 THEN a + (b - a) * (j + 4) // 30 END AS t1
  FROM range({_SESSIONS}) r(j), whole),
judged AS (SELECT s.*, p.last_us, CASE WHEN kind = 2 THEN 'no rows added' WHEN kind = 4 THEN 'no sources' WHEN kind = 3 THEN 'no expected classes' WHEN kind = 6 THEN 'no date' WHEN kind = 7 THEN 'no table of its day'
  WHEN kind NOT IN (5, 9) AND r1 < r0 THEN 'row bounds out of order' WHEN kind NOT IN (5, 9) AND r1 > p.day_rows THEN 'row bounds beyond the table' WHEN kind NOT IN (5, 9) AND r1 = r0 THEN 'row bounds select no rows' END AS excluded FROM sess s LEFT JOIN per_day p USING (date)),
hits AS (SELECT j.j, j.label, d.* FROM judged j JOIN day_rows d ON j.excluded IS NULL AND d.date = j.date AND (len(j.ips) = 0 OR list_contains(j.ips, d.src_ip)) AND CASE WHEN j.kind IN (5, 9) THEN d.ts_us BETWEEN j.t0 AND coalesce(j.t1, j.last_us) ELSE d.nr >= j.r0 AND d.nr < j.r1 END),
normal_rows AS (SELECT date, nr, src_ip, ts_us, min(j) AS j FROM hits WHERE label = 'normal' GROUP BY 1, 2, 3, 4)"""
_MANIFEST = f"WITH {o.WINDOWS}, {_SCOPED}"


@query(f"{_MANIFEST} SELECT date, nr AS place, src_ip, j AS session_index FROM normal_rows")
def manifest_normal_rows(spark, d):
    rows = day_rows(spark, d)
    return manifest.session_rows(rows, manifest_of(spark, rows), "normal").select("date", F.col("row").alias("place"), "src_ip", "session_index")


@query(f"{_MANIFEST} SELECT date, nr AS place, src_ip, j AS session_index FROM hits WHERE label = 'attack'")
def manifest_attack_rows(spark, d):
    rows = day_rows(spark, d)
    return manifest.session_rows(rows, manifest_of(spark, rows), "attack").select("date", F.col("row").alias("place"), "src_ip", "session_index")


@query(f"{_MANIFEST} SELECT j AS session_index, label, CASE WHEN label = 'normal' AND excluded IS NULL AND m.c IS NULL THEN 'no rows matched' ELSE excluded END AS excluded, coalesce(m.c, 0) AS matched FROM judged LEFT JOIN (SELECT j, count(*) AS c FROM normal_rows GROUP BY 1) m USING (j)")
def manifest_sessions(spark, d):
    rows = day_rows(spark, d)
    found = manifest_of(spark, rows)
    return manifest.outcomes(found, manifest.session_rows(rows, found, "normal")).select(F.col("session_index").cast("long").alias("session_index"), "label", "excluded", "matched")


_DETECTION = f"""WITH {o.EVENTS}, {_SCOPED}, policies AS ({_POLICIES}),
hit_events AS (SELECT e.* REPLACE (concat(h.j, '|', e.src_ip) AS src_ip), h.j AS session_index FROM hits h JOIN events_ e ON e.src_ip = h.src_ip AND e.ts_us = h.ts_us WHERE h.label = 'attack'), {_replay('hit_events')},
seen AS (SELECT policy, session_index, list_sort(list(DISTINCT attack_type)) AS detected, list_sort(list(DISTINCT attack_type) FILTER (WHERE attack_type = 'PORT_SCAN' AND flag_port_scan = 1 AND (unique_dst_ports_30s >= 20 OR unique_dst_ports_1m >= 20))) AS alerted, min(ts_us) AS first_us FROM replay WHERE kept = 1 GROUP BY 1, 2),
goals AS (SELECT j, date, CASE WHEN kind IN (5, 9) THEN t0 END AS t0, CASE WHEN kind IN (1, 9) THEN ['DNS_ANOMALY', 'PORT_SCAN'] WHEN kind = 5 THEN ['PORT_SCAN'] ELSE ['FAILED_CONNECTION_PATTERN'] END AS expected, CASE WHEN kind IN (1, 5, 9) THEN ['PORT_SCAN'] ELSE [] END AS due FROM judged WHERE label = 'attack' AND excluded IS NULL),
v AS (SELECT p.policy, g.*, coalesce(s.detected, []) AS detected, coalesce(s.alerted, []) AS alerted, trunc((s.first_us - g.t0) / 1e6) AS delay FROM goals g CROSS JOIN policies p LEFT JOIN seen s ON s.policy = p.policy AND s.session_index = g.j)
SELECT policy, j AS session_index, concat('session_', j) AS scenario, date, array_to_string(expected, ',') AS expected, len(list_intersect(expected, detected)) AS found, array_to_string(list_filter(expected, lambda x: NOT list_contains(detected, x)), ',') AS missed,
  floor(len(list_intersect(expected, detected)) * 1e4 / len(expected) + 0.5) / 1e2 AS recall, array_to_string(detected, ',') AS detected, array_to_string(alerted, ',') AS alerted, len(list_intersect(due, alerted)) AS alerts_found,
  array_to_string(list_filter(due, lambda x: NOT list_contains(alerted, x)), ',') AS alerts_missed, CASE WHEN len(due) > 0 THEN floor(len(list_intersect(due, alerted)) * 1e4 / len(due) + 0.5) / 1e2 END AS alert_recall,
  CAST(delay AS BIGINT) AS delay_raw_s, CAST(CASE WHEN delay >= -30 THEN greatest(delay, 0) END AS BIGINT) AS delay_s, CASE WHEN delay IS NULL THEN 'unavailable' WHEN delay < -30 THEN 'before the session' WHEN delay < 0 THEN 'overlapping window' ELSE '' END AS timing FROM v"""


@query(_DETECTION)
def manifest_detection(spark, d):
    """What each policy detects inside the manifest's attack sessions."""
    rows = day_rows(spark, d)
    found = manifest_of(spark, rows)
    inside = durable(manifest.session_rows(rows, found, "attack").select("session_index", "src_ip", "ts_us"))
    events = events_of(spark, d).join(inside, ["src_ip", "ts_us"])
    kept = calibrate.replayed(events, apart=("session_index",)).filter("kept = 1")
    return manifest.detection(kept, found, calibrate.policies(spark), ACTIONABLE, ("PORT_SCAN",))
