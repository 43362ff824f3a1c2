"""Queries of evidence, statistics and the labelled-flow classifier, with SQL written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.functions.expressions import rounded
from flowsentry.operators import anomaly, audit, baselines, classifier, evidence, features, risk, windows
from flowsentry.plans import oracle as o
from flowsentry.plans.queries import events_of, query, risk_of, scores_of
from flowsentry.sources.flows import flows, read_baselines, write_baselines
from flowsentry.sources.tables import shared_path

_DAY = "ts_us // 86400000000"
_HALF = "(SELECT (min(ts_us) + max(ts_us)) // 2 FROM flows)"


@query(f"WITH {o.WINDOWS}, c AS (SELECT 'flows' AS dataset, count(*) AS stop_row, CAST(sum(CASE WHEN ts_us <= {_HALF} THEN 1 ELSE 0 END) AS BIGINT) AS start_row FROM flows UNION ALL SELECT 'windows', count(*), CAST(sum(CASE WHEN ts_us <= {_HALF} THEN 1 ELSE 0 END) AS BIGINT) FROM windows) SELECT dataset, start_row, stop_row, stop_row - start_row AS added FROM c")
def evidence_rows_added(spark, d):
    f, w = flows(spark, d), windows.window_features(flows(spark, d))
    half = f.agg(F.floor((F.min("ts_us") + F.max("ts_us")) / 2).cast("long").alias("half"))
    early = lambda df: df.join(F.broadcast(half), F.col("ts_us") <= F.col("half"))
    return evidence.rows_added(evidence.snapshot({"flows": early(f), "windows": early(w)}), evidence.snapshot({"flows": f, "windows": w}))


@query(f"WITH {o.FLOWS_SQL} SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE ts_us // 1000000 END AS seconds FROM flows")
def parse_event_times(spark, d):
    at = F.timestamp_seconds(F.floor(F.col("ts_us") / 1_000_000))
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+03:00'"]
    kind = F.col("event_id") % 7
    text = F.lit("   ")
    for i, form in enumerate(forms):
        text = F.when(kind == i, F.date_format(at, form)).otherwise(text)
    rows = flows(spark, d).select("event_id", F.when(kind == 6, "no time").otherwise(text).alias("time"), F.lit(None).cast("string").alias("datetime"), F.floor(F.col("ts_us") / 1_000_000).alias("ts"))
    return rows.select("event_id", F.unix_seconds(evidence.event_time(("datetime", "time"), "ts")).alias("seconds"))


@query(f"WITH {o.EVENTS} SELECT attack_type, count(*) AS events, count(DISTINCT {_DAY}) AS days FROM events_ GROUP BY 1")
def classify_range_totals(spark, d):
    return evidence.range_totals(evidence.day_class_counts(events_of(spark, d)))


@query(f"WITH {o.EVENTS}, e AS (SELECT {_DAY} AS day, attack_type, confidence FROM events_), w AS (SELECT {_DAY} AS day, count(*) AS windows FROM risk GROUP BY 1), t AS (SELECT attack_type, count(*) AS overall FROM events_ GROUP BY 1), c AS (SELECT day, attack_type, count(*) AS events, max(confidence) AS max_confidence FROM e GROUP BY 1, 2) SELECT c.day, c.attack_type, events, max_confidence, overall, windows FROM c JOIN w ON w.day = c.day JOIN t ON t.attack_type = c.attack_type")
def evidence_export(spark, d):
    """The exported document, read back as rows."""
    document = evidence.export_document(audit.day_audit(risk_of(spark, d)), evidence.day_class_counts(events_of(spark, d)))
    days = document.select("overall", F.explode("days").alias("x")).select("overall", "x.day", "x.windows", F.explode("x.classes").alias("c"))
    return days.select("day", "c.attack_type", "c.events", "c.max_confidence", F.col("overall")[F.col("c.attack_type")].alias("overall"), "windows")


@query(f"WITH {o.RISK_ROWS} SELECT {_DAY} AS day, count(*) AS windows FROM risk GROUP BY 1 HAVING {_DAY} >= (SELECT min({_DAY}) FROM risk)")
def audit_selected_days(spark, d):
    return evidence.selected_days(audit.day_audit(risk_of(spark, d)), first=0).select("day", "windows")


@query(f"""WITH {o.EVENTS}, t AS (SELECT max({_DAY}) AS today FROM flows)
SELECT 'suspicious' AS measure, count(*) AS n FROM events_, t WHERE {_DAY} = today UNION ALL SELECT 'high_confidence', count(*) FROM events_, t WHERE {_DAY} = today AND confidence >= 65e-2
UNION ALL SELECT 'flows_rows', count(*) FROM flows, t WHERE {_DAY} = today UNION ALL SELECT 'risk_rows', count(*) FROM risk, t WHERE {_DAY} = today
UNION ALL SELECT 'local_sources', count(DISTINCT src_ip) FROM flows, t WHERE {_DAY} = today AND src_ip LIKE '192.168.%'""")
def live_totals(spark, d):
    f, r = flows(spark, d), risk_of(spark, d)
    return evidence.live_totals({"flows": f, "risk": r}, events_of(spark, d), f)


_SLICE = "ts_us BETWEEN 1000000000 AND 60000000000"
_TOP = " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS section, CAST({column} AS VARCHAR) AS key, count(*) AS n FROM flows WHERE {_SLICE} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {most}) t_{name}" for name, (column, most) in evidence.SECTIONS.items())


@query(f"WITH {o.RISK_ROWS} {_TOP} UNION ALL SELECT * FROM (SELECT 'risk' AS section, concat(src_ip, '/', CAST(k AS VARCHAR)) AS key, CAST(round(risk_score * 100) AS BIGINT) AS n FROM risk WHERE {_SLICE} ORDER BY risk_score DESC, src_ip, k LIMIT 10) h")
def evidence_slice(spark, d):
    return evidence.slice_evidence(flows(spark, d), risk_of(spark, d), 1_000_000_000, 60_000_000_000)


@query(f"WITH {o.FLOWS_SQL} SELECT event_id, dst_ip FROM flows WHERE dst_ip NOT IN ('224.0.0.251', '224.0.0.1', '192.168.68.255', '192.168.1.255', '255.255.255.255', 'ff02::fb', 'ff02::1:3', 'ff02::1', 'ff02::2', 'ff02::16', '192.168.50.1', '10.255.255.255') AND dst_port NOT IN (137, 138, 139, 5353, 1900, 5355)")
def flows_without_network_noise(spark, d):
    """192.168.50.0/31 is a network whose broadcast address the flows hold."""
    padded = flows(spark, d).withColumn("dst_ip", F.concat(F.lit(" "), "dst_ip", F.lit(" ")))
    return features.without_noise_of(padded, ["192.168.50.0/31", "10.0.0.0/8", "fe80::/10"]).select("event_id", F.trim("dst_ip").alias("dst_ip"))


_STATS = {"mean": "avg({c})", "std": "stddev_samp({c})", "median": "quantile_cont({c}, 0.5)", "p95": "quantile_cont({c}, 0.95)", "p99": "quantile_cont({c}, 0.99)", "most": "max({c})"}


@query(f"WITH {o.WINDOWS}, a AS (SELECT * FROM windows WHERE connections_5m > 0) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, " + ", ".join(f"{rounded('CAST(' + e.format(c=c) + ' AS DOUBLE)', 4)} AS {n}" for n, e in _STATS.items()) + " FROM a" for c in anomaly.FEATURES))
def training_statistics(spark, d):
    return anomaly.statistics(windows.window_features(flows(spark, d)))


@query(f"WITH {o.RISK_ROWS}, lim AS (SELECT src_ip, floor(quantile_cont(score_scan, 0.99) * 1e4 + 5e-1) / 1e4 AS if_p99, floor(quantile_cont(score_scan, 0.999) * 1e4 + 5e-1) / 1e4 AS if_p999 FROM risk GROUP BY 1 HAVING count(*) >= 100) SELECT src_ip, coalesce(p.use_per_ip, 0) AS use_per_ip, if_p99, if_p999 FROM profiles p FULL JOIN lim USING (src_ip)")
def baseline_score_limits(spark, d):
    """Limits of a score by source; here of the scan score, which SQL has too."""
    scored = risk_of(spark, d).select("src_ip", F.col("score_scan").alias("anomaly_score"))
    return baselines.with_score_limits(baselines.profiles(flows(spark, d)), scored).select("src_ip", "use_per_ip", "if_p99", "if_p999")


@query()
def anomaly_compare(spark, d):
    return anomaly.compared(scores_of(spark, d))


@query(f"WITH {o.FLOWS_SQL}, {o.CLEAN}, {o.PROFILES} SELECT src_ip, flow_count, use_per_ip, connections_30s_p999 FROM profiles")
def baseline_json(spark, d):
    """Baselines written as JSON, one document for each source, and read back."""
    path = shared_path(spark, "baselines")
    write_baselines(baselines.profiles(flows(spark, d)), path)
    return read_baselines(spark, path, "flow_count long, use_per_ip int, connections_30s_p999 double").select("src_ip", "flow_count", "use_per_ip", "connections_30s_p999")


# The labelled-flow classifier: flows under the headers and labels of such files.

_LABELS = ("BENIGN", "DoS Hulk", "DoS GoldenEye", "DoS slowloris", "DoS Slowhttptest", "Web Attack � Brute Force", "Web Attack � XSS", "Bot", "Heartbleed")
_CLASS_SQL = "CASE (event_id * 7 + dst_port) % 9 WHEN 1 THEN 'DoS' WHEN 2 THEN 'DoS' WHEN 3 THEN 'DoS_Slow' WHEN 4 THEN 'DoS_Slow' WHEN 5 THEN 'BruteForce' WHEN 6 THEN 'WebAttack' WHEN 7 THEN 'Bot' END"
_PREPARED = f"WITH {o.FLOWS_SQL}, prepared AS (SELECT event_id, {_CLASS_SQL} AS label, CAST(dst_port AS DOUBLE) AS dst_port, CAST(duration AS DOUBLE) AS duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes, CAST(resp_bytes AS DOUBLE) AS resp_bytes FROM flows WHERE {_CLASS_SQL} IS NOT NULL AND orig_bytes <> 0)"


def labelled_flows(spark, d):
    f = flows(spark, d)
    label = F.element_at(F.array(*[F.lit(f" {x} ") for x in _LABELS]), ((F.col("event_id") * 7 + F.col("dst_port")) % 9 + 1).cast("int"))
    state = lambda *s: F.col("conn_state").isin(*s).cast("int")
    ratio = F.when(F.col("orig_bytes") == 0, F.lit(float("inf"))).otherwise(F.col("resp_bytes") / F.greatest("orig_bytes", F.lit(1)))
    columns = {" Destination Port": F.col("dst_port"), " Flow Duration": F.col("duration"), "Total Fwd Packets": F.col("orig_bytes") % 50, " Total Backward Packets": F.col("resp_bytes") % 50, "Total Length of Fwd Packets": F.col("orig_bytes"), " Total Length of Bwd Packets": F.col("resp_bytes"), " SYN Flag Count": state("S0"), " RST Flag Count": state("REJ"), "FIN Flag Count": state("SF"), " Down/Up Ratio": ratio, "Flow Bytes/s": F.lit(1.0), " Label": label}
    return f.select("event_id", *[v.alias(k) for k, v in columns.items()])


@query(f"{_PREPARED} SELECT * FROM prepared")
def model_prepared(spark, d):
    return classifier.prepared(labelled_flows(spark, d)).select("event_id", "label", "dst_port", "duration", "orig_bytes", "resp_bytes")


@query(f"{_PREPARED} SELECT event_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= floor(count(*) OVER (PARTITION BY label) * 20 / 100) THEN 'test' ELSE 'train' END AS part FROM prepared")
def model_split(spark, d):
    return classifier.split(classifier.prepared(labelled_flows(spark, d)), "event_id").select("event_id", "label", "part")


@query(f"{_PREPARED}, parts AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) > floor(count(*) OVER (PARTITION BY label) * 20 / 100) AS train FROM prepared), s AS (SELECT label, count(*) AS n, min(dst_port) AS low_dst_port, max(dst_port) AS high_dst_port, min(duration) AS low_duration, max(duration) AS high_duration, min(orig_bytes) AS low_orig_bytes, max(orig_bytes) AS high_orig_bytes, min(resp_bytes) AS low_resp_bytes, max(resp_bytes) AS high_resp_bytes FROM parts WHERE train GROUP BY 1) SELECT * REPLACE ((SELECT max(n) FROM s) AS n) FROM s")
def model_oversampled(spark, d):
    """Rows of each class with its smallest and largest values: new rows lie between rows of their class, so these are those of the train rows."""
    train = classifier.split(classifier.prepared(labelled_flows(spark, d)), "event_id").filter("part = 'train'")
    ends = [f(n).alias(f"{name}_{n}") for n in ("dst_port", "duration", "orig_bytes", "resp_bytes") for name, f in (("low", F.min), ("high", F.max))]
    return classifier.oversampled(train, "event_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), *ends)


@query()
def model_evaluation(spark, d):
    parts = classifier.split(classifier.prepared(labelled_flows(spark, d)), "event_id")
    model = classifier.trained(classifier.oversampled(parts.filter("part = 'train'"), "event_id"), trees=10, depth=5)
    return classifier.evaluation(classifier.predicted(parts.filter("part = 'test'"), model))


@query()
def model_windows(spark, d):
    train = classifier.split(classifier.prepared(labelled_flows(spark, d)), "event_id").filter("part = 'train'")
    model = classifier.trained(train, trees=10, depth=5)
    return classifier.predicted(classifier.of_windows(windows.window_features(flows(spark, d))), model).select("src_ip", "k", "predicted", "confidence")


@query(f"WITH {o.WINDOWS} SELECT src_ip, k, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {n}" for n, c in classifier.WINDOW_COLUMNS.items()) + " FROM windows")
def model_window_features(spark, d):
    return classifier.of_windows(windows.window_features(flows(spark, d)))


@query(f"WITH {o.RISK_ROWS} SELECT src_ip, k, risk_score FROM risk r WHERE ts_us > (SELECT max(ts_us) - 600000000 FROM risk x WHERE x.src_ip = r.src_ip)")
def risk_new_windows(spark, d):
    """Risk rows after each source's last processed one, here ten minutes before its end."""
    rows = risk_of(spark, d)
    marks = rows.groupBy("src_ip").agg((F.max("ts_us") - 600_000_000).alias("mark"))
    return risk.new_windows(rows, marks).select("src_ip", "k", "risk_score")
