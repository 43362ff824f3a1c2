"""Replay of candidate detection policies over classified rows, and alert routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import ACTIONABLE, DECISION, rounded
from flowsentry.operators.pauses import cooldown, sent_alerts
from flowsentry.operators.timelines import stretches

GAP_US, COOLDOWN_US = 90_000_000, 600_000_000
# The candidate policies and their thresholds.
POLICY_COLUMNS = ("policy", "failed_connections", "failed_count", "failed_risk", "failed_persistence", "failed_signal", "port_connections", "port_support", "port_spread", "dns_risk", "dns_anomaly", "dns_persistence")
POLICIES = (
    ("current_policy", 0, 0, 0, 1, 0, 0, 0, 0, 0, 0.0, 1),
    ("failed_abs_ge_5_connections_ge_10", 10, 5, 0, 1, 0, 0, 0, 0, 0, 0.0, 1),
    ("failed_abs_ge_10_risk_ge_20", 10, 10, 20, 1, 0, 0, 0, 0, 0, 0.0, 1),
    ("failed_abs_ge_5_plus_independent_signal", 10, 5, 0, 1, 1, 0, 0, 0, 0, 0.0, 1),
    ("failed_persistent_3_abs_ge_5", 10, 5, 0, 3, 0, 0, 0, 0, 0, 0.0, 1),
    ("portscan_no_cdn_fanout", 0, 0, 0, 1, 0, 50, 1, 1, 0, 0.0, 1),
    ("dns_persistent_or_model_risk", 0, 0, 0, 1, 0, 0, 0, 0, 30, 0.35, 2),
    ("combined_conservative", 10, 5, 20, 1, 1, 50, 1, 1, 30, 0.35, 2),
    ("validated_alert_tier", 10, 5, 20, 1, 1, 50, 1, 1, 30, 0.35, 2),
)
_OTHER_SIGNAL = "(anomaly_score > 0 OR risk_score >= 20 OR persistence >= 3 OR ctx_port = '22')"
_FAILED = f"(failed_conn_rate_30s >= 8e-1 AND connections_30s >= failed_connections AND connections_30s * failed_conn_rate_30s >= failed_count AND risk_score >= failed_risk AND persistence >= failed_persistence AND (failed_signal = 0 OR {_OTHER_SIGNAL}))"
_PORT = "(CASE WHEN port_spread = 1 AND connections_30s < port_connections THEN unique_dst_ports_30s >= 10 AND (failed_conn_rate_30s >= 3e-1 OR risk_score >= 20) ELSE (unique_dst_ports_30s >= 10 OR unique_dst_ips_30s >= 10) AND connections_30s >= port_connections AND (port_support = 0 OR failed_conn_rate_30s >= 3e-1 OR risk_score >= 30) END)"
_DNS = "(dns_rate_30s >= 1 AND (persistence >= dns_persistence OR (risk_score >= dns_risk AND anomaly_score >= dns_anomaly)))"
#: Whether a policy keeps a row.
KEPT = f"CASE WHEN policy = 'current_policy' THEN 1 WHEN attack_type = 'FAILED_CONNECTION_PATTERN' THEN CASE WHEN {_FAILED} THEN 1 ELSE 0 END WHEN attack_type = 'PORT_SCAN' THEN CASE WHEN {_PORT} THEN 1 ELSE 0 END WHEN attack_type = 'DNS_ANOMALY' THEN CASE WHEN {_DNS} THEN 1 ELSE 0 END ELSE 1 END"


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy string, failed_connections int, failed_count int, failed_risk int, failed_persistence int, failed_signal int, port_connections int, port_support int, port_spread int, dns_risk int, dns_anomaly double, dns_persistence int")


def derived_sessions(rows: DataFrame) -> DataFrame:
    """(session, label, src_ip, start_row, stop_row, expected, rows): labelled sessions over each source's window rows, for
    tables without a manifest. Of every six sources some have sessions with each fault that a manifest can have."""
    spans = rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
    spans = spans.withColumn("r", F.row_number().over(Window.orderBy("src_ip")).cast("long") - 1)  # a row a source
    kinds = [
        "struct(3 * r AS session, 'normal' AS label, 0L AS start_row, CASE WHEN r % 6 = 4 THEN 0L ELSE n DIV 3 END AS stop_row, CAST(NULL AS STRING) AS expected)",
        "struct(3 * r + 1 AS session, 'normal' AS label, n DIV 4 AS start_row, CASE WHEN r % 6 = 5 THEN NULL WHEN r % 6 = 2 THEN n DIV 8 - 1 ELSE n DIV 2 END AS stop_row, CAST(NULL AS STRING) AS expected)",
        "struct(3 * r + 2 AS session, 'attack' AS label, n DIV 2 AS start_row, CASE WHEN r % 6 = 2 THEN n + 5 ELSE n END AS stop_row, CASE r % 6 WHEN 3 THEN NULL WHEN 0 THEN 'FAILED_CONNECTION_PATTERN' WHEN 1 THEN 'DNS_ANOMALY' ELSE 'LOW_SIGNAL_REVIEW' END AS expected)",
    ]
    each = spans.select("src_ip", F.col("n").alias("rows"), F.explode(F.array(*[F.expr(k) for k in kinds])).alias("s"))
    return each.select("s.session", "s.label", "src_ip", "s.start_row", "s.stop_row", "s.expected", "rows")


def validated_sessions(found: DataFrame) -> DataFrame:
    """Sessions with the first reason that excludes them, if any; rows is the row count of the session's source."""
    reason = F.when(F.col("start_row").isNull() | F.col("stop_row").isNull(), "missing bounds").when(F.col("stop_row") < F.col("start_row"), "bounds out of order")
    if "rows" in found.columns:
        reason = reason.when(F.col("stop_row") > F.col("rows"), "beyond row count")
    reason = reason.when(F.col("stop_row") == F.col("start_row"), "no rows added").when(F.col("src_ip").isNull(), "no sources")
    return found.withColumn("excluded", reason.when((F.col("label") == "attack") & F.col("expected").isNull(), "no expected class"))


def scoped(rows: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """Rows inside valid sessions with the label (row index k in [start, stop), same source); of overlapping sessions the first counts."""
    good = validated_sessions(found).filter("excluded IS NULL").filter(F.col("label") == label).select("session", "src_ip", "start_row", "stop_row", "expected")
    inside = rows.join(F.broadcast(good), "src_ip").filter("k >= start_row AND k < stop_row")
    first = Window.partitionBy("src_ip", "k").orderBy("session")
    return inside.withColumn("order", F.row_number().over(first)).filter("order = 1").drop("order", "start_row", "stop_row")


def sequences(events: DataFrame, gap_us: int = GAP_US, apart: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence (number within source and class, and the columns apart) and persistence (its length); a gap of up to gap_us continues one."""
    keys = ["src_ip", "attack_type", *apart]
    numbered = stretches(events, keys, gap_us, "sequence", ("k",))
    return numbered.withColumn("persistence", F.count(F.lit(1)).over(Window.partitionBy(*keys, "sequence")))


def replayed(events: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Every event under every policy, with kept 1 or 0. The policies are a table of nine rows."""
    return sequences(events, apart=apart).crossJoin(F.broadcast(policies(events.sparkSession))).withColumn("kept", F.expr(KEPT))


def policy_metrics(events: DataFrame, total_rows: DataFrame) -> DataFrame:
    """By policy: rows kept, percent of all rows, sources, alerts after cooldown, reduction, actionable rows, and whether targets are met."""
    rows = replayed(events)
    kept = rows.filter("kept = 1")
    counts = rows.groupBy("policy").agg(F.sum("kept").alias("kept"), F.count(F.lit(1)).alias("current"), F.count_distinct(F.when(F.col("kept") == 1, F.col("src_ip"))).alias("sources"), F.sum(F.expr(f"CASE WHEN kept = 1 AND {ACTIONABLE} THEN 1 ELSE 0 END")).alias("actionable"))
    alerts = cooldown(kept, ["policy", "src_ip", "attack_type"], COOLDOWN_US).groupBy("policy").agg(F.count(F.lit(1)).alias("alerts"))
    total = total_rows.agg(F.count(F.lit(1)).alias("total"))
    out = counts.join(alerts, "policy", "left").na.fill(0, ["alerts"]).crossJoin(F.broadcast(total))
    out = out.select("policy", "kept", "sources", "actionable", "alerts", F.expr(rounded("kept * 1e2 / total", 4)).alias("percent"), F.expr(rounded("(current - kept) * 1e2 / current", 4)).alias("reduction"))
    return out.withColumn("target_met", ((F.col("percent") <= 1) & (F.col("alerts") <= 5)).cast("int"))


def best_policy(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("target_met"), "percent", "alerts", F.desc("reduction"), "policy").limit(1)


def by_class(events: DataFrame) -> DataFrame:
    return replayed(events).groupBy("policy", "attack_type").agg(F.sum("kept").alias("retained"), F.sum(1 - F.col("kept")).alias("removed"))


def attack_validation(events: DataFrame, found: DataFrame) -> DataFrame:
    """By policy and attack session: classes seen, whether the expected one is among them, and the delay of its first row."""
    hits = replayed(scoped(events, found, "attack")).filter("kept = 1")
    seen = hits.groupBy("policy", "session").agg(F.array_join(F.array_sort(F.collect_set("attack_type")), ",").alias("classes"), F.max(F.expr("CASE WHEN attack_type = expected THEN 1 ELSE 0 END")).alias("hit"), F.min(F.expr("CASE WHEN attack_type = expected THEN k END")).alias("first_row"))
    every = policies(events.sparkSession).select("policy").crossJoin(F.broadcast(validated_sessions(found).filter("excluded IS NULL AND label = 'attack'").select("session", "expected", "start_row")))
    return every.join(seen, ["policy", "session"], "left").select("policy", "session", "expected", F.coalesce("classes", F.lit("")).alias("classes"), F.coalesce("hit", F.lit(0)).alias("hit"), ((F.col("first_row") - F.col("start_row")) * 30).alias("delay_s"))


def readiness(validation: DataFrame, metrics: DataFrame) -> DataFrame:
    """By policy: recall over attack sessions, whether it is ready (full recall and targets met on normal rows), and the reasons if not."""
    recall = validation.groupBy("policy").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("expected_sessions"))
    rows = recall.join(metrics.select("policy", "target_met"), "policy", "left").withColumn("target_met", F.coalesce("target_met", F.lit(0)))
    missed, noisy = F.col("hits") < F.col("expected_sessions"), F.col("target_met") == 0
    reasons = F.concat_ws(",", F.when(missed, "missed sessions"), F.when(noisy, "targets not met"))
    return rows.select("policy", "hits", "expected_sessions", F.expr(rounded("hits * 1e2 / expected_sessions", 2)).alias("recall"), "target_met", (~missed & ~noisy).cast("int").alias("ready"), reasons.alias("reasons"))


def compared(earlier: DataFrame, current: DataFrame) -> DataFrame:
    """Row by row: the earlier policy's class beside the current one's."""
    side = lambda df, name: df.select("src_ip", "k", F.col("attack_type").alias(name))
    return side(earlier, "earlier_type").join(side(current, "current_type"), ["src_ip", "k"], "full").withColumn("same", F.col("earlier_type").eqNullSafe(F.col("current_type")).cast("int"))


def failed_analysis(events: DataFrame) -> DataFrame:
    """Failed-connection rows: sizes, share of small denominators and of the largest source, longest sequence, causes."""
    rows = sequences(events.filter("attack_type = 'FAILED_CONNECTION_PATTERN'"))
    by_source = rows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("CASE WHEN connections_30s < 5 THEN 1 ELSE 0 END")).alias("small"), F.max("persistence").alias("p"))
    out = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("small"), F.lit(0)).alias("small"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_source"), F.coalesce(F.max("p"), F.lit(0)).alias("longest"))
    return out.withColumn("causes", F.concat_ws(",", F.when((F.col("rows") > 0) & (F.col("small") * 2 >= F.col("rows")), "small denominators"), F.when((F.col("rows") > 0) & (F.col("largest_source") * 10 >= F.col("rows") * 7), "one source"), F.when(F.col("longest") >= 3, "persistent")))


# Alert routing


def routed(events: DataFrame) -> DataFrame:
    """Adds decision and fingerprint."""
    number = lambda c: F.format_string("%.4f", F.col(c))
    return events.withColumn("decision", F.expr(DECISION)).withColumn("fingerprint", F.sha2(F.concat_ws("|", F.col("ts_us").cast("string"), "src_ip", "attack_type", number("confidence"), number("risk_score")), 256))


def unsent(events: DataFrame, sent: DataFrame) -> DataFrame:
    return events.join(sent.select("fingerprint").distinct(), "fingerprint", "left_anti")


def due_alerts(events: DataFrame, pause_us: int = COOLDOWN_US, increase: float = 10.0) -> DataFrame:
    """Actionable events that go out: pause_us after the source's and class's last one sent, or sooner if risk rose by increase since it."""
    alerts = events.filter("decision = 'actionable'").select("src_ip", "attack_type", "ts_us", F.col("k").alias("id"), F.col("risk_score").cast("double").alias("risk"))
    return sent_alerts(alerts, ["src_ip", "attack_type"], pause_us, increase).withColumnsRenamed({"id": "k", "risk": "risk_score"})


def primed(events: DataFrame) -> DataFrame:
    """Today's events without sending: actionable ones are baselined, the others reviewed."""
    return events.select("fingerprint", F.when(F.col("decision") == "actionable", "baselined").otherwise("reviewed").alias("state"))


def payloads(events: DataFrame) -> DataFrame:
    return events.withColumn("message", F.format_string("%s from %s: confidence %.2f, risk %.2f. Reasons: %s", "attack_type", "src_ip", "confidence", "risk_score", F.array_join("reasons", "; ")))
