"""Risk scores of windows, their explanation, and the classes of suspicious ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import CLASSES, COMPONENTS, LEVEL, LEVELS, RISK, RULES, SCORES, SUSPICIOUS, classification, reason_texts, rounded
from flowsentry.functions.expressions import _BOT as BOT
from flowsentry.sources.tables import durable


def risk_rows(flagged: DataFrame) -> DataFrame:
    """Flagged windows with thresholds (and an anomaly_score, 0 if absent) -> scores, components, risk and level."""
    rows = flagged if "anomaly_score" in flagged.columns else flagged.withColumn("anomaly_score", F.lit(0.0))
    for group in (SCORES, COMPONENTS, {"risk_score": RISK}, {"risk_level": LEVEL}):
        rows = rows.selectExpr("*", *[f"{e} AS {c}" for c, e in group.items()])
    return rows


def explained(risk: DataFrame) -> DataFrame:
    """Adds explanation: contributors of a point or more, largest first, ties in the order anomaly, scan, burst, dns."""
    scan = F.when((F.col("flag_port_scan") == 1) & ((F.col("unique_dst_ports_30s") >= 20) | (F.col("unique_dst_ports_1m") >= 20)), "possible port scan").otherwise("more ports than usual")
    texts = {"anomaly": F.lit("unusual behaviour"), "scan": F.concat(scan, F.lit(" ("), F.col("unique_dst_ports_30s").cast("string"), F.lit(" ports)")), "burst": F.concat(F.lit("connection burst ("), F.col("connections_30s").cast("string"), F.lit(" in 30s)")), "dns": F.lit("high DNS rate")}
    parts = F.array(*[F.struct(F.col(f"component_{k}").alias("points"), F.lit(-i).alias("order"), t.alias("text")) for i, (k, t) in enumerate(texts.items())])
    kept = F.transform(F.sort_array(F.filter(parts, lambda p: p["points"] >= 1), asc=False), lambda p: p["text"])
    return risk.withColumn("explanation", F.when(F.col("risk_level") == "NORMAL", "normal traffic").when(F.size(kept) == 0, "unusual pattern").otherwise(F.array_join(kept, " | ")))


def daily_summary(risk: DataFrame) -> DataFrame:
    """Rows by level with their shares in percent, greatest and mean risk, mean anomaly, alert budget status."""
    counts = [F.sum(F.when(F.col("risk_level") == x, 1).otherwise(0)).alias(x.lower()) for x in LEVELS]
    out = risk.groupBy().agg(F.count(F.lit(1)).alias("rows"), *counts, F.max("risk_score").alias("max_risk"), F.expr(rounded("avg(risk_score)", 4)).alias("mean_risk"), F.expr(rounded("avg(anomaly_score)", 4)).alias("mean_anomaly"))
    alerts = F.col("critical") + F.col("alert")
    shares = {f"{x.lower()}_percent": F.expr(rounded(f"{x.lower()} * 1e2 / rows", 1)) for x in LEVELS}
    return out.withColumns(shares).withColumn("budget", F.when(alerts <= 5, "ok").when(alerts <= 15, "warn").otherwise("bad"))


def source_ports(flows: DataFrame) -> DataFrame:
    """Each source's most used destination port (the smallest of equals): context for the login classes."""
    counts = flows.groupBy("src_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("src_ip").agg(F.max_by(F.col("dst_port"), F.struct("n", -F.col("dst_port"))).cast("string").alias("ctx_port"))


def classified(risk: DataFrame, ports: DataFrame | None = None, trusted: tuple[str, ...] = (), earlier: bool = False) -> DataFrame:
    """Suspicious rows with attack_type, confidence and reasons; repeated counts a source's suspicious rows."""
    rows = durable(risk.filter(SUSPICIOUS))  # read for the counts, and again by whatever reads the events
    counts = rows.filter("src_ip <> ''").groupBy("src_ip").agg(F.count(F.lit(1)).alias("repeated"))
    rows = rows.join(ports, "src_ip", "left") if ports is not None else rows.withColumn("ctx_port", F.lit(None).cast("string"))
    rows = rows.withColumn("ctx_service", F.when(F.col("ctx_port") == "22", "ssh")).join(counts, "src_ip", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    keep = [*rows.columns, "attack_type", "confidence"]
    for name, e in classification(earlier, trusted).items():
        rows = rows.withColumn(name, F.expr(e))
    return rows.select(*keep).withColumn("reasons", reasons(trusted))


def alerts(rows: DataFrame, least: float = 30) -> DataFrame:
    """Rows of least risk or more, highest first."""
    return rows.filter(F.col("risk_score") >= least).orderBy(F.desc("risk_score"), "src_ip", "k")


def new_windows(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows after their source's mark (src_ip, mark), the last time processed; sources without one are all new."""
    return rows.join(marks, "src_ip", "left").filter("mark IS NULL OR ts_us > mark").drop("mark")


def reasons(trusted: tuple[str, ...] = ()):
    """The texts of the conditions that held for the row's class, and that the source is a trusted one."""
    of = F.array().cast("array<string>")
    when = lambda c, t: F.when(F.expr(c), F.lit(t))
    unknown = F.array_compact(F.array(when("risk_score >= 30", "risk"), when("anomaly_score >= 35e-2", "anomaly")))
    out = F.when(F.col("attack_type") == "UNKNOWN_SUSPICIOUS", unknown).otherwise(F.array_compact(F.array(F.lit("weak indicators"), when("risk_score >= 20 AND risk_score < 30", "risk in review range"))))
    for name, conditions in [*((k, v[1]) for k, v in RULES.items()), ("BOT_LIKE_BEHAVIOR", BOT)]:
        texts = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(t)) for c, t in reason_texts(conditions)]))
        out = F.when(F.col("attack_type") == name, texts).otherwise(out)
    out = F.coalesce(out, of)
    return F.when(F.col("src_ip").isin(*trusted), F.concat(out, F.array(F.lit("trusted source")))).otherwise(out) if trusted else out


#: The order in which events are shown.
EVENT_ORDER = [F.desc, ("confidence", "risk_score", "anomaly_score", "connections_30s")]


def event_order() -> list:
    return [*[F.col(c).desc_nulls_last() for c in EVENT_ORDER[1]], F.col("src_ip"), F.col("k")]


def class_counts(events: DataFrame) -> DataFrame:
    """Events of every class, those without any too."""
    dimension = events.sparkSession.createDataFrame([(c,) for c in CLASSES], "attack_type string")
    return dimension.join(events.groupBy("attack_type").agg(F.count(F.lit(1)).alias("events"), F.max("confidence").alias("max_confidence"), F.max("risk_score").alias("max_risk")), "attack_type", "left").na.fill(0, ["events"])


def top_display(events: DataFrame, n: int = 10) -> DataFrame:
    """The first n events for display; low-signal ones only fill up."""
    return events.orderBy(F.when(F.col("attack_type") == "LOW_SIGNAL_REVIEW", 1).otherwise(0), *event_order()).limit(n)


def high_confidence(events: DataFrame) -> DataFrame:
    """Events of 0.65 or more by class; low-signal ones count only if no other class is present."""
    good = events.filter("confidence >= 0.65D")
    by_class = good.groupBy("attack_type").agg(F.count(F.lit(1)).alias("events"))
    others = F.sum(F.when(F.col("attack_type") != "LOW_SIGNAL_REVIEW", 1).otherwise(0)).over(Window.partitionBy(F.lit(1)))
    return by_class.withColumn("others", others).filter("attack_type <> 'LOW_SIGNAL_REVIEW' OR others = 0").drop("others")
