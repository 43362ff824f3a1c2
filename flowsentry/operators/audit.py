"""Day audits, and audits of detection accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import STEP_US, rounded
from flowsentry.operators.quantiles import measured, quantiles
from flowsentry.operators.timelines import stretches

#: Thresholds whose rows are counted.
COUNTS = {"risk_20": "risk_score >= 20", "risk_30": "risk_score >= 30", "risk_60": "risk_score >= 60", "anomaly_35": "anomaly_score >= 35e-2", "failed_80": "failed_conn_rate_30s >= 8e-1", "conn_80": "connections_30s >= 80", "dns_1": "dns_rate_30s >= 1"}
LABEL = "CASE WHEN windows = 0 THEN 'INCOMPLETE' WHEN risk_30 > 0 OR anomaly_35 >= 3 OR failed_80 >= 50 OR conn_80 >= 10 OR dns_1 >= 5 THEN 'SUSPICIOUS_VALIDATION' WHEN hours >= 20 THEN 'CANDIDATE_CLEAN' WHEN max_risk < 20 THEN 'PARTIAL_CANDIDATE_CLEAN' ELSE 'INCOMPLETE' END"
RANGES = {
    "confidence": "CASE WHEN confidence < 5e-1 THEN '0-0.5' WHEN confidence < 65e-2 THEN '0.5-0.65' WHEN confidence < 8e-1 THEN '0.65-0.8' ELSE '0.8+' END",
    "risk": "CASE WHEN risk_score < 20 THEN '0-20' WHEN risk_score < 30 THEN '20-30' WHEN risk_score < 60 THEN '30-60' ELSE '60+' END",
    "anomaly": "CASE WHEN anomaly_score = 0 THEN '0' WHEN anomaly_score < 35e-2 THEN '0-0.35' WHEN anomaly_score < 7e-1 THEN '0.35-0.7' ELSE '0.7+' END",
}
QUANTILE_FEATURES = ("connections_30s", "unique_dst_ports_30s", "failed_conn_rate_30s", "dns_rate_30s", "burst_score_30s")


def day_audit(risk: DataFrame) -> DataFrame:
    """One row for each day (86,400 s of time): rows, coverage, sources, threshold counts and the suggested label."""
    day = F.floor(F.col("ts_us") / 86_400_000_000).cast("long")
    out = risk.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("src_ip").alias("sources"), F.max("risk_score").alias("max_risk"), F.expr(rounded("(max(ts_us) - min(ts_us)) / 36e8", 4)).alias("hours"), *[F.sum(F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END")).alias(n) for n, c in COUNTS.items()])
    return out.withColumn("label", F.expr(LABEL))


def top_windows(risk: DataFrame, n: int = 10) -> DataFrame:
    best = Window.partitionBy("src_ip").orderBy(*[F.col(c).desc_nulls_last() for c in ("risk_score", "anomaly_score", "connections_30s")], "k")
    return risk.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def suspicious_sources(events: DataFrame) -> DataFrame:
    return events.groupBy("src_ip").agg(F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(f"max_{c}") for c in ("risk_score", "anomaly_score", "failed_conn_rate_30s", "connections_30s", "dns_rate_30s")], F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def retraining(days: DataFrame, least_clean: int = 3) -> DataFrame:
    counts = days.agg(*[F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(n) for n, x in (("suspicious", "SUSPICIOUS_VALIDATION"), ("incomplete", "INCOMPLETE"), ("clean", "CANDIDATE_CLEAN"))])
    return counts.withColumn("recommendation", F.when(F.col("suspicious") > 0, "no").when((F.col("incomplete") > 0) | (F.col("clean") < least_clean), "not yet").otherwise("manual review"))


def distributions(events: DataFrame) -> DataFrame:
    """Events by range of confidence, risk and anomaly."""
    long = events.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.expr(e).alias("bucket")) for n, e in RANGES.items()])).alias("x")).select("x.*")
    return long.groupBy("measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(events: DataFrame) -> DataFrame:
    total = events.agg(F.count(F.lit(1)).alias("total"))
    counts = events.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "n", F.expr(rounded("n * 1e2 / total", 2)).alias("percent"))


#: How a reason begins -> its signal family, tested in this order.
FAMILIES = {"anomaly": "anomaly", "risk": "risk", "connections": "connections", "failed": "failed_connections", "dns": "dns", "flag_dns": "dns", "ports": "scan_spread", "flag_": "flag", "burst": "burst", "bytes": "bytes_rate", "ssh": "ssh_context", "repeated": "repeated_source"}


def signal_families(events: DataFrame) -> DataFrame:
    """Adds signals (families of the reasons), heuristic_only and several_signals (two families beside risk)."""
    family = lambda r: F.coalesce(*[F.when(r.startswith(t), F.lit(f)) for t, f in FAMILIES.items()], F.lit("other"))
    rows = events.withColumn("signals", F.array_sort(F.array_distinct(F.transform("reasons", family))))
    others = F.array_remove("signals", "risk")
    return rows.withColumn("heuristic_only", ((F.col("anomaly_score") == 0) & (F.size("signals") > 0) & ~F.array_contains("signals", "anomaly")).cast("int")).withColumn("several_signals", (F.size(others) >= 2).cast("int"))


def class_breakdown(events: DataFrame) -> DataFrame:
    ends = [F.expr(f"{n}({c})").alias(f"{n}_{c}") for c in ("confidence", "risk_score") for n in ("min", "max")]
    plain = events.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("CASE WHEN anomaly_score = 0 THEN 1 ELSE 0 END")).alias("zero_anomaly"), F.count_distinct("src_ip").alias("sources"), *ends)
    ranks = measured(["attack_type"], (events, {c: {"median": 0.5} for c in ("confidence", "risk_score")}))
    return plain.join(ranks, "attack_type", "left").select("attack_type", "n", "zero_anomaly", "sources", *[x for c in ("confidence", "risk_score") for x in (F.col(f"min_{c}"), F.expr(rounded(f"{c}_median", 4)).alias(f"median_{c}"), F.col(f"max_{c}"))])


def repeated_sequences(events: DataFrame) -> DataFrame:
    """(src_ip, attack_type) with two events or more: count, ends, longest run of neighbouring windows, greatest risk and confidence."""
    parted = stretches(events.select("src_ip", "attack_type", "k", "ts_us", "risk_score", "confidence"), ["src_ip", "attack_type"], STEP_US, "island", ("k",))
    runs = parted.groupBy("src_ip", "attack_type", "island").agg(F.count(F.lit(1)).alias("run"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.max("risk_score").alias("r"), F.max("confidence").alias("c"))
    return runs.groupBy("src_ip", "attack_type").agg(F.sum("run").alias("n"), F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.max("run").alias("longest_run"), F.max("r").alias("max_risk"), F.max("c").alias("max_confidence")).filter("n >= 2")


def feature_quantiles(rows: DataFrame, columns: tuple[str, ...] = QUANTILE_FEATURES) -> DataFrame:
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    at = {f"p{int(q * 100)}": q for q in (0.5, 0.75, 0.9, 0.95, 0.99)}
    return quantiles(long, ["feature"], "value", {**at, "most": 1.0}).select("feature", *[F.expr(rounded(n, 6)).alias(n) for n in at], "most")


def headline(risk: DataFrame, events: DataFrame) -> DataFrame:
    """Share of suspicious rows and the class of most of them."""
    top = events.groupBy("attack_type").agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("attack_type", F.struct("c", "attack_type")).alias("top_class"), F.sum("c").alias("suspicious"))
    return risk.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr("CASE WHEN anomaly_score = 0 THEN 1 ELSE 0 END")).alias("zero_anomaly")).crossJoin(F.broadcast(top)).select("rows", "zero_anomaly", F.coalesce("suspicious", F.lit(0)).alias("suspicious"), "top_class", F.expr(rounded("coalesce(suspicious, 0) * 1e2 / rows", 4)).alias("percent"))
