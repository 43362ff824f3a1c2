"""Per-source baselines: 30 s buckets, percentiles, qualification and threshold lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.expressions import GLOBAL_THRESHOLDS, is_noise, rounded
from flowsentry.operators.quantiles import measured, quantiles

#: Statistic -> (bucket column, percentiles with their names).
PERCENTILES = {"connections_30s": ("n", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}), "unique_dst_ports_30s": ("ports", {"p99": 0.99, "p999": 0.999}), "outbound_ratio_30s": ("outbound", {"p99": 0.99}), "dns_rate_1m": ("dns_1m", {"p99": 0.99, "p999": 0.999})}


def buckets(flows: DataFrame) -> DataFrame:
    """(src_ip, bucket, n, ports, outbound, dns_1m) of the non-empty epoch-aligned 30 s buckets. Distinct ports come from a first grouping by port, so they combine in each task."""
    by_port = flows.filter(f"NOT {is_noise()}").groupBy("src_ip", F.floor(F.col("ts_us") / 30_000_000).cast("long").alias("bucket"), "dst_port").agg(F.count(F.lit(1)).alias("c"), F.sum(F.expr("CASE WHEN dst_ip LIKE '192.168.%' THEN 0 ELSE 1 END")).alias("e"))
    return by_port.groupBy("src_ip", "bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ports"), (F.sum("e") * 1.0 / F.sum("c")).alias("outbound"), (F.sum(F.when(F.col("dst_port") == 53, F.col("c")).otherwise(0)) * 2).alias("dns_1m"))


def profiles(flows: DataFrame, least_flows: int = 500) -> DataFrame:
    """One row for each source: flow_count, use_per_ip, bucket percentiles (linear), flow percentiles."""
    found = buckets(flows)
    per_bucket = found.groupBy("src_ip").agg(*[F.max(c).cast("double").alias(f"{s}_max") for s, c in (("connections_30s", "n"), ("unique_dst_ports_30s", "ports"), ("dns_rate_1m", "dns_1m"))], F.expr(rounded("avg(outbound)", 6)).alias("outbound_ratio_30s_mean"))
    clean = flows.filter(f"NOT {is_noise()}")
    per_flow = clean.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flow_count"), F.max("orig_bytes").alias("orig_bytes_max"))
    of_buckets = found.select("src_ip", *[F.col(c).alias(s) for s, (c, _) in PERCENTILES.items()])
    ranks = measured(["src_ip"], (of_buckets, {s: ps for s, (_, ps) in PERCENTILES.items()}), (clean, {"orig_bytes": {"p99": 0.99}, "duration": {"p99": 0.99}}))
    joined = per_flow.join(per_bucket, "src_ip").join(ranks, "src_ip", "left")
    order = ["src_ip", *[f"{s}_{p}" for s, (_, ps) in PERCENTILES.items() for p in ps], *[c for c in per_bucket.columns if c != "src_ip"], "flow_count", "orig_bytes_p99", "orig_bytes_max", "duration_p99"]
    exact = set(ranks.columns) - {"src_ip"}
    out = joined.select(*[F.expr(rounded(c, 6)).alias(c) if c in exact else F.col(c) for c in order])
    return out.withColumn("use_per_ip", (F.col("flow_count") >= least_flows).cast("int")).withColumn("reason", F.when(F.col("use_per_ip") == 0, F.concat(F.lit("flows below "), F.lit(least_flows))))


#: Thresholds of a source: its own where it qualifies and has the statistic, else the global ones (entropy and burst have no own).
LOOKUP = {
    "thr_connections": f"coalesce(CASE WHEN use_per_ip = 1 THEN connections_30s_p999 END, {GLOBAL_THRESHOLDS['connections']}e0)",
    "thr_ports": f"coalesce(CASE WHEN use_per_ip = 1 THEN unique_dst_ports_30s_p999 END, {GLOBAL_THRESHOLDS['ports']}e0)",
    "thr_entropy": f"{GLOBAL_THRESHOLDS['entropy']}e0",
    "thr_burst": f"{GLOBAL_THRESHOLDS['burst']}e0",
    "thr_dns": f"coalesce(CASE WHEN use_per_ip = 1 THEN dns_rate_1m_p999 END, {GLOBAL_THRESHOLDS['dns']}e0)",
}


def with_thresholds(windows: DataFrame, found: DataFrame) -> DataFrame:
    own = found.select("src_ip", "use_per_ip", "connections_30s_p999", "unique_dst_ports_30s_p999", "dns_rate_1m_p999")
    return windows.join(own, "src_ip", "left").selectExpr(*windows.columns, *[f"{e} AS {c}" for c, e in LOOKUP.items()])


def with_score_limits(found: DataFrame, scored: DataFrame, least: int = 100) -> DataFrame:
    """Baselines with anomaly percentiles of sources with enough windows; unknown sources are added as not qualified."""
    ranks = quantiles(scored, ["src_ip"], "anomaly_score", {"if_p99": 0.99, "if_p999": 0.999})
    limits = ranks.filter(F.col("n") >= least).select("src_ip", F.round("if_p99", 4).alias("if_p99"), F.round("if_p999", 4).alias("if_p999"))
    return found.join(limits, "src_ip", "full").withColumn("use_per_ip", F.coalesce("use_per_ip", F.lit(0)))


def coverage(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("sources"), F.sum("use_per_ip").alias("own_baseline"), F.sum(1 - F.col("use_per_ip")).alias("fallback"))
