"""Live counts by window, and incremental collection.

Streaming windows are epoch-aligned and only those with flows are emitted; late flows beyond the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.expressions import is_noise, rounded


def window_counts(flows: DataFrame, length: str = "30 seconds", slide: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """Per source and sliding window of a stream (or a table) with column ts: counts, distinct ports and addresses, failed rate."""
    rows = flows.filter(f"NOT {is_noise()}").withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", length, slide), "src_ip").agg(F.count(F.lit(1)).alias("connections"), F.size(F.collect_set("dst_port")).alias("ports"), F.size(F.collect_set("dst_ip")).alias("ips"), F.sum(F.expr("CASE WHEN conn_state IN ('REJ', 'S0') THEN 1 ELSE 0 END")).alias("failed"))
    return sums.select("src_ip", F.col("window.end").alias("window_end"), "connections", "ports", "ips", F.expr(rounded("failed * 1e0 / connections", 4)).alias("failed_rate"))


def new_flows(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Incremental collection: no noise, exact repeats within the watermark dropped; the checkpoint keeps the mark."""
    return stream.filter(f"NOT {is_noise()}").withWatermark("ts", late).dropDuplicatesWithinWatermark([c for c in stream.columns if c != "ts"])
