"""Data-quality checks of flows and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import is_noise, rounded
from flowsentry.operators.quantiles import quantiles
from flowsentry.operators.timelines import previous

BUCKET_US = 600_000_000
#: Ids of flows that are looked at together for their order of arrival.
ARRIVALS = 100_000
REQUIRED = ("ts_us", "src_ip", "dst_ip", "dst_port", "proto", "conn_state", "orig_bytes", "resp_bytes", "duration")


def null_shares(flows: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Percent of nulls in each column, one row a column."""
    one = flows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "share").select("column_name", F.expr(rounded("share * 100", 4)).alias("null_percent"))


def duplicates(flows: DataFrame) -> DataFrame:
    """Rows beyond the first of each (time, source, destination, port)."""
    keys = flows.groupBy("ts_us", "src_ip", "dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeats"), F.expr(rounded("sum(n - 1) * 1e2 / sum(n)", 4)).alias("percent"))


def time_gaps(flows: DataFrame, minutes: float) -> DataFrame:
    """Gaps of more than minutes between neighbouring flows: start, length. Flows are first reduced to the ends of buckets
    of at most that width, inside which no such gap can lie, so no task sorts them all."""
    limit = int(minutes * 60e6)
    ends = flows.groupBy(F.floor(F.col("ts_us") / min(BUCKET_US, max(limit, 1))).alias("bucket")).agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    before = F.lag("b").over(Window.orderBy("bucket"))
    return ends.withColumn("start_us", before).withColumn("gap_us", F.col("a") - before).filter(F.col("gap_us") > limit).select("start_us", "gap_us")


def longest_gaps(gaps: DataFrame, n: int = 5, warn_minutes: float = 120) -> DataFrame:
    """The n longest gaps, with the number of all, the longest, and the grade: warn if that is above warn_minutes, else info."""
    totals = gaps.agg(F.count(F.lit(1)).alias("gaps"), F.max("gap_us").alias("longest_us"))
    top = gaps.orderBy(F.desc("gap_us"), "start_us").limit(n)
    return top.crossJoin(F.broadcast(totals)).withColumn("grade", F.when(F.col("longest_us") > int(warn_minutes * 60e6), "warn").otherwise("info"))


def source_gaps(flows: DataFrame, seconds: int) -> DataFrame:
    """Each source's gaps of more than seconds: number and longest."""
    timed = previous(flows, ["src_ip"], "ts_us", "ts_us", BUCKET_US, "before_us", ("event_id",))
    gaps = timed.withColumn("gap", F.col("ts_us") - F.col("before_us")).filter(F.col("gap") > seconds * 1_000_000)
    return gaps.groupBy("src_ip").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("longest_us"))


def out_of_order(flows: DataFrame) -> DataFrame:
    """Flows of each source that arrived before an older one."""
    arrived = previous(flows, ["src_ip"], "event_id", "ts_us", ARRIVALS, "before_us")
    return arrived.withColumn("late", (F.col("ts_us") < F.col("before_us")).cast("int")).groupBy("src_ip").agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def variety(flows: DataFrame) -> DataFrame:
    zero = F.expr("CASE WHEN coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) = 0 THEN 1 ELSE 0 END")
    return flows.agg(F.count_distinct("proto").alias("protocols"), F.count_distinct("dst_ip").alias("destinations"), F.sum(zero).alias("zero_byte_rows"), F.count(F.lit(1)).alias("rows"))


def noise_shares(flows: DataFrame) -> DataFrame:
    n = F.expr(f"CASE WHEN {is_noise('dst_ip', 'NULL')} THEN 1 ELSE 0 END")
    p = F.expr(f"CASE WHEN {is_noise('NULL', 'dst_port')} THEN 1 ELSE 0 END")
    return flows.agg(F.sum(n).alias("by_ip"), F.sum(p).alias("by_port"), F.count(F.lit(1)).alias("rows"))


def sudden_drops(flows: DataFrame, share: float = 0.1) -> DataFrame:
    """10-minute buckets since the first flow, empty ones too, with fewer flows than share of the mean."""
    start = flows.agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    counts = flows.crossJoin(F.broadcast(start)).groupBy(F.floor((F.col("ts_us") - F.col("t0")) / BUCKET_US).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = start.filter("t0 IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / BUCKET_US).cast("long"))).alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["n"])
    mean = filled.agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("buckets"))
    return filled.crossJoin(F.broadcast(mean)).filter((F.col("n") < share * F.col("mean")) & (F.col("buckets") >= 3)).select("bucket", "n")


def activity(flows: DataFrame) -> DataFrame:
    """Flows and share by protocol."""
    return flows.groupBy("proto").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.expr(rounded("n * 1e2 / sum(n) OVER (PARTITION BY 1)", 2)))


def hourly(flows: DataFrame) -> DataFrame:
    return flows.groupBy(F.floor(F.col("ts_us") / 3_600_000_000).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def top_external(flows: DataFrame, n: int = 5) -> DataFrame:
    return flows.filter("dst_ip NOT LIKE '192.168.%'").groupBy("dst_ip").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst_ip").limit(n)


def window_coverage(windows: DataFrame, least: int = 100) -> DataFrame:
    return windows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("windows")).withColumn("enough", (F.col("windows") >= least).cast("int"))


HEALTH = ("connections_30s", "unique_dst_ports_30s", "failed_conn_rate_30s", "dns_rate_1m", "burst_score_30s", "port_entropy_30s")


def feature_health(windows: DataFrame, columns: tuple[str, ...] = HEALTH) -> DataFrame:
    """Mean, p99, maximum and whether it varies, for each feature."""
    long = windows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    plain = long.groupBy("feature").agg(F.expr(rounded("avg(value)", 4)).alias("mean"), F.max("value").alias("most"), F.expr("CASE WHEN max(value) > min(value) THEN 1 ELSE 0 END").alias("varies"))
    return plain.join(quantiles(long, ["feature"], "value", {"p99": 0.99}), "feature").select("feature", "mean", F.expr(rounded("p99", 4)).alias("p99"), "most", "varies")


def grade(flows: DataFrame) -> DataFrame:
    """Scores of 100, 60 or 20 for quantity, protocols, destinations and hours, and their mean."""
    facts = flows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("proto").alias("protocols"), F.count_distinct("dst_ip").alias("destinations"), F.count_distinct(F.floor(F.col("ts_us") / 3_600_000_000)).alias("hours"))
    step = lambda c, good, fair: F.when(F.col(c) >= good, 100).when(F.col(c) >= fair, 60).otherwise(20)
    scored = facts.select("n", "protocols", "destinations", "hours", step("n", 5000, 1000).alias("quantity"), step("protocols", 3, 2).alias("protocol_score"), step("destinations", 50, 10).alias("destination_score"), step("hours", 12, 4).alias("hour_score"))
    return scored.withColumn("score", (F.col("quantity") + F.col("protocol_score") + F.col("destination_score") + F.col("hour_score")) / 4.0)


def integrity(flows: DataFrame) -> DataFrame:
    """pass, warn and fail counts of the single checks, score round((10 pass + 5 warn) / total) and status."""
    facts = flows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("proto").alias("protocols"), F.count_distinct("dst_ip").alias("destinations"), F.avg(F.expr("CASE WHEN orig_bytes + resp_bytes = 0 THEN 1e0 ELSE 0e0 END")).alias("zero"), F.avg(F.expr("CASE WHEN src_ip IS NULL OR dst_ip IS NULL OR ts_us IS NULL THEN 1e0 ELSE 0e0 END")).alias("nulls"))
    checks = [F.when(F.col("n") >= 50, "pass").otherwise("fail"), F.when(F.col("nulls") <= 0.05, "pass").otherwise("warn"), F.when(F.col("protocols") >= 2, "pass").otherwise("warn"), F.when(F.col("destinations") >= 2, "pass").otherwise("warn"), F.when(F.col("zero") <= 0.8, "pass").otherwise("warn")]
    rows = facts.select(F.explode(F.array(*checks)).alias("outcome")).agg(*[F.sum(F.when(F.col("outcome") == x, 1).otherwise(0)).alias(x) for x in ("pass", "warn", "fail")], F.count(F.lit(1)).alias("total"))
    return rows.select("pass", "warn", "fail", F.floor((F.col("pass") * 10 + F.col("warn") * 5) * 1.0 / F.col("total") + 0.5).cast("long").alias("score"), F.when(F.col("fail") > 0, "fail").when(F.col("warn") > 2, "warn").otherwise("pass").alias("status"))


def readiness(flows: DataFrame, windows: DataFrame, days: int = 3, records: int = 10_000, least_windows: int = 5_000, gap_hours: int = 6) -> DataFrame:
    """Whether the data suffice for training, one row: the facts, the share of six scores, a verdict and the days still needed.

    Days, records and windows score 1 or 0 and are needed for any training; gaps of more than gap_hours score 1 (none),
    0.5 (up to 3) or 0; a column with over 10 % nulls, or 1 % or more repeated rows, costs half a point. Without rows
    the days still needed are unknown (null).
    """
    facts = {
        "days": flows.agg(F.count_distinct(F.floor(F.col("ts_us") / 86_400_000_000)).alias("value")),
        "records": flows.agg(F.count(F.lit(1)).alias("value")),
        "windows": windows.agg(F.count(F.lit(1)).alias("value")),
        "gaps": time_gaps(flows, gap_hours * 60).agg(F.count(F.lit(1)).alias("value")),
        "sparse_columns": null_shares(flows).agg(F.count_if(F.col("null_percent") > 10).alias("value")),
        "repeats": flows.groupBy(*REQUIRED).agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("value")),
    }
    rows = [frame.select(F.lit(name).alias("fact"), F.col("value").cast("long").alias("value")) for name, frame in facts.items()]
    named = rows[0]
    for row in rows[1:]:
        named = named.unionByName(row)
    one = named.agg(*[F.max(F.when(F.col("fact") == name, F.col("value"))).alias(name) for name in facts])
    return one.selectExpr("*", *readiness_rules(days, records, least_windows))


def readiness_rules(days: int, records: int, least_windows: int) -> list[str]:
    """share, verdict and more_days as SQL over the facts."""
    enough = f"days >= {days} AND records >= {records} AND windows >= {least_windows}"
    step = lambda test, good, other: f"CASE WHEN {test} THEN {good} ELSE {other} END"
    scores = [step(f"days >= {days}", "1e0", "0e0"), step(f"records >= {records}", "1e0", "0e0"), step(f"windows >= {least_windows}", "1e0", "0e0"), step("gaps = 0", "1e0", step("gaps <= 3", "5e-1", "0e0")), step("sparse_columns = 0", "1e0", "5e-1"), step("repeats * 1e2 < records", "1e0", "5e-1")]
    share = rounded(f"({' + '.join(scores)}) / 6e0", 4)
    return [f"{share} AS share", f"CASE WHEN NOT ({enough}) THEN 'not ready' WHEN {share} >= 75e-2 THEN 'ready' ELSE 'improve' END AS verdict", f"CASE WHEN records > 0 THEN CAST(greatest({days} - days, ceil(greatest({records} - records, 0) * 1e0 * days / records), 0) AS BIGINT) END AS more_days"]
