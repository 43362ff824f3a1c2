"""Sliding-window features of sources, over 30 s, 1 min and 5 min every 30 s.

Every horizon is a multiple of the step and the grid of a source is anchored, so a window is a union of whole panes.
Additive measures are summed by pane first and panes are spread to their windows; distinct counts and entropy use
(pane, port) and (pane, address) counts. Gaps between neighbouring flows are summed by pane too, with the one gap that
crosses into a pane kept apart, so no task has to sort a source's whole day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import FLAG_ANY, FLAGS, HORIZONS, STEP_US, is_local, is_noise, rounded

MOST_STEPS = max(HORIZONS.values())


def anchors(flows: DataFrame, least_flows: int = 10, step: int = STEP_US) -> DataFrame:
    """(src_ip, t0, k_max) for local sources with enough flows; counts and ends are over all flows, noise included."""
    ends = flows.filter(is_local("src_ip")).groupBy("src_ip").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_flows)
    t0 = F.col("a") + F.least(F.lit(step), F.greatest(F.col("b") - F.col("a"), F.lit(1_000_000)))
    return ends.select("src_ip", t0.alias("t0"), F.col("b").alias("last")).select("src_ip", "t0", F.floor((F.col("last") + step - F.col("t0")) / step).cast("long").alias("k_max"))


def grid(ends: DataFrame) -> DataFrame:
    """Every window of every source, empty ones too."""
    return ends.select("src_ip", "t0", F.explode(F.sequence(F.lit(0).cast("long"), "k_max")).alias("k"))


def _spread(panes: DataFrame) -> DataFrame:
    """Each pane once for every window that may hold it; age 0 is the window that ends with the pane."""
    ages = F.explode(F.sequence(F.lit(0), F.lit(MOST_STEPS - 1))).alias("age")
    return panes.select("*", ages).withColumn("k", F.col("pane") + F.col("age")).filter("k >= 0 AND k <= k_max")


def window_features(flows: DataFrame, ends: DataFrame | None = None, step: int = STEP_US) -> DataFrame:
    """(src_ip, k, ts_us, and 12 features for each horizon), one row for each window of each source's grid."""
    ends = anchors(flows) if ends is None else ends
    clean = flows.filter(f"NOT {is_noise()}").join(ends, "src_ip").withColumn("pane", F.floor((F.col("ts_us") - F.col("t0")) / step).cast("long") + 1)
    inside = Window.partitionBy("src_ip", "pane").orderBy("ts_us", "event_id")
    gaps = clean.withColumn("gap", (F.col("ts_us") - F.lag("ts_us").over(inside)) / 1e6)
    panes = gaps.groupBy("src_ip", "pane", "k_max").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr("CASE WHEN conn_state IN ('REJ', 'S0') THEN 1 ELSE 0 END")).alias("failed"),
        F.sum(F.expr("CASE WHEN dst_port = 53 THEN 1 ELSE 0 END")).alias("dns"),
        F.sum(F.expr("CASE WHEN dst_ip LIKE '192.168.%' THEN 0 ELSE 1 END")).alias("external"),
        F.sum(F.expr("coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0)")).alias("bytes"),
        F.sum(F.expr("greatest(coalesce(duration, 0), 0)")).alias("duration"),
        F.count("gap").alias("gaps"),
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_sum"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("gap_squares"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    along = Window.partitionBy("src_ip").orderBy("pane")
    panes = panes.withColumns({"from_pane": F.lag("pane").over(along), "cross": (F.col("first_us") - F.lag("last_us").over(along)) / 1e6})
    aggs = []
    for name, m in HORIZONS.items():
        here = F.col("age") < m
        aggs += [F.sum(F.when(here, F.col(c)).otherwise(0)).alias(f"{c}_{name}") for c in ("n", "failed", "dns", "external", "bytes", "duration")]
        crosses = here & (F.col("k") - F.col("from_pane") < m)
        aggs += [F.sum(F.when(here, F.col(c)).otherwise(0) + F.when(crosses, x).otherwise(0)).alias(f"{c}_{name}") for c, x in (("gaps", F.lit(1)), ("gap_sum", F.col("cross")), ("gap_squares", F.col("cross") * F.col("cross")))]
    sums = _spread(panes).groupBy("src_ip", "k").agg(*aggs)

    held = [F.sum(F.when(F.col("age") < m, F.col("c")).otherwise(0)).alias(f"c_{name}") for name, m in HORIZONS.items()]
    ports = _spread(clean.groupBy("src_ip", "pane", "k_max", "dst_port").agg(F.count(F.lit(1)).alias("c"))).groupBy("src_ip", "k", "dst_port").agg(*held)
    by_port = ports.groupBy("src_ip", "k").agg(*[F.sum(F.when(F.col(f"c_{h}") > 0, 1).otherwise(0)).alias(f"ports_{h}") for h in HORIZONS], *[F.sum(F.when(F.col(f"c_{h}") > 0, F.col(f"c_{h}") * F.log2(f"c_{h}")).otherwise(0.0)).alias(f"plogp_{h}") for h in HORIZONS])
    ips = _spread(clean.groupBy("src_ip", "pane", "k_max", "dst_ip").agg(F.count(F.lit(1)).alias("c"))).groupBy("src_ip", "k", "dst_ip").agg(*held)
    by_ip = ips.groupBy("src_ip", "k").agg(*[F.sum(F.when(F.col(f"c_{h}") > 0, 1).otherwise(0)).alias(f"ips_{h}") for h in HORIZONS])
    joined = grid(ends).join(sums, ["src_ip", "k"], "left").join(by_port, ["src_ip", "k"], "left").join(by_ip, ["src_ip", "k"], "left").na.fill(0)
    return joined.selectExpr("src_ip", "k", f"t0 + k * {step} AS ts_us", *[f"{e} AS {c}" for h, m in HORIZONS.items() for c, e in features(h, m * step // 1_000_000).items()])


def features(h: str, seconds: int) -> dict[str, str]:
    """The 12 features of one horizon from its sums n, failed, dns, external, bytes, duration, gaps, gap_sum, gap_squares, ports, plogp, ips."""
    share = lambda c: f"CASE WHEN n_{h} > 0 THEN {c}_{h} * 1e0 / n_{h} ELSE 0e0 END"
    spread = f"sqrt(greatest(gap_squares_{h} / gaps_{h} - (gap_sum_{h} / gaps_{h}) * (gap_sum_{h} / gaps_{h}), 0e0))"
    return {
        f"connections_{h}": f"CAST(n_{h} AS BIGINT)",
        f"unique_dst_ports_{h}": f"CAST(ports_{h} AS BIGINT)",
        f"unique_dst_ips_{h}": f"CAST(ips_{h} AS BIGINT)",
        f"failed_conn_rate_{h}": rounded(share("failed"), 4),
        f"dns_rate_{h}": rounded(f"dns_{h} * 1e0 / {seconds}", 4),
        f"avg_conn_duration_{h}": rounded(share("duration"), 4),
        f"outbound_ratio_{h}": rounded(share("external"), 4),
        f"bytes_per_sec_{h}": rounded(f"bytes_{h} * 1e0 / {seconds}", 2),
        f"port_entropy_{h}": rounded(f"CASE WHEN n_{h} > 0 THEN greatest(log2(n_{h}) - plogp_{h} / n_{h}, 0e0) / log2(65535) ELSE 0e0 END", 4),
        f"burst_score_{h}": rounded(f"CASE WHEN gaps_{h} > 0 AND gap_sum_{h} > 0 THEN least({spread} / (gap_sum_{h} / gaps_{h} + 1e-9) / 1e1, 1e0) ELSE 0e0 END", 4),
        f"conn_rate_per_ip_{h}": rounded(f"n_{h} * 1e0 / {seconds}", 4),
        f"unique_ports_per_ip_{h}": f"CAST(ports_{h} AS BIGINT)",
    }


def with_flags(windows: DataFrame) -> DataFrame:
    return windows.selectExpr("*", *[f"{e} AS {c}" for c, e in FLAGS.items()]).selectExpr("*", f"{FLAG_ANY} AS flag_any")


def latest(windows: DataFrame) -> DataFrame:
    """The last window of each source."""
    return windows.groupBy("src_ip").agg(F.max_by(F.struct(*[c for c in windows.columns if c != "src_ip"]), "ts_us").alias("w")).select("src_ip", "w.*")


def summary(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("src_ip").agg(F.count(F.lit(1)).alias("windows"), F.sum("flag_any").alias("flagged"), F.max("connections_30s").alias("max_connections"), F.expr(f"{rounded('sum(connections_30s) * 1e0 / count(*)', 4)}").alias("avg_connections"), *[F.sum(f).alias(f) for f in FLAGS])


def network_windows(flows: DataFrame, step: int = STEP_US) -> DataFrame:
    """One grid for the whole network, first window 300 s after the first flow; pane sums are salted by source."""
    ends = flows.groupBy().agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).filter("a IS NOT NULL").select((F.col("a") + 300_000_000).alias("t0"), F.floor((F.col("b") + step - F.col("a") - 300_000_000) / step).cast("long").alias("k_max"))
    clean = flows.filter(f"NOT {is_noise()}").crossJoin(F.broadcast(ends)).withColumn("pane", F.floor((F.col("ts_us") - F.col("t0")) / step).cast("long") + 1)
    panes = clean.groupBy("src_ip", "pane", "k_max").agg(F.count(F.lit(1)).alias("c"))
    by_source = _spread(panes).groupBy("k", "src_ip").agg(*[F.sum(F.when(F.col("age") < m, F.col("c")).otherwise(0)).alias(f"c_{h}") for h, m in HORIZONS.items()])
    per = by_source.groupBy("k").agg(*[x for h in HORIZONS for x in (F.sum(f"c_{h}").alias(f"connections_{h}"), F.max(f"c_{h}").alias(f"busiest_{h}"))])
    return ends.select("t0", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("k_max", F.lit(0)))).alias("k")).join(per, "k", "left").na.fill(0).select("k", (F.col("t0") + F.col("k") * step).alias("ts_us"), *[c for h in HORIZONS for c in (f"connections_{h}", f"busiest_{h}")])


def network_features(flows: DataFrame, step: int = STEP_US) -> DataFrame:
    """(k, ts_us, all measures and flags) of the whole network as if it were one source, noise left out; the first window
    ends the longest horizon after the first flow. Panes are groups of their own, so no task holds more than a step of flows."""
    one = F.lit("network")
    longest = step * MOST_STEPS
    ends = flows.groupBy().agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).filter("a IS NOT NULL")
    ends = ends.select(one.alias("src_ip"), (F.col("a") + longest).alias("t0"), F.floor((F.col("b") + step - F.col("a") - longest) / step).cast("long").alias("k_max")).filter("k_max >= 0")
    return with_flags(window_features(flows.withColumn("src_ip", one), ends, step)).drop("src_ip")
