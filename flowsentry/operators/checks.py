"""The full check lists of a day's flows: integrity, daily grade, column quality. One row a check, with its value and outcome.

All facts that need no order come from one aggregation; repeats are counted by grouping, gaps between ends of buckets,
order of arrival in buckets of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.quality import BUCKET_US, duplicates, out_of_order, sudden_drops
from flowsentry.operators.timelines import previous

REQUIRED = ("ts_us", "src_ip", "dst_ip", "dst_port", "duration", "proto", "conn_state")
#: Columns that tell a classifier the label.
LEAKY = ("Flow Bytes/s", "Flow Packets/s", "flow_bytes_per_sec", "flow_packets_per_sec")
GRADES = ("quantity", "missing_values", "repeated_features", "protocols", "destinations", "longest_gap", "hours", "external")


def _rows(one: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row (check, value, outcome) for each check over a frame of one row."""
    each = F.array(*[F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), outcome.alias("outcome")) for name, (value, outcome) in checks.items()])
    return one.select(F.explode(each).alias("c")).select("c.*")


def _beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        one = one.crossJoin(F.broadcast(other))  # every one has one row
    return one


def _missing(flows: DataFrame, columns: tuple[str, ...]) -> Column:
    known = [c for c in columns if c in flows.columns]
    return sum((F.avg(F.col(c).isNull().cast("double")) for c in known), F.lit(0.0)) * 100 / max(len(known), 1)


def _longest_gap(flows: DataFrame) -> DataFrame:
    """(gap_us) of one row: the longest gap between neighbouring flows, null without two; flows are ordered inside time buckets only."""
    timed = previous(flows.filter("ts_us IS NOT NULL").select("ts_us"), [], "ts_us", "ts_us", BUCKET_US, "before_us")
    return timed.agg(F.max(F.col("ts_us") - F.col("before_us")).alias("gap_us"))


def _warn(bad: Column) -> Column:
    return F.when(bad, "warn").otherwise("pass")


def integrity_checks(flows: DataFrame) -> DataFrame:
    """(check, value, outcome) of ten checks; outcome is pass, info, warn or fail. A table without rows warns for few records and for variety."""
    absent = [c for c in REQUIRED if c not in flows.columns]
    zero = F.avg((F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0)) == 0).cast("double")) * 100
    kinds = F.count_distinct(F.when(F.col("proto").isin("tcp", "udp", "icmp"), F.col("proto")))
    facts = flows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(_missing(flows, REQUIRED), F.lit(0.0)).alias("missing"), kinds.alias("kinds"), F.count_distinct("dst_ip").alias("peers"), F.coalesce(zero, F.lit(0.0)).alias("zero"))
    repeats = duplicates(flows).select(F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("percent", F.lit(0.0)).alias("repeat_percent"))
    late = out_of_order(flows.withColumn("src_ip", F.lit("all"))).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
    drops = sudden_drops(flows).agg(F.count(F.lit(1)).alias("drops"))
    minutes = F.col("gap_us") / 60e6
    return _rows(_beside(facts, repeats, _longest_gap(flows), late, drops), {
        "required_columns": (F.lit(len(absent)), F.lit("fail" if absent else "pass")),
        "minimum_records": (F.col("n"), _warn(F.col("n") < 50)),
        "missing_values": (F.round("missing", 2), _warn(F.col("missing") > 5)),
        "duplicates": (F.col("repeats"), _warn(F.col("repeat_percent") > 1)),
        "time_gaps": (F.round(minutes, 1), F.when(minutes > 120, "warn").when(minutes > 60, "info").otherwise("pass")),
        "timestamp_order": (F.col("late"), _warn(F.col("late") > 0)),
        "protocol_variety": (F.col("kinds"), _warn(F.col("kinds") < 2)),
        "ip_variety": (F.col("peers"), _warn(F.col("peers") < 3)),
        "zero_bytes": (F.round("zero", 1), _warn(F.col("zero") > 80)),
        "sudden_drop": (F.col("drops"), _warn(F.col("drops") > 0)),
    })


def integrity_summary(checks: DataFrame) -> DataFrame:
    """Counts of outcomes, score round((10 pass + 5 warn) / checks), and status: fail if any fails, warn if more than two warn, else pass."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(f"{x}ed" if x != "pass" else "passed")
    out = checks.agg(n("pass"), n("warn"), n("fail"), F.count(F.lit(1)).alias("checks"))
    return out.withColumn("score", F.floor((F.col("passed") * 10 + F.col("warned") * 5) / F.col("checks") + 0.5).cast("long")).withColumn("status", F.when(F.col("failed") > 0, "fail").when(F.col("warned") > 2, "warn").otherwise("pass"))


def daily_grades(flows: DataFrame) -> DataFrame:
    """(check, value, outcome) of the eight daily checks, each graded 100, 60 or 20; repeats are rows alike in all but time and addresses."""
    numbers = ("dst_port", "orig_bytes", "resp_bytes", "duration")
    alike = [c for c in flows.columns if c not in ("event_id", "ts_us", "src_ip", "dst_ip")]
    repeats = flows.groupBy(*alike).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1) * 100 / F.sum("c"), F.lit(0.0)).alias("repeats"))
    kinds = F.count_distinct(F.when(F.col("proto").isin("tcp", "udp", "icmp"), F.col("proto")))
    outer = F.avg(F.expr("CASE WHEN dst_ip LIKE '192.168.%' THEN 0e0 ELSE 1e0 END")) * 100
    facts = flows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(_missing(flows, numbers), F.lit(0.0)).alias("missing"), kinds.alias("kinds"), F.count_distinct("dst_ip").alias("peers"), F.count_distinct(F.floor(F.col("ts_us") / 3_600_000_000) % 24).alias("hours"), F.coalesce(outer, F.lit(0.0)).alias("outer"))
    step = lambda good, fair: F.when(good, "100").when(fair, "60").otherwise("20")
    most = lambda c, a, b: step(F.col(c) <= a, F.col(c) <= b)
    least = lambda c, a, b: step(F.col(c) >= a, F.col(c) >= b)
    minutes = F.col("gap_us") / 60e6
    return _rows(_beside(facts, repeats, _longest_gap(flows)), dict(zip(GRADES, (
        (F.col("n"), least("n", 2000, 500)),
        (F.round("missing", 2), most("missing", 2, 10)),
        (F.round("repeats", 2), most("repeats", 2, 5)),
        (F.col("kinds"), least("kinds", 3, 2)),
        (F.col("peers"), least("peers", 20, 3)),
        (F.round(minutes, 1), F.when(minutes.isNull(), "50").otherwise(step(minutes <= 10, minutes <= 60))),
        (F.col("hours"), least("hours", 12, 8)),
        (F.round("outer", 1), step((F.col("outer") >= 20) & (F.col("outer") <= 80), F.col("outer") > 5)),
    ), strict=True)))


def column_quality(rows: DataFrame) -> DataFrame:
    """(check, value, outcome) over all columns: those with more than 10 % nulls, those that leak the label, percent of repeated rows
    (1 % or more is bad), numeric ones with an infinite value; outcome is the score 1, 0.5 or 0."""
    reals = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    named = lambda c: F.col(f"`{c}`")
    sparse = [F.coalesce(F.avg(named(c).isNull().cast("double")), F.lit(0.0)).alias(f"null_{i}") for i, c in enumerate(rows.columns)]
    endless = [F.coalesce(F.max(F.abs(named(c)).eqNullSafe(F.lit(float("inf"))).cast("int")), F.lit(0)).alias(f"inf_{i}") for i, c in enumerate(reals)]
    facts = rows.agg(*sparse, *endless)
    repeats = rows.groupBy(*[named(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias("check_n")).agg(F.coalesce(F.sum(F.col("check_n") - 1) * 100 / F.sum("check_n"), F.lit(0.0)).alias("repeats"))
    high = sum(((F.col(f"null_{i}") > 0.1).cast("int") for i in range(len(rows.columns))), F.lit(0))
    infinite = sum((F.col(f"inf_{i}") for i in range(len(reals))), F.lit(0))
    leaky = sum(c.strip() in LEAKY for c in rows.columns)
    half = lambda bad: F.when(bad, "0.5").otherwise("1")
    return _rows(_beside(facts, repeats), {
        "sparse_columns": (high, half(high > 0)),
        "leaky_columns": (F.lit(leaky), F.lit("0" if leaky else "1")),
        "repeated_rows": (F.round("repeats", 2), half(F.col("repeats") >= 1)),
        "infinite_columns": (infinite, half(infinite > 0)),
    })
