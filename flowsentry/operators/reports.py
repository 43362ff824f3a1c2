"""Reports of a day's suspicious rows: what a reviewer reads first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.expressions import CLASSES, rounded
from flowsentry.operators.audit import signal_families
from flowsentry.operators.quantiles import measured
from flowsentry.sources.tables import durable

#: Parts of a key's names that are ranked apart before its first few are ranked together.
PARTS = 32


def leading(rows: DataFrame, keys: list[str], name: str, n: int, out: str) -> DataFrame:
    """(keys, out): "name:count" of the key's n most frequent names, ties by name, joined by commas. Null names do not count.

    Names are counted in each task first; of each part of a key's names only n go on, so no task ranks all of them."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("report_n"))
    order = [F.desc("report_n"), F.col(name)]
    first = lambda df, *by: df.withColumn("report_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("report_place") <= n)
    some = first(counts.withColumn("report_part", F.pmod(F.xxhash64(name), F.lit(PARTS))), *keys, "report_part").drop("report_part")
    best = first(some.drop("report_place"), *(keys or [F.lit(1)]))
    text = F.transform(F.array_sort(F.collect_list(F.struct("report_place", F.concat_ws(":", F.col(name), "report_n").alias("t")))), lambda x: x["t"])
    return best.groupBy(*keys).agg(F.array_join(text, ",").alias(out))


def class_report(events: DataFrame, top: int = 3) -> DataFrame:
    """One row for each class, those without events too: count and percent, ends and medians of confidence, risk and anomaly
    scores, most frequent sources and reasons, rows with anomaly score 0, rows that heuristics alone explain."""
    rows = durable(signal_families(events).select("src_ip", "attack_type", "confidence", "risk_score", "anomaly_score", "reasons", "heuristic_only"))
    scores = ("confidence", "risk_score", "anomaly_score")
    plain = rows.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in scores for name, f in (("min", F.min), ("max", F.max))], F.sum(F.when(F.col("anomaly_score") == 0, 1).otherwise(0)).alias("zero_anomaly"), F.sum("heuristic_only").alias("heuristic_only"))
    ranks = measured(["attack_type"], (rows, {c: {"median": 0.5} for c in scores}))
    sources = leading(rows, ["attack_type"], "src_ip", top, "top_sources")
    reasons = leading(rows.select("attack_type", F.explode("reasons").alias("reason")), ["attack_type"], "reason", top, "top_reasons")
    every = rows.sparkSession.createDataFrame([(c,) for c in CLASSES], "attack_type string")
    found = every.join(plain, "attack_type", "left").join(ranks, "attack_type", "left").join(sources, "attack_type", "left").join(reasons, "attack_type", "left")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    medians = [F.expr(rounded(f"{c}_median", 4)).alias(f"median_{c}") for c in scores]
    ends = [F.col(f"{name}_{c}") for c in scores for name in ("min", "max")]
    out = found.crossJoin(F.broadcast(total))  # one row
    return out.select("attack_type", zero("n"), F.expr(rounded("CASE WHEN total > 0 THEN coalesce(n, 0) * 1e2 / total ELSE 0e0 END", 4)).alias("percent"), *ends, *medians, zero("zero_anomaly"), zero("heuristic_only"), F.coalesce("top_sources", F.lit("")).alias("top_sources"), F.coalesce("top_reasons", F.lit("")).alias("top_reasons"))


def _event(best: Column) -> Column:
    return F.concat_ws(",", best["src_ip"], best["k"], best["attack_type"])


def day_report(risk: DataFrame, events: DataFrame, top: int = 5) -> DataFrame:
    """One row a day: risk rows, suspicious ones, the sources with most of these, and the events (source, window, class) of
    greatest confidence and of greatest risk; ties by the other score, then time, source and window, latest and greatest first."""
    day = F.floor(F.col("ts_us") / 86_400_000_000).alias("day")
    rows = durable(events.select(day, "src_ip", "k", "ts_us", "attack_type", "confidence", "risk_score"))
    first = lambda a, b: F.max_by(F.struct("src_ip", "k", "attack_type"), F.struct(a, b, "ts_us", "src_ip", "k"))
    found = rows.groupBy("day").agg(F.count(F.lit(1)).alias("suspicious"), _event(first("confidence", "risk_score")).alias("most_confident"), _event(first("risk_score", "confidence")).alias("riskiest"))
    totals = risk.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
    out = totals.join(found, "day", "left").join(leading(rows, ["day"], "src_ip", top, "top_sources"), "day", "left")
    return out.select("day", "rows", F.coalesce("suspicious", F.lit(0)).alias("suspicious"), "most_confident", "riskiest", F.coalesce("top_sources", F.lit("")).alias("top_sources"))
