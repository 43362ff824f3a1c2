"""Rows of daily tables inside the labelled sessions of a ground-truth manifest.

A session bounds its rows by row numbers of its day's table or, without those, by wall time; an empty list of sources
means any. Sessions are dealt to buckets of rows or of time, and rows meet only the sessions of their bucket, so neither
side is broadcast and a long session is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, and microseconds, in a bucket.
ROWS, SPAN_US = 1 << 16, 600_000_000
SESSION = "session_id string, date string, label string, scenario string, source_ips array<string>, expected_classes array<string>, time_start string, time_end string, row_boundaries struct<risk: struct<start_row: bigint, stop_row: bigint, rows_added: bigint>>"


def wall_time_us(text: Column) -> Column:
    """Microseconds of a wall time, its offset from UTC ignored; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " ")))


def sessions(manifest: DataFrame) -> DataFrame:
    """One row a session from rows with the columns of SESSION and session_index: bounds and lists, blanks as null."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    some = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    risk = "row_boundaries.risk"
    return manifest.select(
        "session_index",
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("scenario", F.concat(F.lit("session_"), F.col("session_index").cast("string"))).alias("scenario"),
        F.lower(F.trim(F.coalesce("label", F.lit("")))).alias("label"),
        blank("date").alias("date"),
        some("source_ips").alias("source_ips"),
        some("expected_classes").alias("expected_classes"),
        F.col(f"{risk}.start_row").alias("start_row"),
        F.col(f"{risk}.stop_row").alias("stop_row"),
        F.col(f"{risk}.rows_added").alias("rows_added"),
        wall_time_us(F.col("time_start")).alias("start_us"),
        wall_time_us(F.col("time_end")).alias("end_us"),
    )


def days(rows: DataFrame) -> DataFrame:
    """(date, day_rows, first_us, last_us) of rows (date, row, src_ip, ts_us)."""
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("day_rows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def checked(found: DataFrame, per_day: DataFrame) -> DataFrame:
    """sessions with their day's figures and the first reason that excludes them, if any."""
    normal, added = F.col("label") == "normal", F.col("rows_added")
    placed = F.col("start_row").isNotNull() | F.col("stop_row").isNotNull()
    why = F.when(~F.col("label").isin("normal", "attack"), "unknown label")
    why = why.when((normal & added.isNull()) | (added <= 0), "no rows added")
    why = why.when(normal & (F.size("source_ips") == 0), "no sources").when(~normal & (F.size("expected_classes") == 0), "no expected classes")
    why = why.when(F.col("date").isNull(), "no date").when(F.col("day_rows").isNull(), "no table of its day")
    bounded = normal | placed
    why = why.when(bounded & (F.col("start_row").isNull() | F.col("stop_row").isNull()), "missing row bounds")
    why = why.when(bounded & ((F.col("start_row") < 0) | (F.col("stop_row") < F.col("start_row"))), "row bounds out of order")
    why = why.when(bounded & (F.col("stop_row") > F.col("day_rows")), "row bounds beyond the table").when(bounded & (F.col("stop_row") == F.col("start_row")), "row bounds select no rows")
    return found.join(per_day, "date", "left").withColumn("by_rows", bounded).withColumn("excluded", why)


def _inside(rows: DataFrame, good: DataFrame, low: Column, high: Column, at: str, width: int) -> DataFrame:
    """rows (with date) whose column at lies in [low, high] of a session of their day and whose source it names, or any."""
    bucket = lambda c: F.floor(c / width)
    dealt = good.select("session_index", F.col("date").alias("session_date"), "source_ips", low.alias("low"), high.alias("high")).filter("low <= high")
    dealt = dealt.withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    met = rows.withColumn("row_bucket", bucket(F.col(at))).join(dealt, (F.col("date") == F.col("session_date")) & (F.col("row_bucket") == F.col("bucket")))
    named = (F.size("source_ips") == 0) | F.array_contains("source_ips", F.col("src_ip"))
    return met.filter((F.col(at) >= F.col("low")) & (F.col(at) <= F.col("high")) & named).drop("row_bucket", "bucket", "session_date", "source_ips", "low", "high")


def session_rows(rows: DataFrame, found: DataFrame, label: str) -> DataFrame:
    """rows (date, row, src_ip, ts_us, ...) inside the checked sessions of a label that nothing excludes, with session_index.

    Normal rows count once, for the first session that holds them; attack rows count for each. A row without a time is
    in no session that is bounded by time."""
    good = found.filter((F.col("label") == label) & F.col("excluded").isNull())
    by_rows = _inside(rows, good.filter("by_rows"), F.col("start_row"), F.col("stop_row") - 1, "row", ROWS)
    by_time = _inside(rows, good.filter("NOT by_rows"), F.coalesce("start_us", "first_us"), F.coalesce("end_us", "last_us"), "ts_us", SPAN_US)
    both = by_rows.unionByName(by_time)
    if label != "normal":
        return both
    return both.withColumn("place", F.row_number().over(Window.partitionBy("date", "row", "src_ip").orderBy("session_index"))).filter("place = 1").drop("place")


def outcomes(found: DataFrame, normal_rows: DataFrame) -> DataFrame:
    """(session_index, scenario, label, date, excluded, matched) of all sessions: a normal one without a row of its own is excluded too."""
    matched = normal_rows.groupBy("session_index").agg(F.count(F.lit(1)).alias("matched"))
    none = (F.col("label") == "normal") & F.col("excluded").isNull() & F.col("matched").isNull()
    return found.join(matched, "session_index", "left").select("session_index", "scenario", "label", "date", F.when(none, "no rows matched").otherwise(F.col("excluded")).alias("excluded"), F.coalesce("matched", F.lit(0)).alias("matched"))


def detection(kept: DataFrame, found: DataFrame, policies: DataFrame, actionable: str, alerting: tuple[str, ...]) -> DataFrame:
    """By policy and attack session that nothing excludes: expected classes found and missed, recall in percent, the same of
    the classes that alert, and the delay of the first kept row from the session's start in seconds.

    kept has the rows (policy, session_index, attack_type, ts_us) that a policy keeps inside sessions, once for each
    session; actionable is the condition on them for an alert. A first row up to 30 s before the start counts as delay 0, for its
    window reaches into the session; an earlier one gives no delay. Without a start or a row there is neither."""
    kinds = lambda c: F.array_sort(F.collect_set(c))
    seen = kept.groupBy("policy", "session_index").agg(kinds("attack_type").alias("detected"), kinds(F.when(F.expr(actionable), F.col("attack_type"))).alias("alerted"), F.min("ts_us").alias("first_kept_us"))
    good = found.filter((F.col("label") == "attack") & F.col("excluded").isNull()).select("session_index", "scenario", "date", F.array_sort(F.array_distinct("expected_classes")).alias("expected"), "start_us")
    every = good.crossJoin(F.broadcast(policies.select("policy")))  # the policies are nine rows
    rows = every.join(seen, ["policy", "session_index"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"detected": F.coalesce("detected", none), "alerted": F.coalesce("alerted", none), "due": F.array_intersect("expected", F.array(*[F.lit(c) for c in alerting]))})
    text = lambda c: F.array_join(F.array_sort(c), ",")
    percent = lambda a, b: F.when(F.size(b) > 0, F.floor(F.size(a) * 1e4 / F.size(b) + 0.5) / 1e2)
    raw = F.when(F.col("first_kept_us") >= F.col("start_us"), F.floor((F.col("first_kept_us") - F.col("start_us")) / 1e6)).otherwise(F.ceil((F.col("first_kept_us") - F.col("start_us")) / 1e6))
    hit, alert = F.array_intersect("expected", "detected"), F.array_intersect("due", "alerted")
    out = rows.withColumn("delay_raw_s", F.when(F.col("start_us").isNotNull() & F.col("first_kept_us").isNotNull(), raw).cast("long"))
    return out.select(
        "policy", "session_index", "scenario", "date",
        text("expected").alias("expected"), F.size(hit).alias("found"), text(F.array_except("expected", "detected")).alias("missed"), percent(hit, F.col("expected")).alias("recall"), text("detected").alias("detected"),
        text("alerted").alias("alerted"), F.size(alert).alias("alerts_found"), text(F.array_except("due", "alerted")).alias("alerts_missed"), percent(alert, F.col("due")).alias("alert_recall"),
        "delay_raw_s",
        F.when(F.col("delay_raw_s") >= -30, F.greatest(F.col("delay_raw_s"), F.lit(0))).alias("delay_s"),
        F.when(F.col("delay_raw_s").isNull(), "unavailable").when(F.col("delay_raw_s") < -30, "before the session").when(F.col("delay_raw_s") < 0, "overlapping window").otherwise("").alias("timing"),
    )
