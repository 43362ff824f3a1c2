"""Evidence of runs and tests: snapshots of data sets, event times, totals, nested exports and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of event times, tried in this order before ISO 8601.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss")


def snapshot(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, rows, last_us): how far each data set (with a column ts_us) has come."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.max("ts_us").alias("last_us")) for name, df in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rows_added(start: DataFrame, stop: DataFrame) -> DataFrame:
    """(dataset, start_row, stop_row, added) between two snapshots; a data set that shrank added none."""
    both = stop.select("dataset", F.col("rows").alias("stop_row")).join(start.select("dataset", F.col("rows").alias("start_row")), "dataset", "left")
    return both.select("dataset", F.coalesce("start_row", F.lit(0)).alias("start_row"), "stop_row", F.greatest(F.col("stop_row") - F.coalesce("start_row", F.lit(0)), F.lit(0)).alias("added"))


def event_time(columns: tuple[str, ...], epoch: str | None = None) -> Column:
    """The time of a row: its first column that is not blank, in one of TIME_FORMATS or ISO 8601 (an offset is dropped:
    wall clock); rows without such a column take epoch, seconds since 1970."""
    text = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])
    wall = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")
    parsed = F.coalesce(*[F.try_to_timestamp(wall, F.lit(f)) for f in TIME_FORMATS], F.try_to_timestamp(wall))
    return F.when(text.isNotNull(), parsed).otherwise(F.timestamp_seconds(F.col(epoch)) if epoch else F.lit(None).cast("timestamp"))


def day_of(ts_us: str = "ts_us") -> Column:
    return F.floor(F.col(ts_us) / 86_400_000_000).cast("long")


def day_class_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(day_of().alias("day"), "attack_type").agg(F.count(F.lit(1)).alias("events"), F.max("confidence").alias("max_confidence"))


def range_totals(per_day: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Events of each class over the days from first to last."""
    kept = per_day.filter(F.col("day") >= first) if first is not None else per_day
    kept = kept.filter(F.col("day") <= last) if last is not None else kept
    return kept.groupBy("attack_type").agg(F.sum("events").alias("events"), F.count_distinct("day").alias("days"))


def export_document(days: DataFrame, per_day: DataFrame) -> DataFrame:
    """One row, one document: days with their measures and class counts, and overall counts. A run's days bound its size."""
    classes = per_day.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("attack_type", "events", "max_confidence"))).alias("classes"))
    nested = days.join(classes, "day", "left").select(F.struct(*days.columns, F.coalesce("classes", F.array().cast("array<struct<attack_type:string,events:bigint,max_confidence:double>>")).alias("classes")).alias("d"))
    overall = per_day.groupBy("attack_type").agg(F.sum("events").alias("events")).agg(F.map_from_entries(F.collect_list(F.struct("attack_type", "events"))).alias("overall"))
    return nested.agg(F.sort_array(F.collect_list("d")).alias("days")).crossJoin(F.broadcast(overall))


def selected_days(days: DataFrame, after: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Days with a report that come after the training day, or lie in a range (with its ends)."""
    for bound, keep in ((after, F.col("day") > F.lit(after)), (first, F.col("day") >= F.lit(first)), (last, F.col("day") <= F.lit(last))):
        days = days.filter(keep) if bound is not None else days
    return days


def live_totals(layers: dict[str, DataFrame], events: DataFrame, flows: DataFrame) -> DataFrame:
    """(measure, n) of the latest day: rows of each layer, suspicious rows, those of high confidence, local sources."""
    today = flows.agg(F.max(day_of()).alias("today"))
    on_day = lambda df: df.join(F.broadcast(today), day_of() == F.col("today"))
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("n"))
    out = count(on_day(events), "suspicious").unionByName(count(on_day(events.filter("confidence >= 0.65D")), "high_confidence"))
    for name, df in layers.items():
        out = out.unionByName(count(on_day(df), f"{name}_rows"))
    local = on_day(flows).filter("src_ip LIKE '192.168.%'").agg(F.lit("local_sources").alias("measure"), F.count_distinct("src_ip").alias("n"))
    return out.unionByName(local)


#: Sections of a test's evidence: column and rows shown.
SECTIONS = {"source": ("src_ip", 15), "destination": ("dst_ip", 15), "port": ("dst_port", 25), "state": ("conn_state", 1000)}


def slice_evidence(flows: DataFrame, risk: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """(section, key, n) of a time slice: its busiest sources, destinations and ports, its connection states, and the
    ten rows of most risk (n: 100 times their risk score)."""
    inside = flows.filter(F.col("ts_us").between(from_us, to_us))
    out = None
    for name, (column, most) in SECTIONS.items():
        top = inside.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(most).select(F.lit(name).alias("section"), "key", "n")
        out = top if out is None else out.unionByName(top)
    high = risk.filter(F.col("ts_us").between(from_us, to_us)).orderBy(F.desc("risk_score"), "src_ip", "k").limit(10)
    return out.unionByName(high.select(F.lit("risk").alias("section"), F.concat_ws("/", "src_ip", "k").alias("key"), F.round(F.col("risk_score") * 100).cast("long").alias("n")))
