"""Values along a key's time line without sorting a key's whole history in one task.

Rows are dealt by (key, bucket of the ordering column); windows run inside buckets, and what earlier buckets hold comes
from a small table with a row for each key and bucket. A null key is a key like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.sources.tables import durable

_BUCKET, _CARRIED = "timeline_bucket", "timeline_carried"


def _with_carried(rows: DataFrame, keys: list[str], order: str, width: int, of_bucket: Column, carried: Column) -> DataFrame:
    """rows with their bucket, and carried: a window expression over of_bucket along the key's buckets."""
    dealt = rows.withColumn(_BUCKET, F.floor(F.col(order) / width))
    buckets = dealt.groupBy(*keys, _BUCKET).agg(of_bucket.alias(_CARRIED)).withColumn(_CARRIED, carried)
    same = F.col(f"r.{_BUCKET}").eqNullSafe(F.col(f"b.{_BUCKET}"))
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    return dealt.alias("r").join(buckets.alias("b"), same).select("r.*", f"b.{_CARRIED}")


def previous(rows: DataFrame, keys: list[str], order: str, value: str, width: int, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds name: the value of the key's row before this one, null on its first."""
    last = F.max_by(value, F.struct(order, *ties))
    found = _with_carried(rows, keys, order, width, last, F.lag(_CARRIED).over(Window.partitionBy(*keys).orderBy(_BUCKET)))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(order, *ties)
    before = F.when(F.row_number().over(inside) == 1, F.col(_CARRIED)).otherwise(F.lag(value).over(inside))
    return found.withColumn(name, before).drop(_BUCKET, _CARRIED)


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, width: int, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds name: the sum of value over the key's rows up to this one."""
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    found = _with_carried(rows, keys, order, width, F.sum(value), F.sum(_CARRIED).over(earlier))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn(name, F.coalesce(F.col(_CARRIED), F.lit(0)) + F.sum(value).over(inside)).drop(_BUCKET, _CARRIED)


def stretches(rows: DataFrame, keys: list[str], gap_us: int, name: str, ties: tuple[str, ...] = (), closed: bool = True) -> DataFrame:
    """Adds name: 1, 2, ... for the key's stretches of time; a gap of more than gap_us starts a new one (closed: or of gap_us itself does not)."""
    rows = durable(rows)  # read four times
    width = max(64 * gap_us, 1)
    before, new = "timeline_before", "timeline_new"
    gap = F.col("ts_us") - F.col(before)
    joined = gap <= gap_us if closed else gap < gap_us
    marked = durable(previous(rows, keys, "ts_us", "ts_us", width, before, ties).withColumn(new, F.when(joined, 0).otherwise(1)))
    return running_sum(marked, keys, "ts_us", new, width, name, ties).drop(before, new)


def swept(rows: DataFrame, deltas: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    """rows with name: the sum of delta over the key's deltas (keys, ts_us, delta) at or before the row's time.

    Deltas of one time are summed in each task before they are dealt; rows come after the deltas of their time."""
    delta, after = "timeline_delta", "timeline_after"
    sums = deltas.groupBy(*keys, "ts_us").agg(F.sum("delta").alias(delta)).withColumn(after, F.lit(0))
    line = durable(rows.withColumn(delta, F.lit(0).cast("long")).withColumn(after, F.lit(1)).unionByName(sums, allowMissingColumns=True))  # read twice
    return running_sum(line, keys, "ts_us", delta, width, name, (after,)).filter(f"{after} = 1").drop(delta, after)
