"""Exact quantiles by key without holding a key's values in one task.

Values are counted by key and value, which combines in each task; a sketch of at most PARTS cut points parts each key's
distinct values into ranges of about equal size; ranks are running sums of counts inside ranges on top of the sums of
the ranges before. The cuts only spread the work: whatever they are, the ranks are exact. The values at the two ranks
next to a quantile are picked by partial minima and interpolated as percentile() does; -0.0 is 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.sources.tables import durable

#: Ranges that a key's distinct values are parted into.
PARTS = 64
#: Distinct values of all keys together up to which a key's values are ranked in one range.
TOGETHER = 500_000


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, null keys equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on).select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])


def _picked(at: float) -> tuple[Column, Column]:
    """The values at the ranks below and above the quantile; a row stands for the ranks [q_upto - q_count, q_upto)."""
    place = (F.col("q_total") - 1) * F.lit(at)
    least = lambda rank: F.min(F.when(F.col("q_upto") > rank, F.col("q_value")))
    return least(F.floor(place)), least(F.ceil(place))


def _ranked_together(counts: DataFrame, keys: list[str]) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy("q_value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"q_upto": F.sum("q_count").over(upto), "q_total": F.sum("q_count").over(Window.partitionBy(*keys))})


def _ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("q_value", [i / PARTS for i in range(1, PARTS)], 1000).alias("q_cuts"), F.sum("q_count").alias("q_total"))
    dealt = _joined(counts, cuts, keys).withColumn("q_part", F.size(F.filter("q_cuts", lambda c: c < F.col("q_value")))).drop("q_cuts")
    earlier = Window.partitionBy(*keys).orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "q_part").agg(F.sum("q_count").alias("q_sum")).withColumn("q_before", F.coalesce(F.sum("q_sum").over(earlier), F.lit(0))).drop("q_sum")
    inside = Window.partitionBy(*keys, "q_part").orderBy("q_value").rowsBetween(Window.unboundedPreceding, 0)
    return _joined(dealt, parts, [*keys, "q_part"]).withColumn("q_upto", F.col("q_before") + F.sum("q_count").over(inside))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, n, and a double for each name of at): exact linear quantiles of the key's values. Null values do not count; a
    key whose values are all null has no row. Without keys give a constant one."""
    counts = durable(rows.select(*keys, F.col(value).cast("double").alias("q_value")).filter("q_value IS NOT NULL").groupBy(*keys, "q_value").agg(F.count(F.lit(1)).alias("q_count")))
    ranked = _ranked(counts, keys) if counts.count() > TOGETHER else _ranked_together(counts, keys)
    ends = {n: _picked(q) for n, q in at.items()}
    found = ranked.groupBy(*keys, "q_total").agg(*[c.alias(f"q_{side}_{n}") for n, pair in ends.items() for side, c in zip(("low", "high"), pair, strict=True)])
    return found.select(*keys, F.col("q_total").alias("n"), *[_between(q, n).alias(n) for n, q in at.items()])


def _between(at: float, name: str) -> Column:
    place, low, high = (F.col("q_total") - 1) * F.lit(at), F.col(f"q_low_{name}"), F.col(f"q_high_{name}")
    return F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def measured(keys: list[str], *tables: tuple[DataFrame, dict[str, dict[str, float]]]) -> DataFrame:
    """(keys, and {column}_{name} for each column and its named quantiles) of tables with the keys, all in one pass. A key
    whose values of a column are all null has null there; one without any value has no row."""
    long = None
    for rows, columns in tables:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")
        part = rows.select(*keys, each).select(*keys, "m.measure", "m.value")
        long = part if long is None else long.unionByName(part)
    columns = {c: at for _, some in tables for c, at in some.items()}
    found = quantiles(long, [*keys, "measure"], "value", {n: q for at in columns.values() for n, q in at.items()})
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == c, F.col(n))).alias(f"{c}_{n}") for c, at in columns.items() for n in at])
