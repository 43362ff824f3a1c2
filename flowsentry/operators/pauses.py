"""Which of a key's alerts go out when each must keep a pause after the last one sent.

Alerts are parted into stretches without a pause; the first of each always goes out. A stretch is cut into buckets of
BUCKET pauses. What a bucket sends depends on the earlier ones only through the last alert they sent, which lies in
the last two pauses before the bucket. So each bucket gives, in a task of its own, a map from those alerts to the last
one that it sends itself; maps of neighbouring buckets are composed by doubling, which takes the logarithm of a
stretch's buckets in rounds, and with its entry known each bucket lists what it sends. However long alerts go on
without a pause, no task sees more than a bucket of them.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.timelines import stretches
from flowsentry.sources.tables import durable

#: Pauses in a bucket.
BUCKET = 64
_ALERT = "struct<ts_us: bigint, id: bigint, risk: double>"


def followers(times: np.ndarray, risks: np.ndarray, pause_us: int, increase: float | None) -> np.ndarray:
    """For each of ascending alerts the next one that goes out if it went out: pause_us or more later, or riskier by increase; or their number."""
    n = len(times)
    after = np.maximum(np.searchsorted(times, times + pause_us), np.arange(n) + 1)
    if increase is None:
        return after
    # Going backwards, rising holds the later alerts that are riskier than all between: negated risks ascend along the list.
    rising: list[tuple[float, int]] = []
    for i in range(n - 1, -1, -1):
        at = bisect_left(rising, (-(risks[i] + increase), n)) - 1
        if at >= 0:
            after[i] = min(after[i], rising[at][1])
        while rising and -rising[-1][0] <= risks[i]:
            rising.pop()
        rising.append((-risks[i], i))
    return after


def _arrays(alerts) -> tuple[np.ndarray, np.ndarray]:
    return np.array([a["ts_us"] for a in alerts], np.int64), np.array([a["risk"] for a in alerts], float)


def _maps(pause_us: int, increase: float | None):
    """(entries, alerts) -> for each entry, or for a start without one, the place of the last alert sent among the last two pauses' alerts."""

    @F.pandas_udf("array<int>")
    def maps(entries: pd.Series, alerts: pd.Series, zones: pd.Series) -> pd.Series:
        out = []
        for entry, own, zone in zip(entries, alerts, zones, strict=True):
            before = [] if entry is None else list(entry)
            times, risks = _arrays([*before, *own])
            after = followers(times, risks, pause_us, increase)
            last = np.where(after < len(times), np.minimum(after, len(times) - 1), np.arange(len(times)))
            while (last[last] != last).any():
                last = last[last]
            starts = last[: max(len(before), 1)] - len(before) - (len(own) - int(zone))
            out.append(np.clip(starts, 0, int(zone) - 1).tolist())
        return pd.Series(out)

    return maps


def _sent(pause_us: int, increase: float | None):
    """(entry, alerts) -> the alerts that go out after the entry, an array of one, or from the first on if it is empty."""

    @F.pandas_udf(f"array<{_ALERT}>")
    def sent(entries: pd.Series, alerts: pd.Series) -> pd.Series:
        out = []
        for entry, own in zip(entries, alerts, strict=True):
            rows = [*entry, *own]
            after = followers(*_arrays(rows), pause_us, increase)
            at, kept = (int(after[0]) if len(entry) else 0), []
            while at < len(rows):
                kept.append({c: rows[at][c] for c in ("ts_us", "id", "risk")})
                at = int(after[at])
            out.append(kept)
        return pd.Series(out)

    return sent


def _entries(buckets: DataFrame, maps: DataFrame) -> DataFrame:
    """(part, place, entry): for each bucket but a stretch's first the index of its entry, by doubling over maps (part, place, map)."""
    known = durable(maps.filter("place = 0").select("part", F.lit(1).alias("place"), F.col("map")[0].alias("entry")))
    steps = durable(maps.filter("place > 0").select("part", "place", "map"))  # entry of place -> entry of place + 1
    reach = 1
    most = buckets.agg(F.max("place").alias("m")).first()["m"]
    while reach < most:
        ahead = known.join(steps, ["part", "place"]).select("part", (F.col("place") + reach).alias("place"), F.get("map", F.col("entry")).alias("entry"))
        later = steps.select("part", (F.col("place") - reach).alias("place"), F.col("map").alias("then"))
        known = durable(known.unionByName(ahead))
        steps = durable(steps.join(later, ["part", "place"]).select("part", "place", F.transform("map", lambda i: F.get("then", i)).alias("map")))
        reach *= 2
    return known


def sent_alerts(alerts: DataFrame, keys: list[str], pause_us: int, increase: float | None = None) -> DataFrame:
    """(keys, ts_us, id, risk) of the alerts (keys, ts_us, id, risk) that go out: the first, then each that comes pause_us or
    more after the last one sent or, given increase, is riskier than it by increase or more. Ties go by id; a null key
    is a key like others."""
    parted = stretches(alerts, keys, pause_us, "stretch", ("id",), closed=False)
    grouped = parted.groupBy(*keys, "stretch", F.floor(F.col("ts_us") / (BUCKET * pause_us)).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("ts_us", "id", "risk"))).alias("alerts"))
    buckets = durable(grouped.withColumn("part", F.to_json(F.struct(*keys, "stretch"))))
    spans = buckets.groupBy("part").agg(F.min("bucket").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    start = F.array().cast(f"array<{_ALERT}>")
    sent = _sent(pause_us, increase)
    if spans.isEmpty():
        found = buckets.withColumn("entry", start)
    else:
        placed = durable(buckets.join(spans, "part", "left").withColumn("place", F.when(F.col("n") > 1, F.col("bucket") - F.col("first")).otherwise(0).cast("int")).withColumn("zone", F.filter("alerts", lambda a: a["ts_us"] >= (F.col("bucket") + 1) * (BUCKET * pause_us) - 2 * pause_us)))
        many = placed.filter("n > 1")
        before = many.select("part", (F.col("place") + 1).alias("place"), F.col("zone").alias("entries"))
        inner = many.filter(F.size("zone") > 0).join(before, ["part", "place"], "left")
        maps = durable(inner.select("part", "place", _maps(pause_us, increase)("entries", "alerts", F.size("zone")).alias("map")))
        entries = _entries(many, maps)
        known = entries.join(before, ["part", "place"]).select("part", "place", F.array(F.get("entries", F.col("entry"))).alias("entry"))
        found = placed.join(known, ["part", "place"], "left").withColumn("entry", F.coalesce("entry", start))
    return found.select(*keys, F.explode(sent("entry", "alerts")).alias("a")).select(*keys, "a.*")


def cooldown(alerts: DataFrame, keys: list[str], pause_us: int) -> DataFrame:
    """(keys, ts_us) of the alerts that are emitted; alerts of one key and time are one."""
    distinct = alerts.select(*keys, "ts_us").distinct().withColumns({"id": F.lit(0).cast("long"), "risk": F.lit(0.0)})
    return sent_alerts(distinct, keys, pause_us).select(*keys, "ts_us")
