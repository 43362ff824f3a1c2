"""Pauses, perimeter scans and login levels in buckets against one pass over each key's whole history."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsentry.operators import pauses, state


def fold(rows, pause, increase=None):
    """(key, time, id) of the alerts that go out, key by key in one pass."""
    out = set()
    for key in {r[0] for r in rows}:
        last = None
        for _, t, i, risk in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if last is None or t - last[0] >= pause or (increase is not None and risk >= last[1] + increase):
                last = (t, risk)
                out.add((key, t, i))
    return out


def alerts(seed, n):
    """An endless stretch of random gaps, one of a fixed gap (whose chains never meet), a sparse key, a null key; with ties."""
    rng = np.random.default_rng(seed)
    rows = [("dense", int(t), i) for i, t in enumerate(np.cumsum(rng.integers(0, 40, n)))]
    rows += [("even", 7 * i, i) for i in range(n)] + [("sparse", 450 * i, i) for i in range(20)] + [(None, int(t), i) for i, t in enumerate(rng.integers(0, 9000, 60))]
    return [(*r, float(rng.integers(0, 50))) for r in rows]


@pytest.mark.parametrize(("bucket", "increase"), [(3, None), (4, 25.0), (64, 25.0), (1 << 20, None)])
def test_sent_alerts_equal_one_pass(spark, monkeypatch, bucket, increase):
    monkeypatch.setattr(pauses, "BUCKET", bucket)
    rows = alerts(bucket, 900)
    frame = spark.createDataFrame(rows, "key string, ts_us long, id long, risk double")
    found = pauses.sent_alerts(frame, ["key"], 100, increase)
    got = [(r["key"], r["ts_us"], r["id"]) for r in found.collect()]
    assert set(got) == fold(rows, 100, increase) and len(got) == len(set(got)) > 200
    assert pauses.sent_alerts(frame.limit(0), ["key"], 100, increase).collect() == []


def test_followers_by_definition():
    rng = np.random.default_rng(1)
    for increase in (None, 0.0, 5.0, 20.0):
        times, risks = np.sort(rng.integers(0, 300, 200)), rng.integers(0, 40, 200).astype(float)
        want = [next((j for j in range(i + 1, 200) if times[j] - times[i] >= 30 or (increase is not None and risks[j] >= risks[i] + increase)), 200) for i in range(200)]
        assert pauses.followers(times, risks, 30, increase).tolist() == want


def test_an_endless_stretch_spreads_over_tasks(spark, monkeypatch):
    """200,000 alerts of one key without a pause: every group that a task holds is one bucket of them."""
    frame = spark.range(200_000).selectExpr("'hot' AS key", "id * 3 + id % 2 AS ts_us", "id", "0D AS risk")
    times = [i * 3 + i % 2 for i in range(200_000)]
    want, last = [], None
    for t in times:
        if last is None or t - last >= 100:
            want.append(t)
            last = t
    sizes = []
    monkeypatch.setattr(pauses, "durable", lambda df, keep=pauses.durable: keep(df) if "alerts" not in df.columns or "place" in df.columns else sizes.append(x := keep(df)) or x)
    got = sorted(r["ts_us"] for r in pauses.cooldown(frame, ["key"], 100).collect())
    assert got == want
    assert sizes[0].agg(F.max(F.size("alerts")).alias("m")).first()["m"] <= 64 * 100 / 3 + 2 and sizes[0].count() > 80


def test_perimeter_scans_equal_trailing_sets(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 13 == 0 else "hot" if rng.random() < 0.5 else f"s{rng.integers(3)}", int(rng.integers(0, 6000)), i, None if rng.random() < 0.05 else int(rng.integers(0, 9))) for i in range(500)]
    frame = spark.createDataFrame(rows, "src_ip string, ts_us long, event_id long, dst_port long")
    for window, least in ((30, 2), (200, 4), (0, 1)):
        trailing = Window.partitionBy("src_ip").orderBy("ts_us").rangeBetween(-window, 0)
        want = frame.withColumn("ports", F.size(F.collect_set("dst_port").over(trailing)).cast("long")).filter(F.col("ports") >= least).select("src_ip", "ts_us", "event_id", "ports")
        got = state.perimeter_scans(frame, least, window)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert state.perimeter_scans(frame.limit(0)).collect() == []


def one_task_levels(logins, window_us):
    along = Window.partitionBy("ip").orderBy("ts_us", "event_id")
    marked = logins.withColumn("segment", F.sum(F.when(F.col("outcome") == "success", 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    counted = marked.filter("outcome = 'fail'").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ip", "segment").orderBy("ts_us").rangeBetween(-(window_us - 1), 0)))
    rank = F.when(F.col("n") >= 10, 3).when(F.col("n") >= 5, 2).when(F.col("n") >= 3, 1)
    ranked = counted.withColumn("rank", rank).filter("rank IS NOT NULL")
    last = F.lag("rank").over(Window.partitionBy("ip", "segment").orderBy("ts_us", "event_id"))
    return ranked.withColumn("last", last).filter("last IS NULL OR last <> rank").select("ip", "ts_us", "event_id", "n", F.element_at(F.array(F.lit("warn"), F.lit("alert"), F.lit("ban")), F.col("rank")).alias("level"))


def made_logins(seed, n=700):
    rng = np.random.default_rng(seed)
    return [(None if i % 17 == 0 else "hot" if rng.random() < 0.6 else f"10.0.0.{rng.integers(3)}", int(rng.integers(0, 9000)), i, "success" if rng.random() < 0.03 else "fail") for i in range(n)]


def test_login_levels_equal_one_task(spark):
    for seed in (1, 2):
        frame = spark.createDataFrame(made_logins(seed), "ip string, ts_us long, event_id long, outcome string")
        got, want = state.login_levels(frame, 120), one_task_levels(frame, 120)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 50
    assert state.login_levels(frame.limit(0)).collect() == []
