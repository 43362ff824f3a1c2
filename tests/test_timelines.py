"""Time lines in buckets against whole histories, with a source that holds 40 % of all rows."""

import numpy as np
from pyspark.sql import functions as F

from flowsentry.operators import calibrate, pauses, timelines


def test_time_lines_equal_whole_histories(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else "hot" if rng.random() < 0.4 else f"s{rng.integers(5)}", int(rng.integers(0, 4000)), i) for i in range(400)]
    frame = spark.createDataFrame(rows, "src_ip string, ts_us long, id long")
    before = {r["id"]: r["before"] for r in timelines.previous(frame, ["src_ip"], "ts_us", "ts_us", 50, "before", ("id",)).collect()}
    total = {r["id"]: r["total"] for r in timelines.running_sum(frame, ["src_ip"], "ts_us", "id", 50, "total", ("id",)).collect()}
    stretch = {r["id"]: r["part"] for r in timelines.stretches(frame, ["src_ip"], 20, "part", ("id",)).collect()}
    kept = {tuple(r) for r in pauses.cooldown(frame, ["src_ip"], 100).collect()}
    assert len(before) == len(total) == len(stretch) == 400
    want = set()
    for source in {r[0] for r in rows}:
        last, summed, part, sent = None, 0, 0, None
        for _, t, i in sorted((r for r in rows if r[0] == source), key=lambda r: r[1:]):
            summed, part = summed + i, part + (last is None or t - last > 20)
            assert (before[i], total[i], stretch[i]) == (last, summed, part)
            if sent is None or t - sent >= 100:
                sent = t
                want.add((source, t))
            last = t
    assert kept == want
    assert timelines.stretches(frame.limit(0), ["src_ip"], 20, "part").count() == pauses.cooldown(frame.limit(0), ["src_ip"], 100).count() == 0


def test_due_alerts_equal_one_pass(spark):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.choice([30, 90, 700], 60)) * 1_000_000
    rows = [("a", "X", "actionable", int(t), i, float(rng.integers(20, 45))) for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "src_ip string, attack_type string, decision string, ts_us long, k long, risk_score double")
    want, last = [], None
    for *_, t, k, r in rows:
        if last is None or t - last[0] >= 600_000_000 or r >= last[1] + 10:
            last = (t, r)
            want.append(k)
    assert [r["k"] for r in calibrate.due_alerts(frame).orderBy("k").collect()] == want
    assert calibrate.due_alerts(frame.withColumn("decision", F.lit("reviewed"))).count() == 0
