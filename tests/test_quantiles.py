"""Exact quantiles against the engine's own percentile, whatever the cuts are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import quantiles


@pytest.mark.parametrize(("parts", "together"), [(2, 0), (64, 0), (64, 500_000)])
def test_quantiles_equal_percentile(spark, monkeypatch, parts, together):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    monkeypatch.setattr(quantiles, "TOGETHER", together)
    rng = np.random.default_rng(parts)
    rows = [(None if i % 7 == 0 else "hot" if rng.random() < 0.5 else f"k{rng.integers(4)}", None if i % 11 == 0 else float(np.round(rng.exponential(5), int(rng.integers(0, 8))))) for i in range(3000)]
    rows += [("one", 3.5), ("same", 2.0), ("same", 2.0), ("none", None), ("signs", 0.5), ("signs", -7.5), ("signs", float("inf"))]
    frame = spark.createDataFrame(rows, "key string, value double")
    at = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p999": 0.999, "p100": 1.0}
    want = frame.filter("value IS NOT NULL").groupBy("key").agg(F.count("value").alias("n"), *[F.percentile("value", F.lit(q)).alias(n) for n, q in at.items()])
    got = quantiles.quantiles(frame, ["key"], "value", at)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert quantiles.quantiles(frame.limit(0), ["key"], "value", at).collect() == []


def test_measured_columns_at_once(spark):
    frame = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 4, None)], "key string, x long, y double")
    got = {r["key"]: tuple(r)[1:] for r in quantiles.measured(["key"], (frame, {"x": {"mid": 0.5}}), (frame, {"y": {"mid": 0.5, "top": 1.0}})).collect()}
    assert got == {"a": (1.5, 5.0, 5.0), "b": (4.0, None, None)}


def test_a_hot_key_is_parted(spark, monkeypatch):
    """No group that is sorted holds more than a share of a key's distinct values."""
    frame = spark.range(50_000).selectExpr("'hot' AS key", "CAST((id * 7919) % 50000 AS DOUBLE) AS value")
    cuts = frame.groupBy("key").agg(F.percentile_approx("value", [i / quantiles.PARTS for i in range(1, quantiles.PARTS)], 1000).alias("cuts"))
    parts = frame.join(cuts, "key").groupBy(F.size(F.filter("cuts", lambda c: c < F.col("value")))).count()
    assert parts.agg(F.max("count")).first()[0] < 3 * 50_000 / quantiles.PARTS
    monkeypatch.setattr(quantiles, "TOGETHER", 0)
    assert quantiles.quantiles(frame, ["key"], "value", {"p50": 0.5}).first()["p50"] == 24_999.5
