"""A stored model scores alike in every run, and by its own limits."""

import pytest
from pyspark.sql import functions as F

from flowsentry.operators import anomaly, stored_model, windows
from flowsentry.sources.flows import flows


def rows_of(spark):
    return windows.window_features(flows(spark, "/root/testdata/sf0.001"))


def test_a_loaded_model_scores_as_the_fit_did(spark, tmp_path):
    rows = rows_of(spark).persist()
    early, late = rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1")
    assert len(anomaly.FEATURES) == 36 and set(anomaly.FEATURES) < set(rows.columns)
    model = stored_model.fit(early, str(tmp_path), "2024-01-01")
    first = sorted(map(tuple, stored_model.scores(late, model).collect()))
    again = sorted(map(tuple, stored_model.scores(late, stored_model.load(spark, str(tmp_path))).collect()))
    assert first == again and len(first) == late.count() and all(0 <= r[3] <= 1 for r in first)
    limits = model.limits.first()
    trained = stored_model.raw_of(early, model).agg(F.min("raw"), F.max("raw"), F.count("raw"), F.percentile("raw", F.lit(0.99))).first()
    assert (limits["low"], limits["high"], limits["training_windows"]) == tuple(trained)[:3] and limits["p99"] == pytest.approx(trained[3])
    rows.unpersist()


def test_other_windows_do_not_move_a_score(spark, tmp_path):
    rows = rows_of(spark).limit(300).persist()
    model = stored_model.fit(rows, str(tmp_path), "1")
    wild = rows.limit(1).select("src_ip", F.lit(10**6).cast("long").alias("k"), *[(F.col(c) * 0 + 10**9).cast(rows.schema[c].dataType).alias(c) for c in anomaly.FEATURES])
    alone = {tuple(r) for r in stored_model.scores(rows, model).collect()}
    beside = {tuple(r) for r in stored_model.scores(rows.select(*wild.columns).unionByName(wild), model).collect() if r["k"] < 10**6}
    assert alone == beside
    rows.unpersist()


def test_versions(spark, tmp_path):
    rows = rows_of(spark)
    stored_model.fit(rows.limit(50), str(tmp_path), "a")
    stored_model.fit(rows.limit(80), str(tmp_path), "b")
    stored_model.fit(rows.limit(60), str(tmp_path), "a")  # in place of the first
    assert stored_model.versions(spark, str(tmp_path)) == ["a", "b"]
    assert [stored_model.load(spark, str(tmp_path), v).limits.first()["training_windows"] for v in (None, "a")] == [80, 60]
    with pytest.raises(ValueError, match="no model c"):
        stored_model.load(spark, str(tmp_path), "c")
