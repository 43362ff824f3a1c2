"""The quality classifier: its parts against definitions, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def test_ratios_follow_their_definition():
    rows, good = [np.array(r, np.int32) for r in ([1, 2], [1, 3], [1, 2, 4], [2, 5], [2])], np.array([1, 1, 1, 0, 0])
    ratios = quality.log_count_ratios(rows, good)
    assert set(np.flatnonzero(ratios).tolist()) == {1, 2}  # in three rows or more
    assert ratios[1] == pytest.approx(np.log((3 + 1) / (7 + 5) / ((0 + 1) / (3 + 5))))
    assert ratios[2] == pytest.approx(np.log((2 + 1) / (7 + 5) / ((2 + 1) / (3 + 5))))


def test_dual_descent_reaches_the_least_loss(monkeypatch):
    """The dual solution's weights make the gradient of the primal squared hinge loss vanish."""
    monkeypatch.setattr(quality, "BITS", 4)
    monkeypatch.setattr(quality, "ROUNDS", 400)
    rng = np.random.default_rng(1)
    rows, good = [np.flatnonzero(rng.random(16) < 0.4).astype(np.int32) for _ in range(60)], rng.integers(0, 2, 60)
    ratios = rng.normal(size=16) * 5
    weights = quality.dual_descent(rows, good, ratios)
    gradient = weights.copy()
    for row, g in zip(rows, good, strict=True):
        x = np.zeros(17)
        x[row] = quality._unit(ratios[row])
        x[16] = 1
        sign, cost = 2 * g - 1, quality.COST * 60 / (2 * (good == g).sum())
        gradient -= 2 * cost * max(0, 1 - sign * (x @ weights)) * sign * x
    assert np.abs(gradient).max() < 1e-6


def test_repeats_and_order_free_hashes():
    plain = " ".join(f"w{i}" for i in range(64))
    assert len(quality.ngrams(plain)) == 64 + 63 and len(quality.ngrams("a " * 64)) > 2
    assert quality.ngrams(plain).tolist() == quality.ngrams(plain.upper()).tolist() and not len(quality.ngrams(" \n"))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r["doc_id"]: r for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in found.items())
    right = {0: [], 1: []}
    for r in labels.collect():
        if found[r["doc_id"]]["held_out"]:
            right[r["quality"]].append(found[r["doc_id"]]["predicted"] == r["quality"])
    assert len(right[0]) > 100 and np.mean(right[0]) > 0.97 and np.mean(right[1]) > 0.99


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "%% ## bad $$ ") * 5) for i in range(80)], "doc_id long, text string")
    told = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], LABELS)
    lied = told.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda labels: sorted(map(tuple, quality.scores(docs, quality.train(docs, labels)).collect()))
    assert scores(told) == scores(lied)
    assert {i: p for i, _, _, p in scores(told)} == {i: i % 2 for i in range(80)}


def test_odd_rows(spark):
    rows = [(None, "x", 1), (1, None, 1), (2, "", 1), (3, "good words here", 1), (3, "good words here", 1), (4, "%% bad", 1), (5, "word " * 30_000, 1), (6, "good words here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    none = docs.limit(0)
    for labels in ([], [(3, 1, 0)], [(i, i % 2, 0) for i in (1, 3, 4, 5, 6, 7)] + [(None, 1, 1), (4, None, 0), (3, 1, 0)]):
        labels = spark.createDataFrame(labels, LABELS)
        model = quality.train(docs, labels)
        got = quality.scores(docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        by = {r["doc_id"]: r["score"] for r in got}
        assert by[1] == by[2] and by[3] == by[6] and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert quality.scores(none, model).collect() == []
    assert quality.scores(docs, quality.train(none, labels)).count() == len(rows)
