"""The anomaly model as versioned tables: scales, trees and score limits of one fit, with which later windows are scored.

Tables scales, trees and limits in a folder are partitioned by version; limits is written last, so a version that it
lists is whole. Scales and limits are exact over all training windows; the forest comes from a fixed number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators.anomaly import FEATURES, normalised, scaled, scaling, scored, train_forest
from flowsentry.operators.quantiles import quantiles
from flowsentry.sources.tables import durable

_NODE = "tree int, node int, feature int, cut double, left int, right int, depth double"


@dataclass
class Model:
    """A loaded fit: a row a feature (feature, median, iqr), trees as arrays of nodes, and one row of limits (low, high, p99, p999, training_windows)."""

    version: str
    scales: DataFrame
    trees: list[np.ndarray]
    limits: DataFrame


def _write(df: DataFrame, folder: str, version: str) -> None:
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(folder)


def fit(windows: DataFrame, folder: str, version: str, columns: tuple[str, ...] = FEATURES) -> Model:
    """Fit scales, forest and limits on windows and store them as version, in place of an earlier fit of that name. Windows
    without traffic count for the forest and the limits, not for the scales. Without windows the limits are null and every score is 0."""
    spark = windows.sparkSession
    rows = durable(windows.select("src_ip", "k", *columns))
    _write(scaling(rows, columns), f"{folder}/scales", version)
    scales = _read(spark, f"{folder}/scales", version, "feature string, median double, iqr double")
    points = scaled(rows, scales, columns)
    trees = train_forest(points, columns)
    nodes = [(t, i, int(n[0]), float(n[1]), int(n[2]), int(n[3]), float(n[4])) for t, tree in enumerate(trees) for i, n in enumerate(tree)]
    _write(spark.createDataFrame(nodes, _NODE), f"{folder}/trees", version)
    raw = durable(scored(points, trees, columns))
    ranks = quantiles(raw.withColumn("all", F.lit(1)), ["all"], "raw", {"p99": 0.99, "p999": 0.999}).select("p99", "p999")
    ends = raw.agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count(F.lit(1)).alias("training_windows"))
    _write(ends.join(ranks, F.lit(True), "left").select("low", "high", "p99", "p999", "training_windows").coalesce(1), f"{folder}/limits", version)
    return load(spark, folder, version)


def _read(spark: SparkSession, folder: str, version: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, version string").parquet(folder).filter(F.col("version") == version).drop("version")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Whole versions, ascending."""
    found = spark.read.schema("low double, version string").parquet(f"{folder}/limits").select("version").distinct()
    return sorted(r["version"] for r in found.collect())


def load(spark: SparkSession, folder: str, version: str | None = None) -> Model:
    """The fit of a version, or of the greatest one."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no model {version or ''} in {folder}")
    version = version or known[-1]
    nodes = _read(spark, f"{folder}/trees", version, _NODE).orderBy("tree", "node").toPandas().to_numpy(float)
    cuts = np.flatnonzero(np.diff(nodes[:, 0])) + 1
    trees = [t[:, 2:] for t in np.split(nodes, cuts)] if len(nodes) else []
    return Model(version, _read(spark, f"{folder}/scales", version, "feature string, median double, iqr double"), trees, _read(spark, f"{folder}/limits", version, "low double, high double, p99 double, p999 double, training_windows long"))


def raw_of(windows: DataFrame, model: Model, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(src_ip, k, raw) of windows by the model's scales and forest."""
    return scored(scaled(windows, model.scales, columns), model.trees, columns)


def scores(windows: DataFrame, model: Model, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(src_ip, k, raw, anomaly_score): raw between the training windows' ends, clipped to [0, 1]; these windows' own ends play no part."""
    return normalised(raw_of(windows, model, columns), model.limits.select("low", "high"))
