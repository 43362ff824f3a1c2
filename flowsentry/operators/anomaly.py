"""Robust scaling, an isolation forest over broadcast arrays, and normalised anomaly scores of windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.expressions import HORIZONS, rounded
from flowsentry.operators.quantiles import measured, quantiles
from flowsentry.operators.windows import features as measures_of
from flowsentry.sources.tables import durable

#: The 12 window measures of each horizon.
FEATURES = tuple(c for h in HORIZONS for c in measures_of(h, 1))
TREES, SAMPLE, GLOBAL_LIMIT = 200, 256, 0.660


def scaling(windows: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row a feature: median and interquartile range (1 where it is 0) over windows with traffic."""
    long = windows.filter("connections_5m > 0").select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    ranks = quantiles(long, ["feature"], "value", {"low": 0.25, "median": 0.5, "high": 0.75})
    return ranks.select("feature", "median", F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low")).alias("iqr"))


def statistics(windows: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row a feature, over windows with traffic: mean, sample standard deviation, median, p95, p99, maximum."""
    long = windows.filter("connections_5m > 0").select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    plain = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("most"))
    ranks = quantiles(long, ["feature"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return plain.join(ranks, "feature").select("feature", *[F.expr(rounded(n, 4)).alias(n) for n in ("mean", "std", "most", "median", "p95", "p99")])


def compared(scored: DataFrame, least: int = 50) -> DataFrame:
    """(src_ip, p50, p90, p99, p999, most of both normalisers): over all windows (src_ip null), and p999 of sources with enough of them.

    The old normaliser stretches each batch's raw scores over [0, 1]; the new one is ``normalised``."""
    ends = scored.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    both = normalised(scored).join(scored.select("src_ip", "k", F.col("raw").alias("own_raw")), ["src_ip", "k"]).crossJoin(F.broadcast(ends))
    old = (F.col("own_raw") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))
    rows = both.select("src_ip", old.alias("old"), F.col("anomaly_score").alias("new"))
    both = durable(rows.select("src_ip", F.col("old").alias("old"), F.col("new").alias("new")))
    at = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    most = lambda names: [F.count(F.lit(1)).alias("windows")] + [F.max(c).alias(f"{c}_most") for c in names]
    overall = both.agg(*most(("old", "new"))).crossJoin(F.broadcast(measured(["all"], (both.withColumn("all", F.lit(1)), {"old": at, "new": at})).drop("all"))).withColumn("src_ip", F.lit(None).cast("string"))
    own = both.groupBy("src_ip").agg(*most(())).filter(F.col("windows") >= least).join(measured(["src_ip"], (both, {c: {"p999": 0.999} for c in ("old", "new")})), "src_ip")
    return overall.unionByName(own, allowMissingColumns=True)


def scaled(windows: DataFrame, scales: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """windows with the features replaced by (x - median) / iqr; absent values count as 0. scales has a row a feature."""
    by = {r["feature"]: r for r in scales.collect()}
    value = lambda c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(by[c]["median"])) / F.lit(by[c]["iqr"]) if c in by else F.lit(0.0)
    return windows.withColumns({c: value(c) for c in columns})


def _length(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tree as rows (feature, threshold, left, right, path length at a leaf); feature -1 marks a leaf."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + _length(len(rows))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth < np.ceil(np.log2(SAMPLE)) and len(spread):
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < cut
            if left.any() and not left.all():
                nodes[at] = [f, cut, build(rows[left], depth + 1), build(rows[~left], depth + 1), 0]
        return at

    build(points, 0)
    return np.array(nodes)


def train_forest(scaled_windows: DataFrame, columns: tuple[str, ...] = FEATURES, trees: int = TREES, seed: int = 42) -> list[np.ndarray]:
    """trees x SAMPLE rows in hash order come to the driver, a fixed bound; each tree takes its own rows."""
    rows = scaled_windows.orderBy(F.xxhash64(F.lit(seed), "src_ip", "k")).limit(trees * SAMPLE).select(*columns).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    return [grow(rows[rng.choice(len(rows), min(SAMPLE, len(rows)), replace=False)], rng) for _ in range(trees)] if len(rows) else []


def raw_scores(x: np.ndarray, forest: list[np.ndarray]) -> np.ndarray:
    """2 ^ (-mean path / c): all rows walk a tree together."""
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), int)
        while (inner := tree[at, 0] >= 0).any():
            rows = np.flatnonzero(inner)
            node = tree[at[rows]]
            left = x[rows, node[:, 0].astype(int)] < node[:, 1]
            at[rows] = np.where(left, node[:, 2], node[:, 3]).astype(int)
        total += tree[at, 4]
    return 2 ** (-total / max(len(forest), 1) / _length(SAMPLE)) if forest else np.zeros(len(x))


def scored(scaled_windows: DataFrame, forest: list[np.ndarray], columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """(src_ip, k, raw) of every window."""
    shared = scaled_windows.sparkSession.sparkContext.broadcast(forest)

    def rate(batches):
        for batch in batches:
            yield pd.DataFrame({"src_ip": batch["src_ip"], "k": batch["k"], "raw": raw_scores(batch[list(columns)].to_numpy(float), shared.value)})

    return scaled_windows.select("src_ip", "k", *columns).mapInPandas(rate, "src_ip string, k long, raw double")


def normalised(raw: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """anomaly_score: raw between the fitted minimum and maximum (limits: low, high), clipped; then above the source's own limit if_p999 or GLOBAL_LIMIT, as a share of what is left."""
    ends = raw.agg(F.min("raw").alias("low"), F.max("raw").alias("high")) if limits is None else limits
    unit = F.when(F.col("high") > F.col("low"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))))).otherwise(0.0)
    return raw.crossJoin(F.broadcast(ends)).select("src_ip", "k", "raw", unit.alias("anomaly_score"))


def adjusted(scores: DataFrame, own: DataFrame | None = None) -> DataFrame:
    rows = scores.join(own.select("src_ip", "if_p999"), "src_ip", "left") if own is not None else scores.withColumn("if_p999", F.lit(None).cast("double"))
    p = F.coalesce("if_p999", F.lit(GLOBAL_LIMIT))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("anomaly_score") - p) / F.greatest(1 - p, F.lit(0.01))))
    return rows.withColumn("anomaly_score", score).withColumn("is_anomaly", (F.col("anomaly_score") > 0.5).cast("int")).drop("if_p999")


def contaminated(scores: DataFrame, share: float = 0.01) -> DataFrame:
    """Flags the rows whose raw score is in the highest share."""
    limit = quantiles(scores.withColumn("all", F.lit(1)), ["all"], "raw", {"limit": 1 - share}).select("limit")
    return scores.crossJoin(F.broadcast(limit)).withColumn("is_anomaly", (F.col("raw") > F.col("limit")).cast("int")).drop("limit")
