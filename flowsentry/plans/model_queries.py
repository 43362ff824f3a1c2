"""Queries of the stored anomaly model, with SQL by hand where a forest has no part."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsentry.operators import anomaly, stored_model, windows
from flowsentry.plans import oracle as o
from flowsentry.plans.queries import query, stored_fit
from flowsentry.sources.flows import flows
from flowsentry.sources.tables import durable, shared_path

_EARLY = f"WITH {o.WINDOWS}, early AS (SELECT * FROM windows WHERE ts_us <= (SELECT (min(ts_us) + max(ts_us)) // 2 FROM windows) AND connections_5m > 0)"
_SCALE = "SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, coalesce(nullif(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25), 0), 1) AS iqr FROM early"
_SCALES = f"{_EARLY}, scales AS ({' UNION ALL '.join(_SCALE.format(c=c) for c in anomaly.FEATURES)})"


@query(f"{_SCALES} SELECT feature, floor(median * 1e6 + 0.5) / 1e6 AS median, floor(iqr * 1e6 + 0.5) / 1e6 AS iqr FROM scales")
def model_scales(spark, d):
    """The scales of all 36 measures, as an earlier fit stored them."""
    return stored_fit(spark, d).scales.select("feature", *[F.expr(f"floor({c} * 1e6 + 5e-1) / 1e6").alias(c) for c in ("median", "iqr")])


@query(f"{_SCALES}, late AS (UNPIVOT (SELECT src_ip, k, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in anomaly.FEATURES)} FROM windows WHERE ts_us > (SELECT (min(ts_us) + max(ts_us)) // 2 FROM windows)) ON {', '.join(anomaly.FEATURES)} INTO NAME feature VALUE x) SELECT feature, count(*) AS n, floor(sum(abs((x - median) / iqr)) * 1e3 + 0.5) / 1e3 AS spread, floor(max((x - median) / iqr) * 1e4 + 0.5) / 1e4 AS most FROM late JOIN scales USING (feature) GROUP BY 1")
def model_scaled(spark, d):
    """How far later windows lie from the earlier fit, by measure."""
    model = stored_fit(spark, d)
    rows = windows.window_features(flows(spark, d))
    half = rows.agg(F.floor((F.min("ts_us") + F.max("ts_us")) / 2).alias("half"))
    late = anomaly.scaled(rows.join(F.broadcast(half), F.col("ts_us") > F.col("half")), model.scales)
    long = late.select(*anomaly.FEATURES).unpivot([], list(anomaly.FEATURES), "feature", "x")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.expr("floor(sum(abs(x)) * 1e3 + 5e-1) / 1e3").alias("spread"), F.expr("floor(max(x) * 1e4 + 5e-1) / 1e4").alias("most"))


@query()
def model_stored_scores(spark, d):
    """Scores of the later windows by the stored model of the earlier ones."""
    rows = durable(windows.window_features(flows(spark, d)))
    half = rows.agg(F.floor((F.min("ts_us") + F.max("ts_us")) / 2).alias("half"))
    folder = shared_path(spark, "model")
    stored_model.fit(rows.join(F.broadcast(half), F.col("ts_us") <= F.col("half")), folder, "first")
    return stored_model.scores(rows.join(F.broadcast(half), F.col("ts_us") > F.col("half")), stored_model.load(spark, folder))
