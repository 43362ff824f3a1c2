"""Live risk: each micro-batch of windows is scored with the baselines, and the anomaly model, that are the newest when it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators import baselines, risk, stored_model, windows
from flowsentry.streaming.runs import keyed_state

_VERSION = "baseline_version"


def publish(profiles: DataFrame, folder: str, version: int) -> None:
    """Store baselines as a version; a mark is written last, so readers see whole versions only."""
    spark = profiles.sparkSession
    profiles.write.mode("overwrite").parquet(f"{folder}/profiles/{_VERSION}={version}")
    spark.createDataFrame([(version,)], f"{_VERSION} long").coalesce(1).write.mode("append").parquet(f"{folder}/marks")


def newest(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The number and rows of the greatest published version."""
    version = spark.read.schema(f"{_VERSION} long").parquet(f"{folder}/marks").agg(F.max(_VERSION).alias("v")).first()["v"]
    if version is None:
        raise ValueError(f"no baselines in {folder}")
    return version, spark.read.parquet(f"{folder}/profiles/{_VERSION}={version}")


def scored(rows: DataFrame, folder: str, model_folder: str | None = None) -> DataFrame:
    """Risk rows of window rows by the newest baselines (and stored model), with the version that scored them."""
    version, found = newest(rows.sparkSession, folder)
    flagged = windows.with_flags(rows)
    if model_folder is not None:
        model = stored_model.load(rows.sparkSession, model_folder)
        flagged = flagged.join(stored_model.scores(rows, model).select("src_ip", "k", "anomaly_score"), ["src_ip", "k"])
    return risk.risk_rows(baselines.with_thresholds(flagged, found)).withColumn(_VERSION, F.lit(version).cast("long"))


def run_live_risk(stream: DataFrame, folder: str, table: str, checkpoint: str, model_folder: str | None = None) -> None:
    """Score a stream of window rows to its present end. Each micro-batch reads the baselines anew, so a version published
    between two batches counts from the next one on. A batch's rows go to a folder of its own, in place of those of an
    earlier try, so a batch that is run again after a failure counts once."""
    spark = stream.sparkSession
    keyed_state(spark)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read for the scores and for their join
        try:
            scored(kept, folder, model_folder).write.mode("overwrite").parquet(f"{table}/batch={number}")
        finally:
            kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
