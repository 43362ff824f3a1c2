"""Shared helpers of the text operators: reading tables, durable intermediate tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words, wherever this package counts or splits words.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a side that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = tempfile.mkdtemp(prefix="flowsentry-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowsentry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind durable frames, once all that was read from them is durable itself."""
    for df in frames:
        files = df.inputFiles()
        folder = files[0].rpartition("/")[0] if files else ""
        if folder.rpartition("/")[2].startswith("flowsentry-"):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes of a named wide column in a side that may be broadcast.
BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, wide: str | None = None) -> DataFrame:
    """Broadcast df if it has at most limit rows (and at most BROADCAST_BYTES in its column wide); else leave the join
    to a shuffle, where AQE splits skewed keys.

    Give it a durable or otherwise cheap frame: it is counted first.
    """
    size = F.sum(F.length(F.col(wide).cast("string"))) if wide else F.lit(0)
    found = df.agg(F.count(F.lit(1)).alias("rows"), size.alias("size")).first()
    return F.broadcast(df) if found["rows"] <= limit and (found["size"] or 0) <= BROADCAST_BYTES else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
