"""A classifier of labelled flows: preparation, split, oversampling, multi-class trees, evaluation, and its use on windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Columns of the labelled flows, their names here, the columns that would leak the label, and the classes of its labels.
FEATURES = {"Destination Port": "dst_port", "Flow Duration": "duration", "Total Fwd Packets": "orig_pkts", "Total Backward Packets": "resp_pkts", "Total Length of Fwd Packets": "orig_bytes", "Total Length of Bwd Packets": "resp_bytes", "SYN Flag Count": "syn_flag", "RST Flag Count": "rst_flag", "FIN Flag Count": "fin_flag", "Down/Up Ratio": "down_up_ratio"}
LEAKY = ("Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s")
LABELS = {"DoS Hulk": "DoS", "DoS GoldenEye": "DoS", "DoS slowloris": "DoS_Slow", "DoS Slowhttptest": "DoS_Slow", "Web Attack - Brute Force": "BruteForce", "Web Attack - XSS": "WebAttack", "Bot": "Bot"}
#: Columns of windows that stand for the features.
WINDOW_COLUMNS = {"dst_port": "connections_30s", "duration": "avg_conn_duration_30s", "orig_pkts": "connections_30s", "resp_pkts": "connections_30s", "orig_bytes": "bytes_per_sec_30s", "resp_bytes": "bytes_per_sec_30s", "syn_flag": "burst_score_30s", "rst_flag": "failed_conn_rate_30s", "fin_flag": "outbound_ratio_30s", "down_up_ratio": "outbound_ratio_30s"}
NAMES = tuple(FEATURES.values())
#: Rows among which an oversampled row looks for neighbours, neighbours, and the confidence a prediction needs.
GROUP_ROWS, NEIGHBOURS, LEAST_CONFIDENCE = 1_000, 5, 0.7
#: New rows that one seed makes.
SEED_COPIES = 1_000


def prepared(raw: DataFrame) -> DataFrame:
    """Labelled flows with the ten features and their class: headers trimmed, leaky columns dropped, labels cleaned and
    mapped, other labels and rows with infinite or missing values gone. Columns that are no features stay."""
    rows = raw.toDF(*[c.strip() for c in raw.columns]).drop(*LEAKY)
    label = F.regexp_replace(F.trim("Label"), "�", "-")
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    own = [c for c in rows.columns if c not in FEATURES and c != "Label"]
    values = [F.col(f"`{c}`").cast("double").alias(n) for c, n in FEATURES.items()]
    out = rows.select(*own, known[label].alias("label"), *values).filter("label IS NOT NULL")
    finite = [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) for n in NAMES]
    for f in finite:
        out = out.filter(f)
    return out


def split(rows: DataFrame, key: str, test_percent: int = 20) -> DataFrame:
    """Adds part: test for test_percent of each class (rounded down), by the digest of key; the rest is train.

    Ranks come from (class, digest prefix) groups with offsets, so a class with most rows is no single task."""
    dealt = rows.withColumn("digest", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("bucket", F.substring("digest", 1, 2))
    counts = dealt.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("m"))
    upto, whole = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("label")
    offsets = counts.select("label", "bucket", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("first"), F.sum("m").over(whole).alias("size"))
    within = Window.partitionBy("label", "bucket").orderBy("digest", key)
    ranked = dealt.join(F.broadcast(offsets), ["label", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within))
    part = F.when(F.col("rank") <= F.floor(F.col("size") * test_percent / 100), "test").otherwise("train")
    return ranked.withColumn("part", part).select(*rows.columns, "part")


def nearest(points: np.ndarray, neighbours: int) -> np.ndarray:
    """For each point the places of its nearest neighbours among the others, in standard units; fewer, or none, where there are fewer points."""
    n = len(points)
    k = min(neighbours, n - 1)
    if k < 1:
        return np.zeros((n, 0), np.int64)
    scale = points.std(axis=0)
    x = points / np.where(scale > 0, scale, 1.0)
    squares = (x**2).sum(axis=1)
    distance = squares[:, None] + squares[None, :] - 2 * x @ x.T
    np.fill_diagonal(distance, np.inf)
    return np.argpartition(distance, k - 1, axis=1)[:, :k]


def seeds(train: DataFrame, key: str) -> DataFrame:
    """(label, seed, base, others, first, copies): for ranges of at most SEED_COPIES new rows the row that they start from and its neighbours.

    A class is dealt into groups of about GROUP_ROWS by the digest of key, and neighbours are looked for inside a group;
    its new rows are shared out over its rows by rounded running shares, so that they add up."""
    sizes = train.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("more", F.max("size").over(Window.partitionBy(F.lit(1))) - F.col("size"))  # a row a class
    rows = train.join(sizes, "label").withColumn("deal", F.pmod(F.xxhash64(key), F.ceil(F.col("size") / GROUP_ROWS)).cast("long"))
    before = Window.partitionBy("label").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("label", "deal").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    dealt = rows.join(groups, ["label", "deal"]).filter("more > 0").select("label", "deal", "size", "more", "before", F.col(key).cast("string").alias("seed"), F.array(*[F.col(n).cast("double") for n in NAMES]).alias("base"))

    def neighbours(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seed")
        points = np.array(group["base"].tolist(), float)
        place = group["before"].to_numpy() + np.arange(len(group))
        until = lambda at: at * group["more"].to_numpy() // group["size"].to_numpy()
        others = [points[near].tolist() for near in nearest(points, NEIGHBOURS)]
        return pd.DataFrame({"label": keys[0], "seed": group["seed"], "base": points.tolist(), "others": others, "copies": until(place + 1) - until(place)})

    found = dealt.groupBy("label", "deal").applyInPandas(neighbours, "label string, seed string, base array<double>, others array<array<double>>, copies long").filter("copies > 0")
    ranges = found.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(SEED_COPIES).cast("long"))))
    return ranges.withColumn("copies", F.least(F.col("copies") - F.col("first"), F.lit(SEED_COPIES)))


def oversampled(train: DataFrame, key: str) -> DataFrame:
    """(label, features) of the train rows and of new rows, so that every class has as many rows as the largest one.

    A new row lies between a row of its class and one of its neighbours, both chosen by digests of the row's key and the
    copy's number; a class of one row is copied. Seeds are dealt over all tasks before they are spread, so a class of
    a few rows against millions is no task of its own."""
    dealt = seeds(train, key).repartition(F.xxhash64("label", "seed", "first"))
    each = dealt.withColumn("copy", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    draw = lambda salt: F.xxhash64("label", "seed", "copy", F.lit(salt))
    other = F.coalesce(F.get("others", F.pmod(draw(1), F.greatest(F.size("others"), F.lit(1))).cast("int")), F.col("base"))
    share = F.shiftrightunsigned(draw(2), 11) / F.lit(float(1 << 53))
    made = each.select("label", F.zip_with("base", other, lambda a, b: a + share * (b - a)).alias("x"))
    return train.select("label", *NAMES).unionByName(made.select("label", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(NAMES)]))


def trained(rows: DataFrame, trees: int = 50, depth: int = 8, seed: int = 42):
    """A multi-class forest over (label, features): (label indexer, model)."""
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(rows)
    points = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(indexer.transform(rows))
    return indexer, RandomForestClassifier(labelCol="label_index", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(points)


def predicted(rows: DataFrame, model, least: float | None = None) -> DataFrame:
    """Adds predicted and confidence (the class's probability); with least, rows of more than this confidence."""
    indexer, forest = model
    names = F.array(*[F.lit(x) for x in indexer.labels])
    out = forest.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(rows))
    out = out.withColumn("predicted", names[F.col("prediction").cast("int")]).withColumn("confidence", F.array_max(vector_to_array("probability"))).select(*rows.columns, "predicted", "confidence")
    return out if least is None else out.filter(F.col("confidence") > least)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def evaluation(rows: DataFrame) -> DataFrame:
    """(label, support, right, predicted_n, precision, recall, f1, accuracy) of rows (label, predicted); the counts have a row a pair of classes."""
    pairs = confusion(rows)
    actual = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    named = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    total = pairs.agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    both = actual.join(named, "label", "full").na.fill(0, ["support", "right", "predicted_n"]).crossJoin(F.broadcast(total))
    share = lambda c: F.when(F.col(c) > 0, F.col("right") / F.col(c)).otherwise(0.0)
    f1 = F.when(F.col("right") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return both.withColumn("precision", share("predicted_n")).withColumn("recall", share("support")).withColumn("f1", f1)


def importance(model) -> list[tuple[str, float]]:
    return sorted(zip(NAMES, model[1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def of_windows(windows: DataFrame) -> DataFrame:
    """Windows with the ten features, each from the column that stands for it; a missing column or value counts as 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in windows.columns else F.lit(0.0)
    return windows.select("src_ip", "k", *[value(c).alias(n) for n, c in WINDOW_COLUMNS.items()])
