"""Mixing sources to target weights along a curriculum, in built-in DataFrame operations only.

Every source has a weight schedule over training time t in [0, 1]: share(t) = target * (1 + slope * (2 t - 1)). Its
integral from 0 to t, target * (t + slope * (t * t - t)), is the source's cumulative token demand, and the slopes'
target-weighted mean is 0, so the sources together always demand tokens at one rate. A document whose words start at
word u of its source is due when the demand reaches u; inverting the integral (a quadratic) gives its training
position, and documents are range-sorted by position.

Targets: weights 5, 2, 1, repeating over the sources in code point order (null last), share all words; no source takes
more than 3 times its words, and what is above goes to the others by weight. A source is repeated whole as often as
its target allows; one more, partial pass runs over its documents in the order of their keys and ends at the document
nearest to the target, so no text is ever cut.

A document's key is a digest of its id and text. Words are summed by the key's first digits (BUCKET_DIGITS hexadecimal
digits, so a source has 4,096 buckets); u is the bucket's exact start plus the key's share of the bucket's words. So a
row's passes and position follow from the row and two small tables, one row for each source and one for each bucket:
texts are shuffled once, by the final sort, and a source with a third of all rows is spread like any other.

Edge cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; a null id
counts like an id; documents that are not taken have no position; a table without words has targets 0; rows equal in
id and text are taken alike, so reruns agree; further columns stay as they are in ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import WORD, checked_broadcast, discard, durable, free_name, text_or_empty

#: Fixed by the contract.
WEIGHTS, MOST_PASSES = (5.0, 2.0, 1.0), 3
#: Slopes of the sources in turn: later sources come on as the first ones fade.
SLOPES = (-0.4, 0.4, 0.2)
#: Hexadecimal digits of a key that name its bucket, and those after them that place it inside.
BUCKET_DIGITS, PLACE_DIGITS = 3, 10


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def mix_key() -> Column:
    """A digest of a document's id and text, in hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty().cast("binary"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """(source, source_size, target, slope) from rows (source, size): one row for each source.

    The shares are those of repeated resharing: with a common factor f, each source takes min(weight * f, cap). Sources
    in order of cap / weight are at their cap until f is below the next one's ratio. The windows hold a row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (rank % len(xs) + 1).cast("int"))
    ranked = totals.select("source", "source_size", cycle(weights).alias("weight"), cycle(slopes).alias("tilt"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    factored = ranked.select("*", ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)).alias("f"))
    # The first source in this order that is below its cap sets the factor for all after it.
    free = F.min(F.when(F.col("weight") * F.col("f") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("f").alias("f")))).over(whole)["f"]
    aimed = factored.select("source", "source_size", "tilt", F.least(F.col("cap"), F.col("weight") * F.coalesce(free, F.lit(float("inf")))).alias("target"))
    all_of = lambda c: F.sum(c).over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mean = all_of(F.col("tilt") * F.col("target")) / F.greatest(all_of("target"), F.lit(1.0))
    return aimed.select("source", F.col("source_size").cast("long").alias("source_size"), "target", F.round(F.col("tilt") - mean, 12).alias("slope"))


def demand(t: Column, target: Column, slope: Column) -> Column:
    """Words a source has to deliver until time t."""
    return target * (t + slope * (t * t - t))


def due(u: Column, target: Column, slope: Column) -> Column:
    """The time at which the demand reaches u: the root in [0, 1] of slope t^2 + (1 - slope) t - u / target."""
    c = F.least(u / F.greatest(target, F.lit(1e-9)), F.lit(1.0))
    b = 1 - slope
    root = 2 * c / (b + F.sqrt(F.greatest(b * b + 4 * slope * c, F.lit(0.0))))
    return F.when(target <= 0, F.lit(None).cast("double")).otherwise(F.round(F.coalesce(root, F.lit(0.0)), 9))


def _by_source(rows: DataFrame, other: DataFrame, more: Column | None = None) -> DataFrame:
    same = F.col("r.source").eqNullSafe(F.col("o.source"))
    return rows.alias("r").join(checked_broadcast(other).alias("o"), same if more is None else same & more)


def schedule(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Durable tables of rows (source, key, size): sources (source, source_size, target, slope, passes, last) and
    buckets (source, bucket, start, words). A source gives passes whole passes, and one over the keys up to last."""
    bucket = F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    sums = durable(rows.groupBy("source", bucket).agg(F.sum("size").alias("words")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = durable(sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"), "words"))
    aim, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    targets = source_targets(sums.withColumnRenamed("words", "size"))
    aimed = durable(targets.withColumn("passes", F.floor(aim / size)).withColumn("rest", aim - F.col("passes") * size))
    edges = durable(_by_source(buckets, aimed).filter("rest > 0 and start <= rest and rest < start + words").select("r.source", "bucket", "start", "rest"))
    inside = _by_source(rows.withColumn("bucket", bucket), edges, F.col("r.bucket") == F.col("o.bucket")).select("r.source", "r.key", "r.size", "o.start", "o.rest")
    each = inside.groupBy("source", "key", "start", "rest").agg(F.sum("size").alias("size"))
    until = F.col("start") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = each.withColumn("taken", 2 * until + F.col("size") <= 2 * F.col("rest")).filter("taken").groupBy("source").agg(F.max("key").alias("key"))
    ends = edges.alias("r").join(taken.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")), "left").select("r.source", F.coalesce("o.key", "r.bucket").alias("last"))
    sources = durable(aimed.alias("r").join(ends.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")), "left").select("r.source", "source_size", "target", "slope", "passes", F.coalesce("last", F.lit("")).alias("last")))
    discard(sums, aimed, edges)
    return sources, buckets


def _placed(rows: DataFrame, sources: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (source, key, ...) with source_size, target, slope, times (the passes that take the row) and start (words of the source before it)."""
    named = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    of_source = _by_source(named, sources).select("r.*", "o.source_size", "o.target", "o.slope", (F.col("o.passes") + (F.col("r.key") <= F.col("o.last")).cast("int")).cast("int").alias("times"))
    place = F.conv(F.substring("key", BUCKET_DIGITS + 1, PLACE_DIGITS), 16, 10).cast("double") / float(16**PLACE_DIGITS)
    found = _by_source(of_source, buckets, F.col("r.bucket") == F.col("o.bucket"))
    return found.select("r.*", (F.col("o.start") + F.col("o.words") * place).alias("start")).drop("bucket")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size): what mixing needs of documents."""
    return docs.select("doc_id", "source", mix_key().alias("key"), word_count().alias("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position), sorted by training position over all partitions."""
    rows = durable(sized(docs))
    out = _placed(rows, *schedule(rows)).withColumn("taken", F.col("size") * F.col("times"))
    position = F.when(F.col("taken") > 0, due(F.col("start"), F.col("target"), F.col("slope")))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", position.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself, as rows of documents: a document taken k times gives k whole rows, one that is not taken none.
    Rows without words stay once, as they weigh nothing. Each pass of a row has its own training position, and the
    result is range-sorted by it."""
    rows = durable(sized(docs))
    sources, buckets = schedule(rows)
    whole = free_name(docs, "mix_row")
    carried = docs.select(F.struct(*docs.columns).alias(whole), "source", mix_key().alias("key"), F.regexp_like(text_or_empty(), F.lit(WORD)).alias("words"))
    times = F.when(F.col("words"), F.col("times")).otherwise(1)
    passes = _placed(carried, sources, buckets).withColumn("times", times).filter("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    position = F.when(F.col("words"), due(F.col("pass") * F.col("source_size") + F.col("start"), F.col("target"), F.col("slope")))
    return passes.select(whole, position.alias("position"), "key").orderBy(F.col("position").asc_nulls_last(), "key").select(f"{whole}.*")


#: The rows of ``mixed_documents`` over the documents table, in DuckDB's SQL.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][CAST(nth % 3 + 1 AS INT)]::DOUBLE AS weight, [-0.4, 0.4, 0.2][CAST(nth % 3 + 1 AS INT)]::DOUBLE AS tilt, 3.0::DOUBLE * source_size AS cap FROM totals),
factored AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
free AS (SELECT arg_min(f, cap / weight) AS f FROM factored WHERE weight * f <= cap),
targeted AS (SELECT source, source_size, tilt, CASE WHEN (SELECT f FROM free) IS NULL THEN cap ELSE least(cap, weight * (SELECT f FROM free)) END AS target FROM factored),
sloped AS (SELECT source, source_size, target, round(tilt - (SELECT sum(tilt * target) / greatest(sum(target), 1.0) FROM targeted), 12) AS slope, CAST(round(target) AS BIGINT) AS aim FROM targeted),
aimed AS (SELECT *, CAST(floor(aim / greatest(source_size, 1)) AS BIGINT) AS passes FROM sloped),
starts AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(size) OVER (PARTITION BY source, key) AS begun, sum(size) OVER (PARTITION BY source, key) AS alike FROM sized),
buckets AS (SELECT source, substr(key, 1, 3) AS bucket, sum(size) AS words, min(begun) AS first FROM starts GROUP BY 1, 2),
placed AS (
  SELECT s.doc_id, s.source, s.size, a.source_size, a.target, a.slope,
    a.passes + CASE WHEN a.aim - a.passes * a.source_size > 0 AND 2 * s.begun + s.alike <= 2 * (a.aim - a.passes * a.source_size) THEN 1 ELSE 0 END AS times,
    b.first + b.words * (CAST('0x' || substr(s.key, 4, 10) AS BIGINT)::DOUBLE / 1099511627776.0) AS start
  FROM starts s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source JOIN buckets b ON s.source IS NOT DISTINCT FROM b.source AND substr(s.key, 1, 3) = b.bucket),
ratio AS (SELECT *, least(start / greatest(target, 1e-9), 1.0) AS c FROM placed)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * times AS BIGINT) AS taken,
  CASE WHEN size * times > 0 AND target > 0 THEN round(2 * c / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * c, 0.0))), 9) END AS position
FROM ratio
"""
