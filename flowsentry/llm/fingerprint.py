"""Canonical exact digests of documents.

A text is folded to a canonical form (NFKC, case folding, one blank for each run of white space, trimmed), digested
with 128-bit XXH3, and grouped by that digest; inside a bucket the canonical bytes themselves are the second grouping
key, so two texts share a class only if their bytes are equal.

Edge cases: a null text counts as empty; empty texts share one class; repeated rows are kept; a table without rows
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.common import checked_broadcast, durable, shuffle_partitions, text_or_empty


def canonical(text: str) -> str:
    """NFKC, case folding (then NFKC again, as folding can denormalise), white space folded to single blanks."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


@F.pandas_udf(T.StringType())
def digest_column(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(digest)


@F.pandas_udf(T.BinaryType())
def canonical_bytes(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(lambda t: canonical(t).encode("utf-8", "surrogatepass"))


def likeness(a: Column, b: Column) -> Column:
    """Exact digests are alike or not: 1 or 0."""
    return (a == b).cast("double")


def exact_classes(docs: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, class_id): class_id is the smallest doc_id whose canonical bytes are equal.

    Buckets of one document need no comparison. Texts of the others are grouped by digest and bytes; grouping combines
    in each task first, so a bucket with a third of all rows sends one row a task.
    """
    fps = fingerprints or durable(docs.select("doc_id", digest_column("text").alias("fingerprint")))
    buckets = durable(fps.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").drop("n"))
    shared = checked_broadcast(buckets)
    members = docs.select("doc_id", "text", digest_column("text").alias("fingerprint")).join(shared, "fingerprint").select("doc_id", "fingerprint", canonical_bytes("text").alias("body"))
    bodies = durable(members.groupBy("fingerprint", "body").agg(F.min("doc_id").alias("body_first")).select("fingerprint", "body", "body_first"))
    split = durable(bodies.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint"))
    same = fps.join(shared, "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("first_id", "doc_id").alias("class_id"))
    if split.isEmpty():
        return same
    # Different bytes under one 128-bit digest: those buckets take their classes from the bytes.
    apart = members.join(F.broadcast(split), "fingerprint", "left_semi").join(bodies.select("fingerprint", "body", "body_first"), ["fingerprint", "body"]).select("doc_id", "fingerprint", F.col("body_first").alias("class_id"))
    return same.join(split, "fingerprint", "left_anti").unionByName(apart)


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 doc_ids that split the id range evenly (each starts a range)."""
    if parts < 2:
        return []
    q = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", q, 20 * parts).alias("q")).first()["q"] or []
    return sorted(set(found))


def with_next_document(docs: DataFrame, prepare, fn, schema: str, parts: int | None = None) -> DataFrame:
    """Apply fn(doc_id, text, prepare(text), next_text, prepare(next_text)) -> tuple to every row, where next is the
    row before it in ascending doc_id (after the smallest id, the largest); null texts are passed as "".

    One shuffle of the texts: rows go to id ranges cut at approximate quantiles, each range also gets a copy of the
    largest document of the range below it, and a task walks its sorted ranges holding one earlier text at a time.
    Rows with a null doc_id come first; of rows with the same id, the shorter digest order decides, so reruns agree.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_or_empty().alias("text"))
    cuts = _cuts(docs.select("doc_id"), parts)
    ranged = docs.withColumn("range", F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0))
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))  # a row for each range, so at most parts rows
    by_range = Window.orderBy("range")
    below = F.coalesce(F.lag("top").over(by_range), F.last("top").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    halo = tops.select(F.col("range").alias("to"), below.alias("doc_id")).groupBy("doc_id").agg(F.collect_list("to").alias("to"))
    spread = ranged.join(F.broadcast(halo), "doc_id", "left").select("doc_id", "no_id", "text", F.explode(F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra"))), F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda r: F.struct(r.alias("range"), F.lit(True).alias("extra"))))).alias("at"))
    dealt = spread.select("doc_id", "no_id", "text", "at.range", "at.extra").repartitionByRange(parts, "range").sortWithinPartitions("range", F.col("extra").desc(), "doc_id", F.xxhash64("text"))
    names = [x.split()[0] for x in schema.split(",")]

    def walk(batches):
        at = before = kept = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.range != at:
                    at, before, kept = row.range, "", None
                own = prepare(row.text)
                if not row.extra:
                    out.append(fn(None if row.no_id else row.doc_id, row.text, own, before, kept))
                before, kept = row.text, own
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(walk, schema)


def edited_text(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id: int | None, text: str, own: str, following: str, other: str) -> tuple:
    edited = edited_text(text, following)
    changed = digest(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, float(own == changed), float(own == other))


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and whether they equal its own and the next document's."""
    return with_next_document(docs, digest, _row, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
