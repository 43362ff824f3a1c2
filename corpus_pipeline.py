"""A corpus run: toxic documents go, one of each group of near duplicates stays, sources are mixed, sequences packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. Labels are read from sf_dir. Not every stage has a form in SQL, so there is no oracle; the tests hold
every stage against a brute-force version, each on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsentry.llm import mixing, ngram_join, packing, toxicity
from flowsentry.llm.common import discard, documents, durable, table
from flowsentry.llm.queries import bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; all columns stay, whatever their names. Null and empty texts score like texts
    without matches and stay; equal texts fare alike; without toxic labels nothing goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest doc_id (null last): five-word shingles,
    similarity 0.8 or more. Rows without words link with nothing and all stay; of rows equal in id and text one stays;
    rows that share an id but not their texts are told apart."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in training order. Rows without words stay once; a null source is
    a source like others; no text and no column is changed."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; copy tells the rows of one document apart. A null or
    empty text is one piece, its end id; a table without rows gives none."""
    return packing.packed_documents(docs, bpe_path(), copies=True)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, durable(stage(spark, docs, sf_dir))
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
