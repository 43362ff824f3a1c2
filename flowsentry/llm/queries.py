"""The queries of the text operators, over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import fingerprint, html_extract, lm_score, media, mixing, ngram_join, packing, periodic, prefix_trie, quality, token_counts, toxicity, warc
from flowsentry.llm.common import documents, durable, table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = durable(fingerprint.fingerprints_with_edits(docs))
    classes = fingerprint.exact_classes(docs, rows.select("doc_id", "fingerprint")).dropDuplicates(["doc_id", "fingerprint"]).withColumnsRenamed({"doc_id": "class_doc", "fingerprint": "class_print"})
    same = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("fingerprint") == F.col("class_print"))
    return rows.join(classes, same, "left").drop("class_doc", "class_print")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), bpe_path())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), bpe_path()).drop("copy")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, sf_dir))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm_score.cross_entropy_difference(docs, *lm_score.train(docs, table(spark, sf_dir, "labels")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.with_media(documents(spark, sf_dir)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(documents(spark, sf_dir))


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in (op1_fingerprints, op2_warc, op3_html, op4_ngram_join, op5_token_counts, op6_packing, op7_mixing, op8_lm_scores, op9_media, op10_toxicity, op11_prefix_trie, op12_quality, op13_periodic_runs)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op7_mixing": mixing.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
