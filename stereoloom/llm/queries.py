"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoloom.llm import bpe, decontaminate, langid, licenses, line_dedup, media, near_dedup, phrases, quality, sharding, source_audit, substring_dedup, url_filter
from stereoloom.llm.sampling import held_out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def production_codec(docs: DataFrame) -> DataFrame:
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production_codec(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(documents(spark, sf_dir)))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding rendered as an image; edited copies of those whose id is divisible by 20 are searched among all.

    A row for each query and image that are linked, with its class and number of links.
    """
    return media.copy_groups(*edited_and_all(spark, sf_dir))


def edited_and_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return media.media_of(rows.filter(F.col("vec_id") % 20 == 0), edit=True), media.media_of(rows)


def image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(*edited_and_all(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~held_out("doc_id", 5, 0)))
    return langid.predict(docs, model).withColumn("held_out", held_out("doc_id", 5, 0)).select("doc_id", "held_out", "lang_pred", "score")


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(documents(spark, sf_dir))


def fitted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.QualityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~held_out("doc_id", 3, 1))
    return quality.fit(docs.select("doc_id", "text"), labels)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, fitted_quality(spark, docs, sf_dir))
    return scored.withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(documents(spark, sf_dir)))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.labelled_urls(spark))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_audit(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = [op1_byte_level_bpe, op2_substring_dedup, op3_benchmark_decontamination, op4_local_descriptors, op5_license_scan,
                 op6_minhash_near_dedup, op7_language_id, op8_hilbert_sharding, op9_quality_classifier, op10_line_dedup, op11_url_filter, op12_phrase_mining, op13_source_audit, pipeline]
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    """The others cannot be said in SQL at whole size; tests/llm holds them against brute force, round trips and held-out rows."""
    return {"op2_substring_dedup": substring_dedup.SQL, "op11_url_filter": url_filter.sql(), "op12_phrase_mining": phrases.SQL, "op13_source_audit": source_audit.SQL}
