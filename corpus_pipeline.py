"""Corpus pipeline: documents in, token counts and digests out.

``STAGES`` runs in order; each function takes (spark, docs, sf_dir), its
result is written as Parquet and read again as the next stage's docs. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereoloom.llm import common, decontaminate, line_dedup, near_dedup, quality
from stereoloom.llm.queries import fitted_quality, production_codec

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: the stages learn a model, build templates, compare sets and merge bytes. tests/llm checks them by brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more).

    Each row is scored by its own text, so repeated rows go or stay together
    and null ids do not matter; null and empty texts get the model's offset.
    """
    scored = quality.score(docs.select("text", *[F.col(x).alias(f"c_{x}") for x in COLUMNS]), fitted_quality(spark, docs, sf_dir), tuple(f"c_{x}" for x in COLUMNS))
    return scored.filter("predicted = 1").select(*[F.col(f"c_{x}").alias(x) for x in COLUMNS])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; every row stays, repeated ones too.

    A null text stays null, with a null ``n_chars``; null ids come last where
    a template's first line is looked for.
    """
    kept = line_dedup.line_dedup(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with its least doc_id, of repeated ids the least by hash, of repeated rows any one.

    A null doc_id counts as the largest. Rows are numbered once in a durable
    cut. Texts without words are no copies of one another and all stay.
    """
    rows = common.durable(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("code"), F.monotonically_increasing_id().alias("row")), "rows")
    return rows.join(near_dedup.first_rows(rows, "code", "row"), "row", "left_semi").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget; null and empty texts hold none, repeated rows go or stay together."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; a null text counts as empty."""
    return production_codec(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.durable(docs, f"stage{i}")
    return docs
