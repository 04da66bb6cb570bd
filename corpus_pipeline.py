"""From raw documents to token digests: quality rules, near-duplicates, decontamination, personal data, tokens.

Every stage but the last returns the columns of ``documents``; each works on all that the one before kept.

Defined cases: a null or empty text fails the quality rules and goes. Rows that repeat an id and a text stay or go
together; of near-duplicates the rows of the smallest id stay, and rows without an id always pass that stage. Very
long texts go through whole. Empty tables give an empty result. Further columns of ``documents``, whatever their
names, are carried to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import bpe, decontaminate, pii, quality, simhash
from scholium.llm.common import new_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked by their kind; all documents stay."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Most stages have no form in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
