"""The corpus pipeline: each stage calls one operator on all that the stage before kept.

Every stage but the last returns the columns of ``documents``.  Null, empty,
very long and repeated texts: as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightmart.llm import decontam, langid, neardup, packing, pii
from flightmart.llm.common import read_table, scratch
from flightmart.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; the model learns from the labelled rows among them."""
    return langid.accepted_rows(docs, langid.fit(docs, learn=F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more; the smallest doc_id stays.

    Of rows with that doc_id one stays; rows without words stay all, as they
    are linked with nothing.
    """
    return neardup.first_of_components(docs, k=5, numerator=80, denominator=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no ten-word window of a benchmark item (nor a whole shorter item)."""
    return decontam.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets, n_chars made to fit."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 ids; the pieces' ids are little-endian unsigned 32-bit."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: SQL cannot express language identification or the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
