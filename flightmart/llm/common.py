"""Helpers that the operators share: the cluster's shared folder, written intermediate tables, ASCII lower case."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightmart.session import ensure_checkpoint_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; ``lower`` does just that where every character is ASCII, and is far cheaper than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def python_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, under these names and types, whatever else the table holds; null text is empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def row_keys(text: Column, doc_id: Column) -> dict[str, Column]:
    """(k1, k2): never null, equal for rows of equal doc_id and text, and (but for a 64-bit hash) only for those."""
    doc_id = doc_id.cast("long")
    return {"k1": F.coalesce(doc_id, F.lit(0)), "k2": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), doc_id.isNull())}


def keyed(df: DataFrame) -> DataFrame:
    """``text_of`` with the row keys."""
    return text_of(df).withColumns(row_keys(F.col("text"), F.col("doc_id")))


def packed(df: DataFrame) -> DataFrame:
    """(row, k1, k2): all columns in one struct, so that no name clashes with an operator's own; ``select("row.*")`` unpacks."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).withColumns(row_keys(F.col("row.text"), F.col("row.doc_id")))
