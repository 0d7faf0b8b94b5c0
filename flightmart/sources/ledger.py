"""Batches of appended rows that readers see whole or not at all.

Plain Parquet has no transaction over several tables.  A job stages a batch's
rows in folders of their own (``loads/<table>/batch_id=N``, overwritten if the
batch is run again) and writes its commit row last; readers take the rows of
committed batches only.  A job that is killed between any two writes leaves
nothing that is read, and running it again decides against the same tables and
gives the same rows.  A commit row is one file, which appears by one rename.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# last_id: the largest ticket id after the batch, of booking batches
COMMIT = "job string, tables array<string>, outcomes string, last_id string, batch_id long"


def committed(spark: SparkSession, root: str) -> dict[int, Row]:
    """Commit rows by batch, one for each batch; none if nothing has been committed."""
    path = f"{root}/commits"
    try:
        rows = spark.read.schema(COMMIT).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["batch_id"]: r for r in rows.collect()}


def number(done: dict[int, Row], batch_id: int | None) -> int:
    """The batch to run: ``batch_id``, or the one after the last committed."""
    following = max(done, default=-1) + 1
    if batch_id is None:
        return following
    if batch_id not in done and batch_id < following:
        raise ValueError(f"batch {batch_id} is before the last one, {following - 1}, and was not committed")
    return batch_id


def stage(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/loads/{table}/batch_id={batch_id}")


def commit(spark: SparkSession, root: str, batch_id: int, job: str, tables: Sequence[str], outcomes: str = "", last_id: str | None = None) -> None:
    row = spark.createDataFrame([(job, list(tables), outcomes, last_id)], COMMIT.rsplit(",", 1)[0])
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch_id={batch_id}")


def rows_of(spark: SparkSession, root: str, table: str, schema: T.StructType, done: dict[int, Row], after: int = -1) -> DataFrame | None:
    """The rows that committed batches (after ``after``) add to a table; None if there are none."""
    batches = [n for n, r in done.items() if table in r["tables"] and n > after]
    if not batches:
        return None
    path = f"{root}/loads/{table}"
    with_batch = T.StructType(list(schema.fields) + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).option("basePath", path).parquet(path).filter(F.col("batch_id").isin(batches)).select(*schema.fieldNames())


def mark_snapshot(spark: SparkSession, path: str, upto: int) -> None:
    """Note the last batch that a table snapshot at ``path`` holds; written before the snapshot."""
    spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{path}.upto")


def snapshot_holds(spark: SparkSession, path: str, done: dict[int, Row]) -> int:
    """The last batch that a snapshot holds; all, if it does not say."""
    try:
        return spark.read.schema("upto long").parquet(f"{path}.upto").first()["upto"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return max(done, default=-1)
