"""Keyed tables in hash buckets, updated bucket by bucket.

A table lies below its path as ``versions/version=N/bucket=K``; a manifest
(a row for each bucket and version that holds rows of it) is committed last and
says which folders are the table.  An update reads the buckets of the keys that
change, found by partition pruning, and writes just these into a fresh version;
all others stay the files they were.  ``append`` leaves the files of these
buckets too and puts rows beside them.  Until the new manifest is committed
readers see the old table, and an update that was killed is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, holds long, version long"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; NULL keys have one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int, dict[int, tuple[int, ...]]]:
    """(last committed version, the versions that hold each bucket); one row for each of these is read.

    ``upto``: the table as it was at that version.
    """
    base = f"{path}/manifests"
    rows = spark.read.schema(MANIFEST).option("basePath", base).parquet(base)
    if upto is not None:
        rows = rows.filter(F.col("version") <= upto)
    last = rows.agg(F.max("version")).first()[0]
    holds: dict[int, tuple[int, ...]] = {}
    for r in rows.filter(F.col("version") == last).collect():
        holds[r["bucket"]] = (*holds.get(r["bucket"], ()), r["holds"])
    return last, holds


def _write_version(rows: DataFrame, path: str, version: int, gather: bool = True, mode: str = "overwrite") -> None:
    """Few files for each bucket, however many tasks made its rows; a large one is split by size.

    Not ``gather``: rows stay in their tasks, each of which writes a file for each bucket.
    """
    rows = rows.hint("rebalance", F.col("bucket")) if gather else rows
    rows.write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/versions/version={version}")


def _commit(spark: SparkSession, path: str, version: int, holds: dict[int, tuple[int, ...]]) -> None:
    rows = spark.createDataFrame(sorted((b, v) for b, versions in holds.items() for v in versions), "bucket int, holds long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/version={version}")


def write_parts(rows: DataFrame, path: str, gather: bool = True) -> None:
    """Store rows anew by their column ``bucket``, which may be any int (a month, say)."""
    _store(rows, path, None, gather=gather)


def write(table: DataFrame, path: str, key: str, buckets: int, version: int | None = None, gather: bool = True) -> None:
    """Store a table anew in so many buckets (as ``version``, else the next); a few hundred MB for each are a good size.

    ``gather``: shuffle the rows, so that each bucket has few files.
    """
    _store(table.withColumn("bucket", bucket_of(key, buckets)), path, range(buckets), version, gather)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(manifest(spark, path)[1])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _store(rows: DataFrame, path: str, buckets: range | None, version: int | None = None, gather: bool = True) -> None:
    spark = rows.sparkSession
    if version is None:
        version = manifest(spark, path)[0] + 1 if exists(spark, path) else 0
    _write_version(rows, path, version, gather)
    if buckets is None:
        base = f"{path}/versions"
        kept = spark.read.schema("version long, bucket int").option("basePath", base).parquet(base).filter(F.col("version") == version)
        buckets = [r["bucket"] for r in kept.select("bucket").distinct().collect()]  # one row for each
    _commit(spark, path, version, dict.fromkeys(buckets, (version,)))


def _scan(spark: SparkSession, path: str, schema: T.StructType, holds: dict[int, tuple[int, ...]]) -> DataFrame:
    by_version: dict[int, list[int]] = {}
    for bucket, versions in holds.items():
        for version in versions:
            by_version.setdefault(version, []).append(bucket)
    full = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
    base = f"{path}/versions"
    rows = spark.read.schema(full).option("basePath", base).parquet(base)
    held = reduce(lambda a, b: a | b, ((F.col("version") == v) & F.col("bucket").isin(ks) for v, ks in by_version.items()), F.lit(False))
    return rows.filter(held)


def read(spark: SparkSession, path: str, schema: T.StructType, only: Callable[[int], bool] | None = None, numbered: bool = False) -> DataFrame:
    """The table, or those of its buckets whose numbers ``only`` wants; ``numbered``: with the column ``bucket``."""
    holds = manifest(spark, path)[1]
    rows = _scan(spark, path, schema, {b: v for b, v in holds.items() if only is None or only(b)})
    return rows.select(*schema.fieldNames(), *["bucket"] * numbered)


def replace(spark: SparkSession, path: str, rows: DataFrame, buckets: set[int], version: int | None = None,
            gather: bool = True, more: Iterable[DataFrame] = ()) -> None:
    """Commit a version in which ``buckets`` hold ``rows`` (with their column ``bucket``) and all others what they held.

    ``more``: further rows of them, each written when the one before is; ``gather`` as in ``write``.
    """
    last, holds = manifest(spark, path, None if version is None else version - 1)
    version = last + 1 if version is None else version
    _write_version(rows, path, version, gather)
    for further in more:
        _write_version(further, path, version, gather, "append")
    _commit(spark, path, version, holds | dict.fromkeys(buckets, (version,)))


def append(spark: SparkSession, path: str, rows: DataFrame, buckets: set[int], version: int) -> None:
    """Commit a version in which ``buckets`` hold ``rows`` (with their column ``bucket``) besides what they held."""
    holds = manifest(spark, path, version - 1)[1]
    _write_version(rows, path, version)
    _commit(spark, path, version, holds | {b: (*holds[b], version) for b in buckets})


def read_for(spark: SparkSession, path: str, schema: T.StructType, key: str, keys: DataFrame, upto: int | None = None) -> tuple[DataFrame, set[int]]:
    """The buckets that can hold any of ``keys`` (column ``key``), and their numbers."""
    holds = manifest(spark, path, upto)[1]
    touched = {r["b"] for r in keys.select(bucket_of(key, len(holds)).alias("b")).distinct().collect()}  # one row for each bucket at most
    return _scan(spark, path, schema, {b: holds[b] for b in touched}).select(*schema.fieldNames()), touched


def update(spark: SparkSession, path: str, schema: T.StructType, key: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> set[int]:
    """Rewrite the buckets of ``keys`` with what ``change`` makes of their rows; returns their numbers.

    ``change`` gets all rows of those buckets and returns their new rows, of
    the same keys or of ``keys`` (inserts and deletes are changes too).
    """
    rows, touched = read_for(spark, path, schema, key, keys)
    if touched:
        buckets = len(manifest(spark, path)[1])
        replace(spark, path, change(rows).select(*schema.fieldNames()).withColumn("bucket", bucket_of(key, buckets)), touched)
    return touched
