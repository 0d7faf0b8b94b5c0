"""The ten tables as one bundle, plus Parquet readers and writers.

P01 (scan) reads with the declared schema, never inferring it.  P03/P04 (keyed update / delete) are expressed as new
snapshots: the batch operators return the full new table and
``write_snapshot`` writes it to a fresh folder, since plain Parquet has no
MERGE.  P02 (append sink) is ``ledger``: a job's rows, over all tables, are
committed whole.  Layouts for scale: purchases stored by month (``write_tables``,
pruned by ``read_tables(purchase_window=...)``) and purchases / ticket
bucketed on ticket_id (``write_bucketed_facts``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightmart.sources import ledger, schemas


@dataclass(frozen=True)
class Tables:
    airline: DataFrame
    airport: DataFrame
    airplane: DataFrame
    flight: DataFrame
    ticket: DataFrame
    purchases: DataFrame
    customer: DataFrame
    booking_agent: DataFrame
    airline_staff: DataFrame
    permission: DataFrame

    def replace(self, **changes: DataFrame) -> "Tables":
        current = {f.name: getattr(self, f.name) for f in fields(self)}
        current.update(changes)
        return Tables(**current)


def with_batch_id(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("batch_id", T.LongType())])


def batch_rows(spark: SparkSession, path: str, schema: T.StructType, batches: list[int]) -> DataFrame:
    """Rows below ``path/batch_id=N`` of the given batches; only their folders are listed and read."""
    rows = spark.read.schema(with_batch_id(schema)).option("basePath", path).parquet(path)
    return rows.filter(F.col("batch_id").isin(batches)).drop("batch_id")


def read_tables(spark: SparkSession, root: str,
                purchase_window: tuple[dt.date, dt.date] | None = None,
                bookings: str | None = None, before_batch: int | None = None,
                snapshots: dict[str, str] | None = None) -> Tables:
    """Scan ``root/<table>`` Parquet folders with the fixed schemas.

    Tables also hold the rows of committed load batches (``ledger``).  With
    ``bookings`` (the history folder of the booking jobs) ticket and purchases
    also hold what the committed batches of those jobs sold.  ``snapshots``
    names, per table, the folder of a newer snapshot to read in place of
    ``root/<table>``; of the load batches it adds those that came after it.

    purchases is stored partitioned by purchase month (``write_tables``);
    with ``purchase_window=(start, end)`` only the month folders that can
    hold those dates are listed and read (partition pruning), for jobs
    whose reports all fall inside one date window.
    """
    frames = {}
    done = ledger.committed(spark, root)
    booked = [n for n in ledger.committed(spark, bookings) if before_batch is None or n < before_batch] if bookings else []
    for name, schema in schemas.SCHEMAS.items():
        path = (snapshots or {}).get(name, f"{root}/{name}")
        if name == "purchases":
            # a new StructType: StructType.add would change the shared schema in place
            with_month = T.StructType(list(schemas.PURCHASES.fields) + [T.StructField("p_month", T.DateType())])
            df = spark.read.schema(with_month).parquet(path)
            if purchase_window is not None:
                start, end = purchase_window
                df = df.filter(F.col("p_month").between(F.lit(start.replace(day=1)), F.lit(end.replace(day=1))))
        else:
            df = spark.read.schema(schema).parquet(path)
        # the declared columns only, so every table has its fixed schema
        frames[name] = df.select(*schema.fieldNames())
        after = ledger.snapshot_holds(spark, path, done) if name in (snapshots or {}) and done else -1
        more = ledger.rows_of(spark, root, name, schema, done, after)
        if more is not None:
            frames[name] = frames[name].unionByName(more)
        if booked and name in ("ticket", "purchases"):
            frames[name] = frames[name].unionByName(batch_rows(spark, f"{bookings}/{name}", schema, booked))
    if bookings and purchase_window is not None:
        start, end = purchase_window
        frames["purchases"] = frames["purchases"].filter(F.col("p_date").between(F.lit(start.replace(day=1)), F.last_day(F.lit(end))))
    return Tables(**frames)


def write_tables(tables: Tables, root: str, mode: str = "overwrite") -> None:
    for f in fields(tables):
        df = getattr(tables, f.name)
        writer = df.write.mode(mode)
        if f.name == "purchases":
            # stored by purchase month, so date windows prune folders
            writer = df.withColumn("p_month", F.trunc("p_date", "MM")).write.mode(mode).partitionBy("p_month")
        writer.parquet(f"{root}/{f.name}")


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write the new state of a table to a fresh folder.

    The new state is derived from the old folder, so it must not overwrite
    it in place; callers point readers at the new folder afterwards.
    """
    df.write.mode("errorifexists").parquet(path)


def write_bucketed_facts(tables: Tables, root: str, buckets: int, prefix: str = "flightmart") -> None:
    """Store purchases and ticket bucketed (and sorted) on ticket_id.

    Both sides of the fact join then share the same hash layout, so the
    purchases-ticket sort-merge join runs without a shuffle on either side.
    Bucketing is table metadata, so the tables are registered in the
    session catalog (data under ``root``); across sessions a persistent
    catalog keeps the bucket spec.  ``buckets`` should give files of a few
    hundred MB at the target scale.
    """
    for name in ("purchases", "ticket"):
        (getattr(tables, name).write.bucketBy(buckets, "ticket_id").sortBy("ticket_id")
         .mode("overwrite").option("path", f"{root}/{name}_bucketed").saveAsTable(f"{prefix}_{name}"))


def read_bucketed_facts(spark: SparkSession, tables: Tables, prefix: str = "flightmart") -> Tables:
    """``tables`` with purchases and ticket replaced by the bucketed catalog tables."""
    return tables.replace(
        purchases=spark.table(f"{prefix}_purchases").select(*schemas.PURCHASES.fieldNames()),
        ticket=spark.table(f"{prefix}_ticket").select(*schemas.TICKET.fieldNames()))
