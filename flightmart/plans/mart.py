"""Physical layout for scale: the sales fact materialised once, by month.

Every report joins purchases, ticket and flight.  At 100 TB that join (two
fact-sized sides, a sort-merge on ticket_id) should run once per load, not
once per report.  ``write_sales_mart`` stores the joined fact partitioned by
purchase month; ``read_sales_mart`` scans it with the schema given and adds a
month predicate derived from the date window, so a 30-day report reads two
month folders instead of the whole history.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightmart.functions.dates import as_date, days_before, month_start
from flightmart.operators.facts import SALES_COLUMNS, sales_fact
from flightmart.sources import bucketed
from flightmart.sources.schemas import FLIGHT, PURCHASES

def _sales_schema() -> T.StructType:
    by_name = {f.name: f for f in list(PURCHASES.fields) + list(FLIGHT.fields)}
    fields = [by_name[c] for c in SALES_COLUMNS]
    return T.StructType(fields + [T.StructField("p_month", T.DateType())])


def write_sales_mart(purchases: DataFrame, ticket: DataFrame, flight: DataFrame, path: str,
                     files_per_month: int | None = None) -> None:
    """Materialise the sales fact, partitioned by purchase month.

    Rows are clustered by month before the write so each task writes few
    files.  By default Spark rebalances: small months share a task and a busy
    month is split by size.  ``files_per_month`` spreads each month over that
    many files (by a hash of ticket_id) instead.
    """
    sales = sales_fact(purchases, ticket, flight).withColumn("p_month", F.trunc("p_date", "MM"))
    if files_per_month:
        sales = sales.repartition("p_month", (F.xxhash64("ticket_id") % files_per_month))
    else:
        sales = sales.hint("rebalance", F.col("p_month"))
    sales.write.mode("overwrite").partitionBy("p_month").parquet(path)


def read_sales_mart(spark: SparkSession, path: str, start: dt.date | None = None,
                    end: dt.date | None = None) -> DataFrame:
    """Scan the mart; with a date range the month partitions outside it are pruned."""
    df = spark.read.schema(_sales_schema()).parquet(path)
    if start is not None:
        df = df.filter(F.col("p_month") >= F.lit(month_start(as_date(start))))
    if end is not None:
        df = df.filter(F.col("p_month") <= F.lit(month_start(as_date(end))))
    return df.select(*SALES_COLUMNS)


def read_sales_window(spark: SparkSession, path: str, as_of: dt.date, days: int) -> DataFrame:
    """The mart restricted to the months a ``days``-day window ending at as_of can touch."""
    return read_sales_mart(spark, path, days_before(as_of, days), as_of)


# ---------------------------------------------------------------- the mart kept up to date
# Months are the buckets of a versioned table (``sources.bucketed``): a batch
# rewrites the months it touches, the others stay the files they were.  With more
# than ``FLIGHTS`` flights each month is cut into parts by flight, so that sales
# are moved to their flights once, when the mart is started: they are written
# from there, and a batch brings the changed flights of one part after the other
# to the files of that part.  The bucket's number holds the month, the part and
# the number of parts; with one part it is the month.

FLIGHTS = 250_000  # of a part, about; a batch broadcasts those of them that changed
ROWS = 1_000_000  # of a task that writes a file for each month
_MONTHS = 1 << 18


def _month_number(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def _sales_only() -> T.StructType:
    return T.StructType(_sales_schema().fields[:-1])


def _part(parts: int) -> Column:
    """The part of a flight.  Tasks dealt by flight_num hold one part each if ``parts`` divides their number."""
    return F.pmod(F.hash("flight_num"), F.lit(parts))


def _by_month(sales: DataFrame, parts: int) -> DataFrame:
    month = F.coalesce(_month_number(F.col("p_date")), F.lit(-1))
    return sales.select(*SALES_COLUMNS).withColumn("bucket", ((F.lit(parts - 1) + _part(parts)) * _MONTHS + month).cast("int"))


def _bucket(month: int, part: int, parts: int) -> int:
    return (parts - 1 + part) * _MONTHS + month


def _month_and_parts(bucket: int) -> tuple[int, int]:
    """The month (-1: none) and the number of parts, a power of two, that a bucket's number holds."""
    place = (bucket + 1) // _MONTHS
    return bucket - place * _MONTHS, 1 << ((place + 1).bit_length() - 1)


def start_mart(purchases: DataFrame, ticket: DataFrame, flight: DataFrame, path: str) -> None:
    """Materialise the sales fact once, by month of purchase; ``update_mart`` keeps it up to date."""
    flights, parts = flight.count(), 1
    while parts * FLIGHTS < flights and parts < 4096:
        parts *= 2
    tasks = None
    if parts > 1:
        # not fewer than Spark joins with by itself: it would deal the rows to that many instead
        tasks = parts * math.ceil(max(ticket.count() / ROWS, int(ticket.sparkSession.conf.get("spark.sql.shuffle.partitions"))) / parts)
    sales = _by_month(sales_fact(purchases, ticket, flight, tasks), parts)
    bucketed.write_parts(sales if parts == 1 else _sorted(sales), path, parts == 1)


def _sorted(rows: DataFrame) -> DataFrame:
    """Files are written by bucket in any case; flights in order make them smaller."""
    return rows.sortWithinPartitions("bucket", "depart_time", "flight_num")


def read_mart(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The mart; with bounds only the months that can hold such dates are read."""
    lo = start.year * 12 + start.month - 1 if start else None
    hi = end.year * 12 + end.month - 1 if end else None

    def wanted(bucket: int) -> bool:
        month, _ = _month_and_parts(bucket)
        return (lo is None or month >= lo) and (hi is None or month <= hi)

    return bucketed.read(spark, path, _sales_only(), wanted)


def _stored(rows: DataFrame, parts: int, path: str) -> DataFrame:
    """Rows with flight_num and their ``part``, written once so that each part is read alone."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])
    rows.withColumn("part", _part(parts)).hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def update_mart(spark: SparkSession, path: str, new_purchases: DataFrame, new_tickets: DataFrame, flight: DataFrame, changed: DataFrame) -> set[int]:
    """Bring the mart up to date after a batch; returns the numbers of the months that were rewritten.

    ``new_purchases`` and ``new_tickets`` are the rows that the batch added,
    ``flight`` the table after it, ``changed`` the flight_num of flights whose
    row it changed or added.  The delta of the three-way join has two parts: new
    purchases with the flights as they are now, and sold tickets of changed
    flights, whose old rows leave and whose new rows enter.  Purchases and
    tickets of earlier batches are not joined again.
    """
    now = flight.join(changed.select("flight_num").distinct(), "flight_num", "left_semi")
    parts = max((_month_and_parts(b)[1] for b in bucketed.manifest(spark, path)[1]), default=1)
    sizes = {}
    if parts > 1:
        now = _stored(now, parts, f"{path}/changed")
        sizes = {r["part"]: r["n"] for r in now.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each part

    def of_part(rows: DataFrame, part: int, *columns: Column | str) -> tuple[DataFrame, DataFrame]:
        """The held rows of a part, and columns of its changed flights: few enough for a broadcast unless the part has outgrown that."""
        if parts == 1:
            return rows, now.select(*columns)
        rows, fresh = rows.filter(F.floor((F.col("bucket") + 1) / _MONTHS) == parts - 1 + part), now.filter(F.col("part") == part).select(*columns)
        return rows, F.broadcast(fresh) if sizes.get(part, 0) <= 2 * FLIGHTS else fresh

    def months(days: DataFrame) -> set[int]:
        month = F.coalesce(_month_number(F.col("p_date")), F.lit(-1)).alias("month")
        return {r["month"] for r in days.select(month).distinct().collect()}  # one row for each month

    touched, old = months(new_purchases), bucketed.read(spark, path, _sales_only(), None, True)
    for part in range(parts) if parts == 1 else sizes:
        rows, fresh = of_part(old, part, "flight_num")
        touched |= months(rows.join(fresh, "flight_num", "left_semi"))
    if not touched:
        return touched
    held = bucketed.read(spark, path, _sales_only(), lambda b: _month_and_parts(b)[0] in touched, True)
    new = _by_month(sales_fact(new_purchases, new_tickets, flight), parts)
    its_own = [c for c in SALES_COLUMNS if c in flight.columns]

    def renewed(part: int) -> DataFrame:
        """Each held row meets the flights as they are now once; it keeps its own columns where its flight did not change."""
        rows, fresh = of_part(held, part, F.col("flight_num").alias("_num"), F.struct(*its_own).alias("_now"))
        changes = F.col("_num").isNotNull()
        rows = rows.join(fresh, F.col("flight_num") == F.col("_num"), "left").select(
            *[F.when(changes, F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) if c in its_own else F.col(c) for c in SALES_COLUMNS], "bucket")
        return rows if parts == 1 else _sorted(rows)

    # rows of several parts stay in the tasks that read them: those of the table are gathered already
    first = renewed(0).unionByName(new if parts == 1 else new.hint("rebalance", F.col("bucket")))
    bucketed.replace(spark, path, first, {_bucket(m, p, parts) for m in touched for p in range(parts)}, None, parts == 1, map(renewed, range(1, parts)))
    return touched
