"""Cumulative sales by key and day: any date window is a difference of two rows.

For a key (airline, agent or customer) the index holds, for each day with
sales, tickets and money from the first sale up to that day.  Each month of a
key begins with an opening row, the sums before it, so a date is looked up in
its month's folder alone; a window reads two folders, however long it is and
however many purchases lie in it (O13-O15, O21, O22, O25, O26).

Sales are joined and summed by day once, and written; all else reads these rows.
A hot airline has one of them for each day, which are summed up in one pass; the
opening rows of the months after a day are written out from that day's sums.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightmart.functions.dates import as_date

MEASURES = ("tickets", "revenue_direct", "revenue_agent")
_MONEY = T.DecimalType(28, 2)
AGENT = "booking_agent_email"


def daily_sales(sales: DataFrame, key: str) -> DataFrame:
    """One row for each key and day, summed before the shuffle; sales without a key (no agent) are left out."""
    direct = F.col(AGENT).isNull()
    return (sales.filter(F.col(key).isNotNull() & F.col("p_date").isNotNull()).select(F.col(key).alias("key"), "p_date", AGENT, "price")
            .groupBy("key", "p_date").agg(
                F.count(F.lit(1)).alias("tickets"),
                F.coalesce(F.sum(F.when(direct, F.col("price"))), F.lit(0)).cast(_MONEY).alias("revenue_direct"),
                F.coalesce(F.sum(F.when(~direct, F.col("price"))), F.lit(0)).cast(_MONEY).alias("revenue_agent")))


def cumulative(daily: DataFrame, last_month: Column) -> DataFrame:
    """(key, p_month, p_date, measures up to and with p_date); an opening row has p_date NULL.

    Opening rows are there for every month from a key's first one to the one
    after ``last_month``, so that also a month without sales can be looked up.
    """
    ordered = Window.partitionBy("key").orderBy("p_date")  # a row for each day
    so_far = daily.select(
        "key", "p_date", F.lag("p_date").over(ordered).isNull().alias("_first"),
        F.trunc("p_date", "MM").alias("_month"), F.trunc(F.lead("p_date").over(ordered), "MM").alias("_next"),
        *[F.sum(m).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias(m) for m in MEASURES])

    def row(month: Column, day: Column, measures: Sequence[Column]) -> Column:
        types = ("long", _MONEY, _MONEY)
        return F.struct(month.alias("p_month"), day.alias("p_date"), *[v.cast(t).alias(m) for v, m, t in zip(measures, MEASURES, types, strict=True)])

    none, sums = F.lit(None).cast("date"), [F.col(m) for m in MEASURES]
    own = row(F.col("_month"), F.col("p_date"), sums)
    until = F.coalesce("_next", F.add_months(last_month, 1))  # months up to the key's next sale open with these sums
    later = F.transform(F.sequence(F.add_months("_month", 1), until, F.expr("INTERVAL 1 MONTH")), lambda m: row(m, none, sums))
    rows = F.concat(F.when(F.col("_first"), F.array(row(F.col("_month"), none, [F.lit(0)] * 3), own)).otherwise(F.array(own)),
                    F.when(until > F.col("_month"), later).otherwise(F.array().cast(T.ArrayType(so_far.select(own.alias("r")).schema["r"].dataType))))
    return so_far.select("key", F.inline(rows)).select("key", "p_month", "p_date", *MEASURES)


def write_day_index(sales: DataFrame, key: str, path: str) -> None:
    """Build the index of ``key`` anew, stored by month, and note its last month."""
    spark = sales.sparkSession
    daily = daily_sales(sales, key)
    daily.write.mode("overwrite").parquet(f"{path}.daily")
    daily = spark.read.schema(daily.schema).parquet(f"{path}.daily")
    last = daily.agg(F.max(F.trunc("p_date", "MM")).alias("last_month"))
    last.write.mode("overwrite").parquet(f"{path}.last_month")
    last = spark.read.schema("last_month date").parquet(f"{path}.last_month").first()["last_month"]
    index = cumulative(daily, F.lit(last).cast("date"))
    index.hint("rebalance", F.col("p_month")).write.mode("overwrite").partitionBy("p_month").parquet(path)


def read_day_index(spark: SparkSession, path: str) -> DataFrame:
    money = [T.StructField(m, _MONEY) for m in MEASURES[1:]]
    return spark.read.schema(T.StructType([T.StructField("key", T.StringType()), T.StructField("p_date", T.DateType()), T.StructField("tickets", T.LongType()),
                                           *money, T.StructField("p_month", T.DateType())])).parquet(path)


def windows(spark: SparkSession, path: str, spans: Sequence[tuple[dt.date | str, dt.date | str]]) -> DataFrame:
    """(key, window_start, window_end, measures) of each key for all spans (inclusive dates) at once.

    Only the months that hold a span's end, or the day before its start, are
    read.  Keys without sales in a span have zeros; a key that is in none of
    the months read (its first sale is later) has no row.
    """
    spans = [(as_date(a), as_date(b)) for a, b in spans]
    last = spark.read.schema("last_month date").parquet(f"{path}.last_month").first()["last_month"] or dt.date(1, 1, 1)
    end = (last + dt.timedelta(days=40)).replace(day=1)  # nothing is sold from here on

    def looked_up(day: dt.date) -> dt.date:
        return min(day, end)

    points = sorted({looked_up(p) for a, b in spans for p in (a - dt.timedelta(days=1), b)})
    months = sorted({p.replace(day=1) for p in points})

    def at(p: dt.date, m: str):
        """The measure up to and with day p: the last row of p's month that is not later."""
        known = (F.col("p_month") == F.lit(p.replace(day=1))) & F.coalesce(F.col("p_date") <= F.lit(p), F.lit(True))
        return F.coalesce(F.max_by(F.when(known, F.col(m)), F.when(known, F.coalesce("p_date", F.date_sub("p_month", 1)))), F.lit(0))

    index = read_day_index(spark, path).filter(F.col("p_month").isin(months))
    sums = index.groupBy("key").agg(*[at(p, m).alias(f"{m}_{i}") for i, p in enumerate(points) for m in MEASURES])
    place = {p: i for i, p in enumerate(points)}
    rows = [F.struct(F.lit(a).alias("window_start"), F.lit(b).alias("window_end"),
                     *[(F.col(f"{m}_{place[looked_up(b)]}") - F.col(f"{m}_{place[looked_up(a - dt.timedelta(days=1))]}")).cast("long" if m == "tickets" else "decimal(18,2)").alias(m) for m in MEASURES])
            for a, b in spans]
    return sums.select("key", F.inline(F.array(*rows)))
