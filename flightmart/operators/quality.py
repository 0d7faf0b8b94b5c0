"""O41 integrity audit: the declared keys and constraints, checked in bulk.

Spark does not enforce PK/FK/NOT NULL/varchar lengths, so this job reports
every violation as a row (rule, table_name, key, n):

* ``pk``       duplicate primary-key values (key = the value, n = copies)
* ``fk``       child values missing from the parent (table_name = child.column)
* ``not_null`` NULLs in NOT NULL columns (key NULL, n = rows)
* ``length``   values longer than the declared varchar length

Each check is an aggregation or an anti join; length checks read each table
once (the long values of all its string columns are unpivoted together).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightmart.sources.schemas import MAX_VARCHAR
from flightmart.sources.tables import Tables

# The declared primary keys, foreign keys and NOT NULL columns.
PRIMARY_KEYS = [
    ("airline", "name"),
    ("airline_staff", "username"),
    ("airplane", "id"),
    ("airport", "name"),
    ("flight", "flight_num"),
    ("ticket", "ticket_id"),
    ("customer", "email"),
    ("booking_agent", "email"),
]
FOREIGN_KEYS = [
    ("airline_staff", "airline_name", "airline", "name"),
    ("permission", "username", "airline_staff", "username"),
    ("airplane", "airline_name", "airline", "name"),
    ("flight", "airline_name", "airline", "name"),
    ("flight", "airplane_id", "airplane", "id"),
    ("flight", "depart_name", "airport", "name"),
    ("flight", "arrive_name", "airport", "name"),
    ("ticket", "flight_num", "flight", "flight_num"),
    ("booking_agent", "airline_name", "airline", "name"),
    ("purchases", "ticket_id", "ticket", "ticket_id"),
    ("purchases", "customer_email", "customer", "email"),
    ("purchases", "booking_agent_email", "booking_agent", "email"),
]
NOT_NULL = [("airline_staff", "username"), ("permission", "username")]

TABLE_NAMES = ["airline", "airline_staff", "permission", "airplane", "airport", "flight", "ticket",
               "customer", "booking_agent", "purchases"]


def _row(rule: str, table: str, key, n) -> list:
    return [F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
            (key.cast("string") if key is not None else F.lit(None).cast("string")).alias("key"),
            n.cast("bigint").alias("n")]


def pk_violations(t: Tables) -> list[DataFrame]:
    out = []
    for table, col in PRIMARY_KEYS:
        df = getattr(t, table)
        dup = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        out.append(dup.select(*_row("pk", table, F.col(col), F.col("_n"))))
    return out


def fk_violations(t: Tables) -> list[DataFrame]:
    out = []
    for child, col, parent, pcol in FOREIGN_KEYS:
        c = getattr(t, child).select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
        p = getattr(t, parent).select(F.col(pcol).alias("_v"))
        # Pre-aggregate the child values first: the anti join then moves one
        # row per distinct value, not one per fact row.
        counted = c.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
        missing = counted.join(p, "_v", "left_anti")
        out.append(missing.select(*_row("fk", f"{child}.{col}", F.col("_v"), F.col("_n"))))
    return out


def not_null_violations(t: Tables) -> list[DataFrame]:
    out = []
    for table, col in NOT_NULL:
        df = getattr(t, table)
        agg = df.agg(F.count(F.when(F.col(col).isNull(), 1)).alias("_n")).filter(F.col("_n") > 0)
        out.append(agg.select(*_row("not_null", f"{table}.{col}", None, F.col("_n"))))
    return out


def length_violations(t: Tables, max_len: int = MAX_VARCHAR) -> list[DataFrame]:
    out = []
    for table in TABLE_NAMES:
        df = getattr(t, table)
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not cols:
            continue
        too_long = reduce(lambda a, b: a | b, [F.length(c) > max_len for c in cols])
        pairs = df.filter(too_long).select(F.inline(F.array(*[
            F.struct(F.lit(f"{table}.{c}").alias("_col"), F.col(c).alias("_v")) for c in cols])))
        agg = (pairs.filter(F.length("_v") > max_len).groupBy("_col", "_v")
               .agg(F.count(F.lit(1)).alias("_n")))
        out.append(agg.select(F.lit("length").alias("rule"), F.col("_col").alias("table_name"),
                              F.col("_v").alias("key"), F.col("_n").cast("bigint").alias("n")))
    return out


def integrity_audit(t: Tables) -> DataFrame:
    parts = pk_violations(t) + fk_violations(t) + not_null_violations(t) + length_violations(t)
    return reduce(DataFrame.unionByName, parts)
