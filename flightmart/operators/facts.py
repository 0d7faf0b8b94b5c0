"""O01 sales fact and O02 dimension lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.sources.schemas import FLIGHT_COLUMNS
from flightmart.sources.tables import Tables

SALES_COLUMNS = ["ticket_id", "customer_email", "booking_agent_email", "p_date"] + FLIGHT_COLUMNS


def sales_fact(purchases: DataFrame, ticket: DataFrame, flight: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per purchase with its ticket's flight columns.

    purchases and ticket are both fact-sized, so they meet in a sort-merge
    join on ticket_id (hash-partitioned on the key, skew split by AQE).
    flight is a dimension: the planner broadcasts it when its measured size
    is under the broadcast threshold and sort-merges otherwise.  Operators
    filter this plan on p_date / airline / status, and Catalyst pushes those
    filters below the joins into the scans.  ``tasks``: the rows are left in so
    many tasks, dealt by ``hash(flight_num)``.
    """
    sold = purchases.join(ticket, "ticket_id")
    if tasks:
        sold, flight = sold.repartition(tasks, "flight_num"), flight.repartition(tasks, "flight_num")
    return sold.join(flight, "flight_num").select(*SALES_COLUMNS)


def sales_of(t: Tables) -> DataFrame:
    return sales_fact(t.purchases, t.ticket, t.flight)


def dim_lists(t: Tables) -> DataFrame:
    """The value lists the forms offer, as one tidy table.

    list_name is one of ``airline`` (all airline names), ``airport`` (all
    airport names), ``airplane`` (airplane ids per airline) and ``flight``
    (flight numbers per airline).
    """
    null = F.lit(None).cast("string")
    return (
        t.airline.select(F.lit("airline").alias("list_name"), F.col("name").alias("airline_name"),
                         F.col("name").alias("item"))
        .unionByName(t.airport.select(F.lit("airport").alias("list_name"), null.alias("airline_name"),
                                      F.col("name").alias("item")))
        .unionByName(t.airplane.select(F.lit("airplane").alias("list_name"), "airline_name",
                                       F.col("id").alias("item")))
        .unionByName(t.flight.select(F.lit("flight").alias("list_name"), "airline_name",
                                     F.col("flight_num").alias("item")))
    )
