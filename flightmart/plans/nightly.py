"""Nightly report job: every page's report, for all keys, written once.

The reference renders each report per request for one user.  Here one job
computes them for every customer, agent and airline and writes one Parquet
folder per report under ``out``; a front end then reads the rows of one key.
The sales fact is materialised once as the month-partitioned mart, and each
report reads only the months its window can touch.  The staff page shares
one pre-aggregate (``dashboard``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from flightmart.operators import agent as ag
from flightmart.operators import airline as al
from flightmart.operators import booking as bk
from flightmart.operators import customer as cu
from flightmart.operators import quality as qa
from flightmart.operators import search as se
from flightmart.plans import dashboard, mart
from flightmart.sources.tables import read_bucketed_facts, read_tables


def _write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def run_reports(spark: SparkSession, root: str, out: str, as_of: dt.date,
                bucketed_prefix: str | None = None, bookings: str | None = None,
                snapshots: dict[str, str] | None = None) -> list[str]:
    """Write all reports for ``as_of``; returns the report names written.

    ``bookings`` (the history of the booking jobs) and ``snapshots`` (tables
    after status, permission and agent changes) are read as ``read_tables``
    reads them, so the reports see what the batch jobs sold and changed.

    With ``bucketed_prefix`` (and no ``bookings``, which those tables do not hold) purchases and ticket come from the bucketed
    catalog tables (``tables.write_bucketed_facts``), so building the mart
    joins them without a shuffle.
    """
    t = read_tables(spark, root, bookings=bookings, snapshots=snapshots)
    if bucketed_prefix is not None:
        t = read_bucketed_facts(spark, t, bucketed_prefix)
    mart_path = f"{out}/_sales_mart"
    mart.write_sales_mart(t.purchases, t.ticket, t.flight, mart_path)
    year = mart.read_sales_window(spark, mart_path, as_of, 365)
    half = mart.read_sales_window(spark, mart_path, as_of, 183)
    month = mart.read_sales_window(spark, mart_path, as_of, 31)
    everything = mart.read_sales_mart(spark, mart_path)

    reports: dict[str, tuple[DataFrame, str | None]] = {
        "public_upcoming_flights": (se.public_upcoming_flights(t.flight), None),
        "airline_flights_next_30_days": (al.airline_flights_next_30_days(t.flight, as_of), "airline_name"),
        "customer_upcoming_flights": (cu.customer_upcoming_flights(everything), None),
        "customer_year_spend": (cu.customer_year_spend(year, t.customer, as_of), None),
        "customer_monthly_spend_6m": (cu.customer_monthly_spend_6m(half, t.customer, as_of), None),
        "agent_upcoming_flights": (ag.agent_upcoming_flights(everything), None),
        "upcoming_passengers": (ag.upcoming_passengers(everything), None),
        "agent_commission": (ag.agent_commission(month, t.booking_agent, as_of), None),
        "agent_top_customers_by_tickets": (ag.agent_top_customers_by_tickets(half, as_of), None),
        "agent_top_customers_by_spend": (ag.agent_top_customers_by_spend(year, as_of), None),
        "top_destinations": (al.top_destinations(t.flight, t.airport, as_of), None),
        "airline_monthly_tickets_12m": (al.airline_monthly_tickets_12m(year, t.airline, as_of), "airline_name"),
        "top_destinations_by_airline": (al.top_destinations(t.flight, t.airport, as_of, per_airline=True), None),
        "customer_purchase_history": (al.customer_purchase_history(everything), None),
        "flight_passenger_list": (al.flight_passenger_list(everything), None),
        "staff_permissions": (al.staff_permissions(t.airline_staff, t.permission), None),
        "seat_availability": (bk.seat_availability(t.flight, t.airplane, t.ticket), None),
        "duplicate_bookings": (bk.duplicate_bookings(t.purchases, t.ticket), None),
        "integrity_audit": (qa.integrity_audit(t), None),
    }
    staff = dashboard.staff_dashboard(year, t.airline, as_of)
    try:
        for name, df in staff.items():
            if name != "cube":
                reports[name] = (df, None)
        for name, (df, part) in reports.items():
            _write(df, f"{out}/{name}", part)
    finally:
        staff["cube"].unpersist()
    return sorted(reports)
