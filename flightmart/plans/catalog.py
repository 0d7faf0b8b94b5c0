"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

Each query derives the airline tables from the test Parquet in ``sf_dir``
(lazily) and runs one operator over all keys with ``as_of = 2001-07-01``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightmart.functions.dates import month_key, month_label
from flightmart.operators import agent as ag
from flightmart.operators import airline as al
from flightmart.operators import booking as bk
from flightmart.operators import customer as cu
from flightmart.operators import maintain as mt
from flightmart.operators import quality as qa
from flightmart.operators import saved_search as ss
from flightmart.operators import search as se
from flightmart.operators import facts
from flightmart.plans import audit, day_index, jobs, mart
from flightmart.session import ensure_checkpoint_dir
from flightmart.sources import bucketed, fixtures, schemas

AS_OF = fixtures.AS_OF

Query = Callable[[SparkSession, str], DataFrame]


# The derived tables (lazy plans, analysed once) per session and folder, as a
# job would load its tables once and run many reports on them.
_LOADED: dict[tuple[int, str], tuple[SparkSession, object, DataFrame]] = {}


def _loaded(spark: SparkSession, sf_dir: str):
    key = (id(spark), sf_dir)
    hit = _LOADED.get(key)
    if hit is None or hit[0] is not spark:
        t = fixtures.load(spark, sf_dir)
        hit = (spark, t, facts.sales_of(t))
        _LOADED[key] = hit
    return hit


def _t(spark: SparkSession, sf_dir: str):
    return _loaded(spark, sf_dir)[1]


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[2]


QUERIES: dict[str, Query] = {
    "sales_fact": lambda s, d: _sales(s, d),
    "dim_lists": lambda s, d: facts.dim_lists(_t(s, d)),
    "airline_revenue_split": lambda s, d: al.airline_revenue_split(_sales(s, d), AS_OF),
    "airline_revenue_share": lambda s, d: al.airline_revenue_share(_sales(s, d), AS_OF),
    "airline_ticket_counts": lambda s, d: al.airline_ticket_counts(_sales(s, d), _t(s, d).airline, AS_OF),
    "airline_top_agents_by_tickets": lambda s, d: al.airline_top_agents_by_tickets(_sales(s, d), AS_OF),
    "airline_top_agents_by_sales": lambda s, d: al.airline_top_agents_by_sales(_sales(s, d), AS_OF),
    "airline_top_customers": lambda s, d: al.airline_top_customers(_sales(s, d), AS_OF),
    "top_destinations": lambda s, d: al.top_destinations(_t(s, d).flight, _t(s, d).airport, AS_OF),
    "airline_monthly_tickets_12m": lambda s, d: al.airline_monthly_tickets_12m(_sales(s, d), _t(s, d).airline, AS_OF),
    # with the chart's month key and label
    "airline_monthly_chart": lambda s, d: QUERIES["airline_monthly_tickets_12m"](s, d).select(
        "airline_name", "month_start", month_key("month_start").alias("month_key"), month_label("month_start").alias("month_label"), "tickets"),
    "airline_monthly_tickets_range": lambda s, d: al.airline_monthly_tickets_range(
        _sales(s, d), _t(s, d).airline, dt.date(1999, 11, 15), dt.date(2001, 2, 10), AS_OF),
    "customer_purchase_history": lambda s, d: al.customer_purchase_history(_sales(s, d)),
    "flight_passenger_list": lambda s, d: al.flight_passenger_list(_sales(s, d)),
    "staff_permissions": lambda s, d: al.staff_permissions(_t(s, d).airline_staff, _t(s, d).permission),
    "airline_flights_next_30_days": lambda s, d: al.airline_flights_next_30_days(_t(s, d).flight, AS_OF),
    "public_upcoming_flights": lambda s, d: se.public_upcoming_flights(_t(s, d).flight),
    "flight_search": lambda s, d: se.flight_search(
        _t(s, d).flight, _t(s, d).airport, {"departure_city": "ASIA", "arrival_city": "EUROPE"}),
    "flight_search_by_day": lambda s, d: se.flight_search(
        _t(s, d).flight, _t(s, d).airport, {"departure_date": "2000-11-29"}),
    "searches_matched": lambda s, d: ss.searches_matched(fixtures.saved_searches(s, d), _t(s, d).flight, _t(s, d).airport),
    "searches_matched_by_bounds": lambda s, d: ss.searches_matched(
        fixtures.bounded_searches(s, d), _t(s, d).flight, _t(s, d).airport, "bound"),
    "customer_searches_matched": lambda s, d: ss.customer_searches_matched(
        fixtures.bounded_searches(s, d), _sales(s, d), _t(s, d).airport),
    "customer_upcoming_flights": lambda s, d: cu.customer_upcoming_flights(_sales(s, d)),
    "customer_upcoming_search": lambda s, d: cu.customer_upcoming_search(
        _sales(s, d), _t(s, d).airport, {"departure_date": "2001-08-01", "arrival_city": "AMERICA"}),
    "customer_year_spend": lambda s, d: cu.customer_year_spend(_sales(s, d), _t(s, d).customer, AS_OF),
    "customer_monthly_spend_6m": lambda s, d: cu.customer_monthly_spend_6m(_sales(s, d), _t(s, d).customer, AS_OF),
    "customer_monthly_spend_range": lambda s, d: cu.customer_monthly_spend_range(
        _sales(s, d), _t(s, d).customer, dt.date(2000, 10, 15), dt.date(2001, 3, 31), AS_OF),
    "agent_upcoming_bookings": lambda s, d: ag.agent_upcoming_bookings(_sales(s, d)),
    "agent_upcoming_search": lambda s, d: ag.agent_upcoming_search(
        _sales(s, d), _t(s, d).airport, {"departure_airport": "NATION_2", "arrival_date": "2002-06-30"}),
    "agent_commission": lambda s, d: ag.agent_commission(_sales(s, d), _t(s, d).booking_agent, AS_OF),
    "agent_commission_range": lambda s, d: ag.agent_commission_range(
        _sales(s, d), _t(s, d).booking_agent, AS_OF, "2001-01-01", "2001-03-31"),
    "agent_top_customers_by_tickets": lambda s, d: ag.agent_top_customers_by_tickets(_sales(s, d), AS_OF),
    "agent_top_customers_by_spend": lambda s, d: ag.agent_top_customers_by_spend(_sales(s, d), AS_OF),
    "airline_flight_search": lambda s, d: al.airline_flight_search(
        _t(s, d).flight, _t(s, d).airport,
        {"departure_date": "2000-01-01", "arrival_date": "2000-12-31", "departure_city": "ASIA"}),
    "seat_availability": lambda s, d: bk.seat_availability(_t(s, d).flight, _t(s, d).airplane, _t(s, d).ticket),
    "duplicate_bookings": lambda s, d: bk.duplicate_bookings(_t(s, d).purchases, _t(s, d).ticket),
    "book_tickets_direct": lambda s, d: _book_direct(s, d),
    "book_tickets_agent": lambda s, d: _book_agent(s, d),
    "assign_ticket_ids": lambda s, d: _ticket_ids(s, d),
    "load_new_flights": lambda s, d: mt.load_new_flights(
        fixtures.new_flights(s, d), _t(s, d).flight, _t(s, d).airplane, _t(s, d).airport),
    "load_new_flights_by_admin": lambda s, d: mt.load_new_flights(
        fixtures.new_flights_with_requester(s, d), _t(s, d).flight, _t(s, d).airplane, _t(s, d).airport,
        _t(s, d).permission, _t(s, d).airline_staff),
    "apply_flight_status": lambda s, d: mt.apply_flight_status(fixtures.status_changes(s, d), _t(s, d).flight),
    "flight_status_outcomes": lambda s, d: mt.flight_status_outcomes(fixtures.status_changes(s, d), _t(s, d).flight),
    "flight_status_outcomes_by_operator": lambda s, d: mt.flight_status_outcomes(
        fixtures.status_changes_with_requester(s, d), _t(s, d).flight, _t(s, d).permission, _t(s, d).airline_staff),
    "load_new_airplanes": lambda s, d: mt.load_new_airplanes(fixtures.new_airplanes(s, d), _t(s, d).airplane),
    "load_new_airports": lambda s, d: mt.load_new_airports(fixtures.new_airports(s, d), _t(s, d).airport),
    "permission_grant_outcomes": lambda s, d: mt.permission_grant_outcomes(
        fixtures.grants(s, d), _t(s, d).permission, _t(s, d).airline_staff),
    "apply_permission_grants": lambda s, d: mt.apply_permission_grants(
        fixtures.grants(s, d), _t(s, d).permission, _t(s, d).airline_staff),
    "agent_move_outcomes": lambda s, d: mt.agent_move_outcomes(
        fixtures.agent_moves(s, d), _t(s, d).booking_agent, _t(s, d).airline),
    "assign_agents_to_airline": lambda s, d: mt.assign_agents_to_airline(
        fixtures.agent_moves(s, d), _t(s, d).booking_agent, _t(s, d).airline),
    "load_registrations": lambda s, d: jobs.registration_outcomes(
        s, fixtures.registrations(s, d), _t(s, d).customer, _t(s, d).booking_agent, _t(s, d).airline_staff,
        _t(s, d).airline),
    "integrity_audit": lambda s, d: qa.integrity_audit(_t(s, d)),
    # the same changes on tables in hash buckets: only the buckets of changed keys are rewritten
    "apply_flight_status_by_buckets": lambda s, d: _by_buckets(
        s, "flight", "flight_num", _t(s, d).flight, fixtures.status_changes(s, d),
        lambda changes, rows: mt.flights_after(mt.status_decisions(changes, rows), rows)),
    "assign_agents_by_buckets": lambda s, d: _by_buckets(
        s, "booking_agent", "email", _t(s, d).booking_agent, fixtures.agent_moves(s, d),
        lambda moves, rows: mt.agents_after(mt.agent_decisions(moves, rows, _t(s, d).airline), rows)),
    "apply_permission_grants_by_buckets": lambda s, d: _by_buckets(
        s, "permission", "username", _t(s, d).permission, fixtures.grants(s, d),
        lambda grants, rows: mt.permissions_after(mt.permission_grant_outcomes(grants, rows, _t(s, d).airline_staff), rows)),
    # the audit, kept up to date through a booking batch and a delete of flights
    "audit_after_batches": lambda s, d: _audit_after_batches(s, d),
    # the sales mart, kept up to date through a booking batch and a status batch
    "sales_mart_after_batches": lambda s, d: _mart_after_batches(s, d),
    # several windows at once from the cumulative day index
    "airline_windows_from_index": lambda s, d: _windows(s, d, "airline_name"),
    "agent_windows_from_index": lambda s, d: _windows(s, d, "booking_agent_email"),
    "customer_windows_from_index": lambda s, d: _windows(s, d, "customer_email"),
    # option variants on the same data
    "top_destinations_by_airline": lambda s, d: al.top_destinations(
        _t(s, d).flight, _t(s, d).airport, AS_OF, per_airline=True),
    "agent_own_upcoming_bookings": lambda s, d: ag.agent_upcoming_bookings(_sales(s, d), own_only=True),
    "agent_upcoming_flights": lambda s, d: ag.agent_upcoming_flights(_sales(s, d)),
    "upcoming_passengers": lambda s, d: ag.upcoming_passengers(_sales(s, d)),
    "book_tickets_upcoming_only": lambda s, d: _book_direct(s, d, require_upcoming=True),
    "book_tickets_agent_same_airline": lambda s, d: _book_agent(s, d, same_airline=True),
    "customer_monthly_spend_6m_year_end": lambda s, d: cu.customer_monthly_spend_6m(
        _sales(s, d), _t(s, d).customer, dt.date(2001, 1, 15)),
    "customer_monthly_spend_12m": lambda s, d: cu.customer_monthly_spend_6m(
        _sales(s, d), _t(s, d).customer, AS_OF, months=12),
    "airline_monthly_tickets_24m": lambda s, d: al.airline_monthly_tickets_12m(
        _sales(s, d), _t(s, d).airline, AS_OF, months=24),
    # rows that the jobs write
    "new_flight_rows": lambda s, d: mt.new_flight_rows(fixtures.new_flights(s, d), QUERIES["load_new_flights"](s, d)),
    "new_airplane_rows": lambda s, d: mt.new_airplane_rows(
        fixtures.new_airplanes(s, d), QUERIES["load_new_airplanes"](s, d)),
    "booking_rows_ticket": lambda s, d: _booking_rows(s, d)[0],
    "booking_rows_purchases": lambda s, d: _booking_rows(s, d)[1],
    "registration_rows_customer": lambda s, d: _registration_rows(s, d)["customer"],
    "registration_rows_booking_agent": lambda s, d: _registration_rows(s, d)["booking_agent"],
    "registration_rows_airline_staff": lambda s, d: _registration_rows(s, d)["airline_staff"],
    "registration_rows_permission": lambda s, d: _registration_rows(s, d)["permission"],
}


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BUCKETS = 64
AUDIT_BUCKETS = 16


def _by_buckets(spark: SparkSession, table: str, key: str, rows: DataFrame, changes: DataFrame,
                change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Store the table in buckets, change it by a batch, and read it back."""
    path, schema = _folder(spark, f"bucketed-{table}"), schemas.SCHEMAS[table]
    bucketed.write(rows, path, key, BUCKETS)
    changes = changes.checkpoint()
    bucketed.update(spark, path, schema, key, changes, lambda held: change(changes, held))
    return bucketed.read(spark, path, schema)


def _audit_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, t = _folder(spark, "audit"), _t(spark, sf_dir)
    audit.start_audit(t, path, AUDIT_BUCKETS)
    ticket, purchases = (df.checkpoint() for df in _booking_rows(spark, sf_dir))
    audit.update_audit(spark, path, {"ticket": ticket, "purchases": purchases}, {}, 1)
    audit.update_audit(spark, path, {}, {"flight": t.flight.filter(F.col("flight_status") == "delayed")}, 2)
    return audit.read_violations(spark, path)


def _mart_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, t = _folder(spark, "sales-mart"), _t(spark, sf_dir)
    mart.start_mart(t.purchases, t.ticket, t.flight, path)
    # the batch finds the pairs already sold in the mart, where purchases and tickets are joined
    tickets, purchases = (df.checkpoint() for df in _booking_rows(spark, sf_dir, mart.read_mart(spark, path)))
    mart.update_mart(spark, path, purchases, tickets, t.flight, t.flight.limit(0))
    after = QUERIES["apply_flight_status"](spark, sf_dir).checkpoint()
    changed = after.select("flight_num", "flight_status").exceptAll(t.flight.select("flight_num", "flight_status"))
    mart.update_mart(spark, path, purchases.limit(0), tickets.limit(0), after, changed)
    return mart.read_mart(spark, path)


#: The windows of O14, O21 and O22, a calendar month, a quarter, and a long one.
SPANS = [(AS_OF - dt.timedelta(days=n), AS_OF) for n in (30, 31, 365)] + [
    (dt.date(2000, 12, 1), dt.date(2000, 12, 31)), (dt.date(2001, 1, 1), dt.date(2001, 3, 31)), (dt.date(1995, 3, 15), dt.date(2000, 2, 29))]


def _windows(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    path = _folder(spark, f"day-index-{key}")
    day_index.write_day_index(_sales(spark, sf_dir), key, path)
    return day_index.windows(spark, path, SPANS).withColumnRenamed("key", key)


def _book_direct(spark: SparkSession, sf_dir: str, require_upcoming: bool = False) -> DataFrame:
    return _ranked(spark, sf_dir, fixtures.booking_requests(spark, sf_dir), require_upcoming).select(
        "request_id", "customer_email", "flight_num", "status")


def _ranked(spark: SparkSession, sf_dir: str, requests: DataFrame, require_upcoming: bool = False, agent: bool = False,
            sales: DataFrame | None = None) -> DataFrame:
    """Decided requests; the requests, and then the annotated requests, are written once (reliable checkpoints),
    as a booking job does: each is read several times by what follows."""
    ensure_checkpoint_dir(spark)
    t = _t(spark, sf_dir)
    requests = requests.checkpoint()
    if agent:
        requests = bk.agent_prechecks(requests, t.flight, t.booking_agent, t.customer)
    return bk.rank_requests(bk.annotate_requests(requests, t.flight, t.airplane, t.ticket, t.purchases, require_upcoming, sales).checkpoint())


def _book_agent(spark: SparkSession, sf_dir: str, same_airline: bool = False) -> DataFrame:
    reqs = (fixtures.agent_booking_requests_same_airline(spark, sf_dir) if same_airline
            else fixtures.agent_booking_requests(spark, sf_dir))
    return _ranked(spark, sf_dir, reqs, agent=True).select("request_id", bk.AGENT, "customer_email", "flight_num", "status")


def _decided(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """Ids need two passes over the decided requests (count, then number), so
    the decisions are checkpointed first (reliable checkpoint in the session's
    ``spark.checkpoint.dir``): the id plan then scans the checkpoint instead
    of re-deriving every decision for each pass."""
    return _ranked(spark, sf_dir, fixtures.booking_requests(spark, sf_dir), sales=sales).checkpoint()


def _ticket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.assign_ticket_ids(_decided(spark, sf_dir), _t(spark, sf_dir).ticket)


def _booking_rows(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    decided = _decided(spark, sf_dir, sales)
    return bk.booking_rows(decided, bk.assign_ticket_ids(decided, _t(spark, sf_dir).ticket))


def _registration_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return mt.registration_rows(fixtures.registrations(spark, sf_dir), QUERIES["load_registrations"](spark, sf_dir))
