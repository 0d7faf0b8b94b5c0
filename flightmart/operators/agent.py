"""Booking agent operators (O07, O08, O14-O17), for every agent at once."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.functions.aggregates import money, safe_avg, top_k, zero_filled_sum
from flightmart.functions.dates import as_date, days_before, in_range, in_window
from flightmart.functions.predicates import apply_criteria
from flightmart.sources.schemas import FLIGHT_COLUMNS, STATUS_UPCOMING

AGENT = "booking_agent_email"


def agent_upcoming_bookings(sales: DataFrame, own_only: bool = False, airport: DataFrame | None = None,
                            criteria=None, agents: DataFrame | None = None) -> DataFrame:
    """Per agent, every purchase on upcoming flights the agent sold at least one ticket of.

    All buyers and channels are listed (Q5); ``own_only=True`` keeps the
    agent's own sales only.  The output is, per flight, one row per (agent
    of the flight, purchase of the flight): it is an equi-join of the
    distinct (agent, flight) pairs with the flight's purchases on
    flight_num, not a cross product.  Flights are cut to upcoming ones
    (and to the search criteria, O08) before the join.  ``agents`` (a frame
    with a booking_agent_email column) restricts the output to those agents.
    """
    up = sales.filter(F.col("flight_status") == F.lit(STATUS_UPCOMING))
    if criteria is not None:
        up = apply_criteria(up, airport, criteria, "bound")
    cols = [AGENT, *FLIGHT_COLUMNS, "customer_email"]
    if own_only:
        own = up.filter(F.col(AGENT).isNotNull())
        if agents is not None:
            own = own.join(agents.select(AGENT).distinct(), AGENT, "left_semi")
        return own.select(*cols)
    agent_flights = up.filter(F.col(AGENT).isNotNull()).select(AGENT, "flight_num").distinct()
    if agents is not None:
        agent_flights = agent_flights.join(agents.select(AGENT).distinct(), AGENT, "left_semi")
    passengers = up.select(*FLIGHT_COLUMNS, "customer_email")
    return agent_flights.join(passengers, "flight_num").select(*cols)


def agent_upcoming_flights(sales: DataFrame, airport: DataFrame | None = None, criteria=None) -> DataFrame:
    """O07/O08, linear form: per agent, the upcoming flights it sold at least one ticket of.

    Together with ``upcoming_passengers`` this carries the same information
    as ``agent_upcoming_bookings`` (join them on flight_num), but each output
    is at most one row per sale, so a flight with very many agents and
    passengers does not multiply the two.  This is the form to compute for
    all agents at once; the joined page is for a chosen set of agents.
    """
    up = sales.filter((F.col("flight_status") == F.lit(STATUS_UPCOMING)) & F.col(AGENT).isNotNull())
    if criteria is not None:
        up = apply_criteria(up, airport, criteria, "bound")
    return up.select(AGENT, *FLIGHT_COLUMNS).dropDuplicates([AGENT, "flight_num"])


def upcoming_passengers(sales: DataFrame) -> DataFrame:
    """O07 linear form, second part: every purchase on an upcoming flight (any buyer, any channel)."""
    up = sales.filter(F.col("flight_status") == F.lit(STATUS_UPCOMING))
    return up.select("flight_num", "ticket_id", "customer_email", F.col(AGENT).alias("sold_by"))


def agent_upcoming_search(sales: DataFrame, airport: DataFrame, criteria=None, own_only: bool = False) -> DataFrame:
    """O07 restricted by search criteria; dates are bounds (Q3)."""
    return agent_upcoming_bookings(sales, own_only=own_only, airport=airport, criteria=criteria or {})


def _commission(sales: DataFrame, booking_agent: DataFrame, window, rate) -> DataFrame:
    price = F.col("price") if Decimal(str(rate)) == 1 else F.col("price") * F.lit(Decimal(str(rate)))
    facts = (sales.filter(window & F.col(AGENT).isNotNull())
             .select(AGENT, price.alias("price"), F.lit(1).alias("one")))
    out = zero_filled_sum(facts, booking_agent.select(F.col("email").alias(AGENT)), [AGENT],
                          {"commission": "price", "tickets": "one"})
    return out.select(AGENT, money("commission").alias("commission"),
                      F.col("tickets").cast("bigint").alias("tickets"))


def agent_commission(sales: DataFrame, booking_agent: DataFrame, as_of: dt.date, days: int = 30,
                     rate: float | str = 1) -> DataFrame:
    """Per agent, last ``days`` days: commission, tickets and average per ticket.

    The reference's commission is the full ticket price; ``rate`` scales it
    (default 1).  Average is half-even to cents (Q6), 0 with no tickets.
    Every agent of the agent table gets a row.
    """
    out = _commission(sales, booking_agent, in_window("p_date", as_of, days), rate)
    return out.withColumn("avg_commission", safe_avg("commission", "tickets"))


def agent_commission_range(sales: DataFrame, booking_agent: DataFrame, as_of: dt.date,
                           begin: dt.date | str | None = None, end: dt.date | str | None = None,
                           rate: float | str = 1) -> DataFrame:
    """Per agent, commission and tickets in the caller's window.

    A missing begin means as_of - 30 days, a missing end means as_of.
    """
    b = as_date(begin) if begin else days_before(as_of, 30)
    e = as_date(end) if end else as_date(as_of)
    return _commission(sales, booking_agent, in_range("p_date", b, e), rate)


def agent_top_customers_by_tickets(sales: DataFrame, as_of: dt.date, days: int = 183, k: int = 5) -> DataFrame:
    """Per agent, top k customers by tickets the agent sold them in the window."""
    agg = (sales.filter(in_window("p_date", as_of, days) & F.col(AGENT).isNotNull())
           .groupBy(AGENT, "customer_email").agg(F.count("flight_num").alias("tickets")))
    return top_k(agg, [AGENT], "tickets", k, ["customer_email"]).select(AGENT, "rank", "customer_email", "tickets")


def agent_top_customers_by_spend(sales: DataFrame, as_of: dt.date, days: int = 365, k: int = 5) -> DataFrame:
    """Per agent, top k customers by sum(price) in the window."""
    agg = (sales.filter(in_window("p_date", as_of, days) & F.col(AGENT).isNotNull())
           .groupBy(AGENT, "customer_email").agg(money(F.sum("price")).alias("spend")))
    return top_k(agg, [AGENT], "spend", k, ["customer_email"]).select(AGENT, "rank", "customer_email", "spend")
