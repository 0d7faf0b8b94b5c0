"""Capacity, duplicates and batch booking.

The reference books one form post at a time: full flight -> 3, else the
customer already holds a ticket of the flight -> 2, else a new ticket and
purchase -> 1 (quirk Q10 keeps that order).  Here a whole table of requests
is decided at once.  Because seats never free up, the sequential rule has an
exact set form:

* remaining(f) = greatest(seats - sold, 0)
* candidate   = first request of its (customer, flight) by (ts, request_id)
                and no earlier purchase of that pair
* before      = number of candidates strictly earlier on the same flight
* status      = 3 if before >= remaining, else 2 if not candidate, else 1

``before`` is a running count per flight.  A flight that draws a third of
all requests, even within an hour, would make that one window partition a
single task, so the count has levels: requests are cut into (flight, hour,
second) pieces, the totals of seconds are summed up within the hour and those
of hours within the flight (one row per piece), and the running count inside
a second is a window over that second only.

New ticket ids (O34) continue after the largest numeric id in the ticket
table, contiguous.  Their global order is built from levels (rank in flight,
flights inside hash buckets, then the buckets), so no single task sees all
bookings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightmart.functions.ordering import running_before

BOOKED, ALREADY_BOUGHT, NO_SEATS = 1, 2, 3
WRONG_AIRLINE, UNKNOWN_CUSTOMER, NOT_UPCOMING = -1, -2, -3

AGENT = "booking_agent_email"
# pieces of a flight's requests, from coarse to fine
CHUNK_UNITS = ("hour", "second")


def seat_availability(flight: DataFrame, airplane: DataFrame, ticket: DataFrame) -> DataFrame:
    """Per flight, seats of its airplane (same airline), tickets sold, seats remaining.

    "Full" is ``sold >= seats`` (Q9 corrected), so remaining never goes
    below 0.  A flight whose airplane is not the airline's (or unknown) has
    NULL seats and 0 remaining: it cannot be booked.
    """
    return availability(flight, airplane, sold_tickets(ticket))


def sold_tickets(ticket: DataFrame) -> DataFrame:
    return ticket.groupBy("flight_num").agg(F.count(F.lit(1)).alias("sold"))


def availability(flight: DataFrame, airplane: DataFrame, sold: DataFrame) -> DataFrame:
    """O30 from tickets sold per flight (flight_num, sold)."""
    planes = airplane.select(F.col("airline_name").alias("_al"), F.col("id").alias("_id"), "seats")
    f = flight.select("flight_num", "airline_name", "airplane_id")
    with_seats = f.join(planes, (f["airplane_id"] == planes["_id"]) & (f["airline_name"] == planes["_al"]), "left")
    out = with_seats.join(sold, "flight_num", "left").select(
        "flight_num", "airline_name",
        F.col("seats").cast("bigint").alias("seats"),
        F.coalesce(F.col("sold"), F.lit(0)).cast("bigint").alias("sold"),
    )
    return out.withColumn("remaining", F.greatest(F.col("seats") - F.col("sold"), F.lit(0)).cast("bigint"))


def duplicate_bookings(purchases: DataFrame, ticket: DataFrame) -> DataFrame:
    """O31 (report form): (customer, flight) pairs holding more than one ticket."""
    return (purchases.join(ticket, "ticket_id")
            .groupBy("customer_email", "flight_num")
            .agg(F.count(F.lit(1)).alias("tickets"))
            .filter(F.col("tickets") > 1))


def existing_pairs(purchases: DataFrame, ticket: DataFrame, requests: DataFrame,
                   sales: DataFrame | None = None) -> DataFrame:
    """O31 (request check): distinct (customer, flight) pairs already purchased, for requested pairs only.

    With ``sales`` (e.g. the materialised mart) the pairs are read from it
    directly instead of joining purchases with ticket (two fact-sized sides).
    """
    wanted = requests.select("customer_email", "flight_num").distinct()
    if sales is not None:
        held = sales.select("customer_email", "flight_num")
    else:
        held = (purchases.select("ticket_id", "customer_email")
                .join(ticket.join(wanted.select("flight_num").distinct(), "flight_num", "left_semi"), "ticket_id")
                .select("customer_email", "flight_num"))
    return held.join(wanted, ["customer_email", "flight_num"], "left_semi").distinct()


def decide(requests: DataFrame, flight: DataFrame, airplane: DataFrame, ticket: DataFrame,
           purchases: DataFrame, chunk_units: Sequence[str] = CHUNK_UNITS, require_upcoming: bool = False,
           sales: DataFrame | None = None) -> DataFrame:
    """O32 core: status and in-flight booking rank for every request.

    Returns the request columns plus ``status`` and ``flight_rank`` (1-based
    order of the booked request on its flight, NULL unless booked).

    ``annotate_requests`` followed by ``rank_requests``; a job can write the
    annotated requests in between (they are read twice by the ranking).
    """
    annotated = annotate_requests(requests, flight, airplane, ticket, purchases, require_upcoming, sales)
    return rank_requests(annotated, chunk_units)


def annotate_requests(requests: DataFrame, flight: DataFrame, airplane: DataFrame, ticket: DataFrame,
                      purchases: DataFrame, require_upcoming: bool = False,
                      sales: DataFrame | None = None, sold: DataFrame | None = None) -> DataFrame:
    """Each request with its flight's remaining seats and its ``_cand`` flag.

    ``sales`` (customer_email, flight_num) and ``sold`` (flight_num, sold), if
    given, take the place of purchases and tickets; they may cover only the
    flights that are asked for.

    ``requests`` has request_id, ts, customer_email, flight_num and an
    optional ``pre_status`` (a non-null value is a precheck rejection that
    passes through unchanged and takes no seat).
    """
    if "pre_status" not in requests.columns:
        requests = requests.withColumn("pre_status", F.lit(None).cast("int"))
    req = requests
    if require_upcoming:
        fstatus = flight.select("flight_num", F.col("flight_status").alias("_fstatus"))
        req = req.join(fstatus, "flight_num", "left").withColumn(
            "pre_status", F.when(F.col("pre_status").isNull()
                                 & (F.coalesce(F.col("_fstatus"), F.lit("")) != "upcoming"),
                                 F.lit(NOT_UPCOMING)).otherwise(F.col("pre_status"))).drop("_fstatus")
    req = req.withColumn("_ok", F.col("pre_status").isNull())
    # The first valid request of each (customer, flight) pair: a min()
    # aggregate (partial per task, then one row per pair) rather than a
    # window, so a pair with a huge number of repeats is reduced map-side.
    # It only needs the request table, so it is taken before the joins.
    firsts = (req.filter(F.col("_ok")).groupBy("customer_email", "flight_num")
              .agg(F.min(F.struct("ts", "request_id")).alias("_first"))
              .select("customer_email", "flight_num", F.col("_first.request_id").alias("_first_id")))
    req = req.join(firsts, ["customer_email", "flight_num"], "left")

    req_flights = requests.select("flight_num").distinct()
    if sold is None:
        sold = sold_tickets(ticket.join(req_flights, "flight_num", "left_semi"))
    cap = availability(flight.join(req_flights, "flight_num", "left_semi"), airplane, sold)
    held = existing_pairs(purchases, ticket, requests, sales).withColumn("_held", F.lit(True))
    r = (req
         .join(cap.select("flight_num", "remaining"), "flight_num", "left")
         .join(held, ["customer_email", "flight_num"], "left")
         .withColumn("remaining", F.coalesce("remaining", F.lit(0)))
         .withColumn("_cand", (F.col("_ok") & F.coalesce(F.col("request_id") == F.col("_first_id"), F.lit(False))
                               & F.col("_held").isNull()).cast("int")))

    extra = [c for c in requests.columns if c not in ("request_id", "ts", "customer_email", "flight_num", "pre_status")]
    return r.select("request_id", "ts", "customer_email", "flight_num", *extra, "pre_status", "_ok",
                    "remaining", "_cand")


def rank_requests(r: DataFrame, chunk_units: Sequence[str] = CHUNK_UNITS) -> DataFrame:
    """Statuses from annotated requests: running count of candidates per flight, in levels."""
    r = running_before(r, ["flight_num"], "_cand", ["ts", "request_id"], [F.date_trunc(u, F.col("ts")) for u in chunk_units], "_before")
    status = (F.when(~F.col("_ok"), F.col("pre_status"))
              .when(F.col("_before") >= F.col("remaining"), F.lit(NO_SEATS))
              .when(F.col("_cand") == 0, F.lit(ALREADY_BOUGHT))
              .otherwise(F.lit(BOOKED)))
    extra = [c for c in r.columns if c not in ("request_id", "ts", "customer_email", "flight_num", "pre_status",
                                               "_ok", "remaining", "_cand", "_before")]
    return r.select(
        "request_id", "ts", "customer_email", "flight_num", *extra,
        status.cast("int").alias("status"),
        F.when(status == BOOKED, F.col("_before") + 1).cast("bigint").alias("flight_rank"),
    )


def book_tickets_direct(requests: DataFrame, flight: DataFrame, airplane: DataFrame, ticket: DataFrame,
                        purchases: DataFrame, **kw) -> DataFrame:
    """Per request, status 1 booked / 2 already bought / 3 no seats."""
    return decide(requests, flight, airplane, ticket, purchases, **kw).select(
        "request_id", "customer_email", "flight_num", "status")


def agent_prechecks(requests: DataFrame, flight: DataFrame, booking_agent: DataFrame,
                    customer: DataFrame) -> DataFrame:
    """O33 prechecks: -1 when the flight's airline is not the agent's, else -2 for an unknown customer."""
    fa = flight.select("flight_num", F.col("airline_name").alias("_flight_airline"))
    aa = booking_agent.select(F.col("email").alias(AGENT), F.col("airline_name").alias("_agent_airline"))
    known = customer.select(F.col("email").alias("customer_email")).distinct().withColumn("_known", F.lit(True))
    r = (requests.join(fa, "flight_num", "left").join(aa, AGENT, "left")
         .join(known, "customer_email", "left"))
    same_airline = F.coalesce(F.col("_flight_airline") == F.col("_agent_airline"), F.lit(False))
    pre = (F.when(~same_airline, F.lit(WRONG_AIRLINE))
           .when(F.col("_known").isNull(), F.lit(UNKNOWN_CUSTOMER)))
    return r.select(*requests.columns, pre.cast("int").alias("pre_status"))


def book_tickets_agent(requests: DataFrame, flight: DataFrame, airplane: DataFrame, ticket: DataFrame,
                       purchases: DataFrame, booking_agent: DataFrame, customer: DataFrame, **kw) -> DataFrame:
    """As O32 for agents, after the airline (-1) and customer (-2) prechecks."""
    checked = agent_prechecks(requests, flight, booking_agent, customer)
    return decide(checked, flight, airplane, ticket, purchases, **kw).select(
        "request_id", AGENT, "customer_email", "flight_num", "status")


def last_ticket_id(ticket: DataFrame) -> DataFrame:
    """One row, ``m``: the largest numeric ticket id, 0 without any."""
    return ticket.select(F.coalesce(F.max(F.expr("try_cast(ticket_id AS DECIMAL(38,0))")), F.lit(0).cast("decimal(38,0)")).alias("m"))


def assign_ticket_ids(decided: DataFrame, ticket: DataFrame, after: int | None = None) -> DataFrame:
    """Contiguous new ticket ids for the booked requests.

    id = largest numeric existing id (0 on an empty table; Q8 corrected:
    numeric, not text, max) + position of the booking in the order (bucket,
    flight_num, rank on the flight).  The position is a three-level prefix
    sum: ranks inside a flight come from ``decide``; flights are counted
    inside 4096 buckets, the first three hexadecimal digits of
    md5(flight_num), which spread flights evenly however they are spelled (a
    window per bucket); the bucket totals, 4096 rows, are prefix-summed last.
    ``after``: the largest id, where it is known (booking jobs keep it).
    """
    max_id = last_ticket_id(ticket).scalar() if after is None else F.lit(str(after)).cast("decimal(38,0)")
    booked = decided.filter(F.col("status") == BOOKED).withColumn(
        "_bucket", F.substring(F.md5("flight_num"), 1, 3))
    per_flight = booked.groupBy("_bucket", "flight_num").agg(F.count(F.lit(1)).alias("_n"))
    per_flight = per_flight.withColumn(
        "_flight_before",
        F.coalesce(F.sum("_n").over(Window.partitionBy("_bucket").orderBy("flight_num")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_bucket = (per_flight.groupBy("_bucket").agg(F.sum("_n").alias("_bn"))
                  .withColumn("_bucket_before",
                              F.coalesce(F.sum("_bn").over(Window.orderBy("_bucket")
                                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                  .select("_bucket", "_bucket_before"))
    ids = (booked.join(per_flight.select("_bucket", "flight_num", "_flight_before"), ["_bucket", "flight_num"])
           .join(per_bucket, "_bucket"))
    position = (F.col("_bucket_before") + F.col("_flight_before") + F.col("flight_rank")).cast("decimal(38,0)")
    return ids.select("request_id", (max_id + position).cast("decimal(38,0)").cast("string").alias("ticket_id"))


def booking_rows(decided: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New ticket and purchases rows for the booked requests (P02 appends).

    p_date is the request's date; booking_agent_email is NULL for direct
    sales and the agent for agent sales.
    """
    b = decided.filter(F.col("status") == BOOKED).join(ids, "request_id")
    agent = F.col(AGENT) if AGENT in decided.columns else F.lit(None).cast("string")
    tickets = b.select("ticket_id", "flight_num")
    purchases = b.select("ticket_id", "customer_email", agent.alias(AGENT), F.to_date("ts").alias("p_date"))
    return tickets, purchases
