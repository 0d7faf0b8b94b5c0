"""Batch booking (O30-O34) against a plain sequential loop, plus invariants."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from flightmart.operators import booking as bk
from tests.conftest import flight_row, make_tables

T0 = dt.datetime(2024, 1, 1)


def sequential(requests, seats, sold, held):
    """The reference's one-request-at-a-time rule: full -> 3, held -> 2, else book -> 1."""
    sold, held = dict(sold), set(held)
    out = {}
    for rid, ts, cust, fl in sorted(requests, key=lambda r: (r[1], r[0])):
        cap = seats.get(fl)
        if cap is None or sold.get(fl, 0) >= cap:
            out[rid] = 3
        elif (cust, fl) in held:
            out[rid] = 2
        else:
            out[rid] = 1
            sold[fl] = sold.get(fl, 0) + 1
            held.add((cust, fl))
    return out


def scenario(spark, seed):
    rnd = random.Random(seed)
    flights, planes, tickets, purchases = [], [], [], []
    seats, sold, held = {}, {}, set()
    next_id = 1
    for f in range(4):
        fl = f"F{f}"
        owner = "A" if f != 3 else "B"  # F3's airplane belongs to another airline: no seats known
        flights.append(flight_row(fl, airline="A", plane=f"P{f}"))
        cap = rnd.randint(0, 6)
        planes.append((owner, f"P{f}", cap))
        if owner == "A":
            seats[fl] = cap
        for _ in range(rnd.randint(0, 5)):  # past sales, possibly oversold (Q9)
            c = f"c{rnd.randint(0, 4)}"
            tickets.append((str(next_id), fl))
            purchases.append((str(next_id), c, None, dt.date(2001, 1, 1)))
            sold[fl] = sold.get(fl, 0) + 1
            held.add((c, fl))
            next_id += 1
    tickets.append(("not-a-number", "F0"))
    sold["F0"] = sold.get("F0", 0) + 1
    reqs = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 180)), f"c{rnd.randint(0, 4)}",
             rnd.choice(["F0", "F1", "F2", "F3", "F9"])) for i in range(rnd.randint(5, 40))]
    t = make_tables(spark, flight=flights, airplane=planes, ticket=tickets, purchases=purchases)
    rdf = spark.createDataFrame(reqs, "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    return t, rdf, reqs, seats, sold, held, next_id - 1


@pytest.mark.parametrize("seed", range(6))
def test_batch_equals_sequential(spark, seed):
    t, rdf, reqs, seats, sold, held, max_id = scenario(spark, seed)
    expected = sequential(reqs, seats, sold, held)
    decided = bk.decide(rdf.repartition(3), t.flight, t.airplane, t.ticket, t.purchases, chunk_units=["hour"])
    got = {r.request_id: r.status for r in decided.collect()}
    assert got == expected
    # statuses do not depend on how the requests are partitioned or chunked
    again = bk.decide(rdf.repartition(1), t.flight, t.airplane, t.ticket, t.purchases, chunk_units=["hour", "minute", "second"])
    assert {r.request_id: r.status for r in again.collect()} == expected
    # ids: unique, contiguous, after the largest numeric id
    ids = sorted(int(r.ticket_id) for r in bk.assign_ticket_ids(decided, t.ticket).collect())
    n_booked = sum(1 for s in expected.values() if s == 1)
    assert ids == list(range(max_id + 1, max_id + 1 + n_booked))
    # invariants: booked never exceeds remaining seats; one booking per (customer, flight)
    rows = decided.collect()
    for fl, cap in seats.items():
        booked = sum(1 for r in rows if r.flight_num == fl and r.status == 1)
        assert booked <= max(cap - sold.get(fl, 0), 0)
    pairs = [(r.customer_email, r.flight_num) for r in rows if r.status == 1]
    assert len(pairs) == len(set(pairs))


def test_ids_start_after_numeric_max(spark):
    # Q8: "9" > "10" as text; the numeric max is 10, so new ids start at 11
    t = make_tables(spark, flight=[flight_row("F")], airplane=[("A", "P1", 5)],
                    ticket=[("9", "F"), ("10", "F")])
    reqs = spark.createDataFrame([(1, T0, "c", "F"), (2, T0, "d", "F")],
                                 "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    decided = bk.decide(reqs, t.flight, t.airplane, t.ticket, t.purchases)
    assert sorted(r.ticket_id for r in bk.assign_ticket_ids(decided, t.ticket).collect()) == ["11", "12"]
    tickets, purchases = bk.booking_rows(decided, bk.assign_ticket_ids(decided, t.ticket))
    assert tickets.count() == 2 and purchases.filter("booking_agent_email IS NULL").count() == 2


def test_empty_ticket_table_starts_at_one(spark):
    t = make_tables(spark, flight=[flight_row("F")], airplane=[("A", "P1", 5)])
    reqs = spark.createDataFrame([(1, T0, "c", "F")],
                                 "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    decided = bk.decide(reqs, t.flight, t.airplane, t.ticket, t.purchases)
    assert [r.ticket_id for r in bk.assign_ticket_ids(decided, t.ticket).collect()] == ["1"]


def test_full_is_checked_before_duplicate(spark):
    # Q9 + Q10: oversold flight (sold > seats) is full; a holder asking again gets 3, not 2
    t = make_tables(spark, flight=[flight_row("F")], airplane=[("A", "P1", 1)],
                    ticket=[("1", "F"), ("2", "F")],
                    purchases=[("1", "c", None, dt.date(2001, 1, 1)), ("2", "d", None, dt.date(2001, 1, 1))])
    avail = bk.seat_availability(t.flight, t.airplane, t.ticket).collect()[0]
    assert (avail.seats, avail.sold, avail.remaining) == (1, 2, 0)
    reqs = spark.createDataFrame([(1, T0, "c", "F")],
                                 "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    assert bk.book_tickets_direct(reqs, t.flight, t.airplane, t.ticket, t.purchases).collect()[0].status == 3


def test_require_upcoming_option(spark):
    # Q11: no server-side status check by default; optional rejection
    t = make_tables(spark, flight=[flight_row("F", status="in-progress")], airplane=[("A", "P1", 5)])
    reqs = spark.createDataFrame([(1, T0, "c", "F")],
                                 "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    assert bk.book_tickets_direct(reqs, t.flight, t.airplane, t.ticket, t.purchases).collect()[0].status == 1
    assert bk.book_tickets_direct(reqs, t.flight, t.airplane, t.ticket, t.purchases,
                                  require_upcoming=True).collect()[0].status == bk.NOT_UPCOMING


def test_agent_prechecks(spark):
    from tests.test_reports import cust
    t = make_tables(spark, flight=[flight_row("F", airline="A"), flight_row("G", airline="B")],
                    airplane=[("A", "P1", 5), ("B", "P1", 5)], booking_agent=[("ag", "1", "A")],
                    customer=[cust("c")])
    reqs = spark.createDataFrame(
        [(1, T0, "ag", "c", "G"), (2, T0, "ag", "nobody", "F"), (3, T0, "ag", "c", "F"), (4, T0, "ghost", "c", "F")],
        "request_id long, ts timestamp_ntz, booking_agent_email string, customer_email string, flight_num string")
    got = {r.request_id: r.status for r in bk.book_tickets_agent(
        reqs, t.flight, t.airplane, t.ticket, t.purchases, t.booking_agent, t.customer).collect()}
    assert got == {1: -1, 2: -2, 3: 1, 4: -1}


def test_duplicate_report(spark):
    t = make_tables(spark, ticket=[("1", "F"), ("2", "F"), ("3", "G")],
                    purchases=[("1", "c", None, dt.date(2001, 1, 1)), ("2", "c", "a", dt.date(2001, 1, 2)),
                               ("3", "c", None, dt.date(2001, 1, 1))])
    rows = bk.duplicate_bookings(t.purchases, t.ticket).collect()
    assert [(r.customer_email, r.flight_num, r.tickets) for r in rows] == [("c", "F", 2)]


def test_hot_flight_is_split_and_exact(spark):
    # one flight draws a third of all requests, spread over two days
    rnd = random.Random(7)
    flights = [flight_row(f"F{i}", plane=f"P{i}") for i in range(6)]
    planes = [("A", f"P{i}", 40 if i == 0 else rnd.randint(0, 8)) for i in range(6)]
    reqs = []
    for i in range(1500):
        fl = "F0" if i % 3 == 0 else f"F{rnd.randint(1, 5)}"
        reqs.append((i, T0 + dt.timedelta(minutes=rnd.randint(0, 48 * 60)), f"c{rnd.randint(0, 200)}", fl))
    t = make_tables(spark, flight=flights, airplane=planes)
    rdf = spark.createDataFrame(reqs, "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    seats = {f"F{i}": planes[i][2] for i in range(6)}
    expected = sequential(reqs, seats, {}, set())
    annotated = bk.annotate_requests(rdf, t.flight, t.airplane, t.ticket, t.purchases)
    got = {r.request_id: r.status for r in bk.rank_requests(annotated, "hour").collect()}
    assert got == expected
    # the hot flight's running count is spread over many (flight, hour) windows
    from pyspark.sql import functions as F
    pieces = rdf.filter("flight_num = 'F0'").select(F.date_trunc("hour", "ts")).distinct().count()
    assert pieces > 24


def test_held_pairs_from_sales_mart(spark):
    from flightmart.operators.facts import sales_fact
    t, rdf, reqs, seats, sold, held, _ = scenario(spark, 3)
    base = {r.request_id: r.status for r in bk.decide(rdf, t.flight, t.airplane, t.ticket, t.purchases).collect()}
    via_sales = bk.decide(rdf, t.flight, t.airplane, t.ticket, t.purchases,
                          sales=sales_fact(t.purchases, t.ticket, t.flight))
    assert {r.request_id: r.status for r in via_sales.collect()} == base == sequential(reqs, seats, sold, held)


def test_requests_with_missing_fields_are_kept(spark):
    t = make_tables(spark, flight=[flight_row("F")], airplane=[("A", "P1", 5)])
    reqs = spark.createDataFrame([(1, T0, "c", "F"), (2, None, "d", "F"), (3, T0, "e", None)],
                                 "request_id long, ts timestamp_ntz, customer_email string, flight_num string")
    got = {r.request_id: r.status for r in bk.decide(reqs, t.flight, t.airplane, t.ticket, t.purchases).collect()}
    assert set(got) == {1, 2, 3} and got[3] == 3
