"""Batch jobs write the right rows: appends and snapshots."""

from __future__ import annotations

import os
import tempfile

import pytest

from flightmart.plans import jobs
from flightmart.sources import fixtures
from flightmart.sources.tables import read_tables, write_tables
from tests.conftest import SF_SMALL


def test_jobs_on_fixture(spark):
    work = tempfile.mkdtemp(prefix="flightmart-jobs-")
    root = f"{work}/tables"
    write_tables(fixtures.load(spark, SF_SMALL), root)
    before = read_tables(spark, root)
    n_flights, n_planes = before.flight.count(), before.airplane.count()

    out = jobs.load_flights(spark, root, fixtures.new_flights(spark, SF_SMALL), f"{work}/o35")
    ok = out.filter("outcome = 'ok'").count()
    assert ok > 0 and read_tables(spark, root).flight.count() == n_flights + ok

    out = jobs.load_airplanes(spark, root, fixtures.new_airplanes(spark, SF_SMALL), f"{work}/o37")
    assert read_tables(spark, root).airplane.count() == n_planes + out.filter("outcome = 'ok'").count()

    jobs.change_statuses(spark, root, fixtures.status_changes(spark, SF_SMALL), f"{work}/flight_v2", f"{work}/o36")
    assert spark.read.parquet(f"{work}/flight_v2").count() == read_tables(spark, root).flight.count()

    jobs.grant_permissions(spark, root, fixtures.grants(spark, SF_SMALL), f"{work}/permission_v2", f"{work}/o39")
    new_perm = spark.read.parquet(f"{work}/permission_v2")
    assert new_perm.filter("permission = ''").count() < before.permission.filter("permission = ''").count()

    jobs.book(spark, root, fixtures.booking_requests(spark, SF_SMALL), f"{work}/book", 0)
    booked = spark.read.parquet(f"{work}/book/decided").filter("status = 1").count()
    assert spark.read.parquet(f"{work}/book/ticket").count() == booked > 0


def test_agent_booking_job(spark):
    work = tempfile.mkdtemp(prefix="flightmart-jobs-")
    root = f"{work}/tables"
    write_tables(fixtures.load(spark, SF_SMALL), root)
    jobs.book(spark, root, fixtures.agent_booking_requests(spark, SF_SMALL), f"{work}/book", 0, agent=True)
    decided = spark.read.parquet(f"{work}/book/decided")
    import __spark_entry__ as entry
    expected = {r.request_id: r.status for r in entry.queries()["book_tickets_agent"](spark, SF_SMALL).collect()}
    assert {r.request_id: r.status for r in decided.collect()} == expected
    purchases = spark.read.parquet(f"{work}/book/purchases")
    assert purchases.filter("booking_agent_email IS NULL").count() == 0
    assert purchases.count() == sum(1 for s in expected.values() if s == 1)


def test_nightly_reports(spark):
    from flightmart.operators import customer as cu
    from flightmart.operators.facts import sales_of
    from flightmart.plans import nightly
    work = tempfile.mkdtemp(prefix="flightmart-nightly-")
    root = f"{work}/tables"
    t = fixtures.load(spark, SF_SMALL)
    write_tables(t, root)
    names = nightly.run_reports(spark, root, f"{work}/out", fixtures.AS_OF)
    assert "airline_revenue_share" in names and "customer_monthly_spend_6m" in names
    written = spark.read.parquet(f"{work}/out/customer_monthly_spend_6m")
    direct = cu.customer_monthly_spend_6m(sales_of(t), t.customer, fixtures.AS_OF)
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, direct.collect()))
    # the same job on the bucketed fact tables writes the same reports
    from flightmart.sources.tables import write_bucketed_facts
    write_bucketed_facts(t, f"{work}/bucketed", buckets=4, prefix="nightly_fm")
    nightly.run_reports(spark, root, f"{work}/out_b", fixtures.AS_OF, bucketed_prefix="nightly_fm")
    for name in ("customer_monthly_spend_6m", "airline_revenue_split", "agent_commission"):
        a = spark.read.parquet(f"{work}/out/{name}").collect()
        b = spark.read.parquet(f"{work}/out_b/{name}").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)), name


def test_nightly_reports_see_what_the_jobs_sold_and_changed(spark):
    from flightmart.operators.facts import sales_of
    from flightmart.plans import nightly
    work = tempfile.mkdtemp(prefix="flightmart-nightly-")
    root = f"{work}/tables"
    write_tables(fixtures.load(spark, SF_SMALL), root)
    jobs.book(spark, root, fixtures.booking_requests(spark, SF_SMALL), f"{work}/book", 0)
    jobs.change_statuses(spark, root, fixtures.status_changes(spark, SF_SMALL), f"{work}/flight_v2", f"{work}/o36")
    nightly.run_reports(spark, root, f"{work}/out", fixtures.AS_OF, bookings=f"{work}/book", snapshots={"flight": f"{work}/flight_v2"})
    sold = spark.read.parquet(f"{work}/book/ticket").count()
    assert sold > 0 and spark.read.parquet(f"{work}/out/customer_purchase_history").count() == sales_of(read_tables(spark, root)).count() + sold
    upcoming = spark.read.parquet(f"{work}/flight_v2").filter("flight_status = 'upcoming'").count()
    assert spark.read.parquet(f"{work}/out/public_upcoming_flights").count() == upcoming
    assert {"integrity_audit", "seat_availability", "staff_permissions"} <= set(os.listdir(f"{work}/out"))


def _sequential_registrations(regs, cust, agents, bids, staff, airlines):
    cust, agents, bids, staff = set(cust), set(agents), set(bids), set(staff)
    out = {}
    for rid, ts, kind, key, _, airline, b_id in sorted(regs, key=lambda r: (r[1], r[0])):
        if kind == "customer":
            res = "existing" if key in cust else "ok"
            if res == "ok":
                cust.add(key)
        elif kind == "agent":
            if key in agents:
                res = "existing"
            elif airline not in airlines:
                res = "unknown_airline"
            elif b_id in bids:
                res = "existing_b_id"
            else:
                res = "ok"
                agents.add(key)
                bids.add(b_id)
        else:
            if airline not in airlines:
                res = "unknown_airline"
            elif key in staff:
                res = "existing"
            else:
                res = "ok"
                staff.add(key)
        out[rid] = res
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_register_exact_interleaved_batch(spark, seed):
    import datetime as dt
    import random

    from tests.conftest import make_tables
    from tests.test_reports import cust
    work = tempfile.mkdtemp(prefix="flightmart-reg-")
    t = make_tables(spark, airline=[("A",)], customer=[cust("c0")], booking_agent=[("a0", "b0", "A")],
                    airline_staff=[("s0", "A", "f", "l", dt.date(1970, 1, 1))])
    write_tables(t, f"{work}/tables")
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    regs = [(0, t0, "agent", "k1", "k1", "A", "b1"), (1, t0 + dt.timedelta(seconds=1), "agent", "k2", "k2", "A", "b1"),
            (2, t0 + dt.timedelta(seconds=2), "agent", "k2", "k2", "A", "b2")]   # interleaved key / b_id
    for i in range(3, 60):
        kind = rnd.choice(["customer", "agent", "staff"])
        key = {"customer": "c", "agent": "a", "staff": "s"}[kind] + str(rnd.randint(0, 6))
        regs.append((i, t0 + dt.timedelta(seconds=rnd.randint(0, 30)), kind, key, key,
                     rnd.choice(["A", "Z"]) if kind != "customer" else None,
                     "b" + str(rnd.randint(0, 6)) if kind == "agent" else None))
    schema = "request_id long, ts timestamp_ntz, kind string, key string, name string, airline_name string, b_id string"
    df = spark.createDataFrame(regs, schema)
    expected = _sequential_registrations(regs, ["c0"], ["a0"], ["b0"], ["s0"], {"A"})
    got = {r.request_id: r.outcome for r in jobs.register(spark, f"{work}/tables", df, f"{work}/out").collect()}
    assert got == expected
    assert got[0] == "ok" and got[1] == "existing_b_id" and got[2] == "ok"


def test_register_exact_on_fixture_equals_sequential(spark):
    work = tempfile.mkdtemp(prefix="flightmart-reg-")
    t = fixtures.load(spark, SF_SMALL)
    write_tables(t, f"{work}/tables")
    regs_df = fixtures.registrations(spark, SF_SMALL)
    regs = [tuple(r) for r in regs_df.select("request_id", "ts", "kind", "key", "name", "airline_name", "b_id").collect()]
    expected = _sequential_registrations(
        regs, [r.email for r in t.customer.collect()], [r.email for r in t.booking_agent.collect()],
        [r.b_id for r in t.booking_agent.collect()], [r.username for r in t.airline_staff.collect()],
        {r.name for r in t.airline.collect()})
    got = {r.request_id: r.outcome for r in jobs.register(spark, f"{work}/tables", regs_df,
                                                                f"{work}/out").collect()}
    assert got == expected


def test_booking_batches_share_one_history(spark):
    """Two direct batches, one agent batch, one replay: no sale lost, no ticket id issued twice."""
    from pyspark.sql import functions as F
    work = tempfile.mkdtemp(prefix="flightmart-book-")
    root, out = f"{work}/tables", f"{work}/book"
    write_tables(fixtures.load(spark, SF_SMALL), root)
    direct = fixtures.booking_requests(spark, SF_SMALL)
    jobs.book(spark, root, direct.filter("request_id % 2 = 0"), out, 0)
    jobs.book(spark, root, direct.filter("request_id % 2 = 1"), out, 1)
    jobs.book(spark, root, fixtures.agent_booking_requests(spark, SF_SMALL), out, 2, agent=True)
    tickets = lambda: sorted(map(tuple, spark.read.parquet(f"{out}/ticket").collect()))
    first = tickets()
    with pytest.raises(ValueError):
        jobs.book(spark, root, direct, out, 2)
    jobs.book(spark, root, fixtures.agent_booking_requests(spark, SF_SMALL), out, 2, agent=True, replay=True)
    assert tickets() == first
    booked = spark.read.parquet(f"{out}/decided").filter("status = 1").count()
    before, after = read_tables(spark, root), read_tables(spark, root, bookings=out)
    assert booked > 0 and after.ticket.count() == before.ticket.count() + booked
    new = spark.read.parquet(f"{out}/ticket")
    assert new.select("ticket_id").distinct().count() == booked == spark.read.parquet(f"{out}/purchases").count()
    assert after.ticket.join(after.purchases, "ticket_id", "left_anti").isEmpty()
    sold = after.ticket.groupBy("flight_num").agg(F.count(F.lit(1)).alias("sold"))
    seats = after.flight.join(after.airplane, (F.col("airplane_id") == F.col("id")) & (after.flight.airline_name == after.airplane.airline_name))
    over = (sold.join(seats, "flight_num").filter("sold > seats").select("flight_num")
            .join(new.select("flight_num").distinct(), "flight_num", "left_semi"))
    assert over.isEmpty()


def test_twenty_digit_ticket_ids(spark):
    from flightmart.operators import booking as bk
    decided = spark.createDataFrame([(1, "A", 1, 1), (2, "A", 1, 2), (3, "B", 3, None)],
                                    "request_id long, flight_num string, status int, flight_rank long")
    ticket = spark.createDataFrame([("5", "A"), ("99999999999999999999", "A"), ("x", "B")], "ticket_id string, flight_num string")
    got = {r.request_id: r.ticket_id for r in bk.assign_ticket_ids(decided, ticket).collect()}
    assert got == {1: "100000000000000000000", 2: "100000000000000000001"}


def test_registration_rows_keep_all_columns(spark):
    work = tempfile.mkdtemp(prefix="flightmart-reg-")
    write_tables(fixtures.load(spark, SF_SMALL), f"{work}/tables")
    regs = fixtures.registrations(spark, SF_SMALL)
    out = jobs.register(spark, f"{work}/tables", regs, f"{work}/out").filter("outcome = 'ok'")
    t = read_tables(spark, f"{work}/tables")
    for kind, table, key, cols in (("customer", t.customer, "email", ["street", "phone_number", "passport_number", "date_of_birth"]),
                                   ("staff", t.airline_staff, "username", ["first_name", "last_name", "date_of_birth"])):
        new = table.join(out.filter(f"kind = '{kind}'").select("key"), table[key] == out.key, "left_semi")
        wanted = regs.join(out.filter(f"kind = '{kind}'").select("request_id"), "request_id", "left_semi")
        assert sorted(map(tuple, new.select(key, *cols).collect())) == sorted(map(tuple, wanted.select("key", *cols).collect()))
