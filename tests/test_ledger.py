"""Batches are seen whole or not at all: jobs killed between any two writes and run again."""

from __future__ import annotations

import datetime as dt
import tempfile
from dataclasses import fields

import pytest

from flightmart.plans import jobs
from flightmart.sources import fixtures, ledger
from flightmart.sources.tables import Tables, read_tables, write_tables
from tests.conftest import flight_row, make_tables, ts
from tests.test_reports import cust


class Killed(Exception):
    pass


def world(spark):
    t = make_tables(spark, airline=[("A",), ("B",)], airplane=[("A", "P1", 3), ("B", "P2", 2)], airport=[("X", "c1"), ("Y", "c2")],
                    flight=[flight_row(1), flight_row(2, "B", "P2")], customer=[cust("c0"), cust("c1")], booking_agent=[("a0", "b0", "A")],
                    airline_staff=[("s0", "A", "f", "l", dt.date(1970, 1, 1))], ticket=[("7", "1")], purchases=[("7", "c0", None, dt.date(2001, 1, 1))])
    root = tempfile.mkdtemp(prefix="flightmart-ledger-")
    write_tables(t, f"{root}/tables")
    return root


def state(spark, root, **kw):
    t = read_tables(spark, f"{root}/tables", **kw)
    return {f.name: sorted(map(repr, getattr(t, f.name).collect())) for f in fields(Tables)}


def registrations(spark):
    day = ts("2001-07-01 10:00:00")
    rows = [(1, day, "customer", "c9", None, None), (2, day, "customer", "c0", None, None), (3, day, "agent", "a1", "A", "b1"),
            (4, day, "agent", "a2", "A", "b1"), (5, day, "staff", "s1", "B", None), (6, day, "staff", "s2", "nowhere", None)]
    return spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, kind string, key string, airline_name string, b_id string")


def flights(spark):
    rows = [(i, ts("2001-07-01 10:00:00"), *flight_row(num, "A", "P1", dep, "Y")) for i, num, dep in ((1, 10, "X"), (2, 1, "X"), (3, 10, "X"), (4, 11, "Y"))]
    return spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, flight_num string, airline_name string, airplane_id string, depart_name string, arrive_name string, "
                                       "depart_time timestamp_ntz, arrive_time timestamp_ntz, price decimal(10,2), flight_status string")


JOBS = {
    "register": lambda spark, root, out: jobs.register(spark, f"{root}/tables", registrations(spark), out, batch_id=0),
    "load_flights": lambda spark, root, out: jobs.load_flights(spark, f"{root}/tables", flights(spark), out, batch_id=0),
    "load_airports": lambda spark, root, out: jobs.load_airports(
        spark, f"{root}/tables", spark.createDataFrame([(1, "x", "c"), (2, "z", "c"), (3, "z", "d")], "request_id long, name string, city string"), out, batch_id=0),
    "load_airplanes": lambda spark, root, out: jobs.load_airplanes(
        spark, f"{root}/tables", spark.createDataFrame([(1, "A", "5", "9"), (2, "A", "x", "9"), (3, "A", "5", "8")], "request_id long, airline_name string, airplane_id string, seats string"), out, batch_id=0),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_a_killed_load_run_again_equals_one_run(spark, name, monkeypatch):
    whole, broken = world(spark), world(spark)
    start = state(spark, broken)
    expected = sorted(map(repr, JOBS[name](spark, whole, f"{whole}/out").collect()))
    after = state(spark, whole)
    assert after != start
    real = {f: getattr(ledger, f) for f in ("stage", "commit")}
    real_out = jobs._written
    writes = 2 + (4 if name == "register" else 1)
    for kill_at in range(writes):
        left = [kill_at]

        def counted(f):
            def run(*a, **kw):
                if not left[0]:
                    raise Killed
                left[0] -= 1
                return f(*a, **kw)
            return run

        for f in real:
            monkeypatch.setattr(ledger, f, counted(real[f]))
        monkeypatch.setattr(jobs, "_written", counted(real_out))
        with pytest.raises(Killed):
            JOBS[name](spark, broken, f"{broken}/out")
        assert state(spark, broken) == start  # nothing of the batch is seen
    for f in real:
        monkeypatch.setattr(ledger, f, real[f])
    monkeypatch.setattr(jobs, "_written", real_out)
    assert sorted(map(repr, JOBS[name](spark, broken, f"{broken}/out").collect())) == expected
    assert state(spark, broken) == after
    # run once more after its commit: nothing changes, the outcomes are those of the batch
    assert sorted(map(repr, JOBS[name](spark, broken, f"{broken}/other").collect())) == expected
    assert state(spark, broken) == after


def test_staged_rows_of_another_table_never_surface(spark, monkeypatch):
    """A batch dies after staging customers; the next job takes its number and publishes airports only."""
    root = world(spark)
    start = state(spark, root)
    monkeypatch.setattr(ledger, "commit", lambda *a, **kw: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        jobs.register(spark, f"{root}/tables", registrations(spark), f"{root}/out")
    monkeypatch.undo()
    JOBS["load_airports"](spark, root, f"{root}/out2")
    after = state(spark, root)
    assert after["customer"] == start["customer"] and len(after["airport"]) == len(start["airport"]) + 1
    with pytest.raises(ValueError, match="before the last one"):
        ledger.number(ledger.committed(spark, f"{root}/tables") | {5: None}, 3)


def test_snapshot_adds_later_loads_only(spark):
    root = world(spark)
    jobs.load_flights(spark, f"{root}/tables", flights(spark), f"{root}/o1")
    changes = spark.createDataFrame([(1, ts("2001-07-02 10:00:00"), "A", "10", "delayed")], "request_id long, ts timestamp_ntz, airline_name string, flight_num string, flight_status string")
    jobs.change_statuses(spark, f"{root}/tables", changes, f"{root}/flight_v2", f"{root}/o2")
    later = flights(spark).where("request_id = 1").selectExpr("*").withColumn("flight_num", fixtures.F.lit("99"))
    jobs.load_flights(spark, f"{root}/tables", later, f"{root}/o3")
    found = {r["flight_num"]: r["flight_status"] for r in read_tables(spark, f"{root}/tables", snapshots={"flight": f"{root}/flight_v2"}).flight.collect()}
    assert found == {"1": "upcoming", "2": "upcoming", "10": "delayed", "99": "upcoming"}


def test_a_killed_booking_batch_is_not_seen(spark, monkeypatch):
    root = world(spark)
    day = ts("2001-07-01 10:00:00")
    schema = "request_id long, ts timestamp_ntz, customer_email string, flight_num string"
    first, second = spark.createDataFrame([(1, day, "c1", "1"), (2, day, "c0", "1")], schema), spark.createDataFrame([(3, day, "c0", "2"), (4, day, "c1", "1")], schema)
    jobs.book(spark, f"{root}/tables", first, f"{root}/book", 0)
    before = state(spark, root, bookings=f"{root}/book")
    assert before["ticket"] == ["Row(ticket_id='7', flight_num='1')", "Row(ticket_id='8', flight_num='1')"]
    monkeypatch.setattr(ledger, "commit", lambda *a, **kw: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        jobs.book(spark, f"{root}/tables", second, f"{root}/book", 1)
    monkeypatch.undo()
    assert state(spark, root, bookings=f"{root}/book") == before
    jobs.book(spark, f"{root}/tables", second, f"{root}/book", 1)
    after = state(spark, root, bookings=f"{root}/book")
    assert after["ticket"] == [*before["ticket"], "Row(ticket_id='9', flight_num='2')"]
    assert ledger.committed(spark, f"{root}/book")[1]["last_id"] == "9"
    with pytest.raises(ValueError, match="not after the last one"):
        jobs.book(spark, f"{root}/tables", second, f"{root}/book", 1)


def test_bookings_keep_state_instead_of_searching_the_history(spark, monkeypatch):
    """Later batches read the state of the flights they ask for, of the version their predecessor committed."""
    from flightmart.sources import bucketed, tables
    from flightmart.streaming import bookings
    root = world(spark)
    schema = "request_id long, ts timestamp_ntz, customer_email string, flight_num string"
    start = ts("2001-07-01 10:00:00")
    batches = [[("c1", "1"), ("c0", "2")], [("c1", "1"), ("c1", "2")], [("c2", "2"), ("c2", "1")], [("c3", "1"), ("c0", "1")]]
    # sequentially: flight 1 has 3 seats and c0 holds one; flight 2 has 2
    seats, sold, held, expected = {"1": 3, "2": 2}, {"1": 1, "2": 0}, {("c0", "1")}, {}
    for k, (c, f) in enumerate(x for b in batches for x in b):
        full = sold[f] >= seats[f]
        expected[k] = 3 if full else 2 if (c, f) in held else 1
        if expected[k] == 1:
            sold[f] += 1
            held.add((c, f))
    reads = []
    real = bucketed.read_for
    monkeypatch.setattr(bookings.bucketed, "read_for", lambda *a, **kw: reads.append(real(*a, **kw)) or reads[-1])
    request = 0
    for n, pairs in enumerate(batches):
        rows = [(request + i, start, c, f) for i, (c, f) in enumerate(pairs)]
        request += len(rows)
        if n:  # the rows of earlier batches are not read any more
            monkeypatch.setattr(tables, "batch_rows", lambda *a, **kw: pytest.fail("the history was read"))
        if n == 2:  # killed after its state was written, before its commit
            commit = ledger.commit
            monkeypatch.setattr(ledger, "commit", lambda *a, **kw: (_ for _ in ()).throw(Killed()))
            with pytest.raises(Killed):
                jobs.book(spark, f"{root}/tables", spark.createDataFrame(rows, schema), f"{root}/book", n)
            monkeypatch.setattr(ledger, "commit", commit)
        jobs.book(spark, f"{root}/tables", spark.createDataFrame(rows, schema), f"{root}/book", n)
    got = {r["request_id"]: r["status"] for r in bookings.read_outcomes(spark, f"{root}/book").collect()}
    assert got == expected
    assert {r["flight_num"]: r["sold"] for r in bucketed.read(spark, f"{root}/book/state/sold", bookings.SOLD).collect()} == {f: n for f, n in sold.items()}
    assert {tuple(r) for r in bucketed.read(spark, f"{root}/book/state/held", bookings.HELD).collect()} == held
    assert all(len(touched) <= 2 for _, touched in reads)  # two flights are asked for
