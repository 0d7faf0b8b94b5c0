"""The sales mart kept up to date equals a rebuild, and leaves untouched months alone."""

from __future__ import annotations

import datetime as dt
import glob
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from flightmart.operators.facts import SALES_COLUMNS, sales_fact
from flightmart.plans import mart
from flightmart.sources import fixtures
from tests.conftest import SF_SMALL, flight_row, make_tables


def files(path):
    return {f: f.split("bucket=")[1].split("/")[0] for f in glob.glob(f"{path}/versions/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(repr, df.select(*SALES_COLUMNS).collect()))


def test_updates_equal_a_rebuild(spark):
    flights = [flight_row(n, "A" if n % 2 else "B") for n in range(6)]
    sold = [(str(i), f"c{i % 7}", "a1" if i % 3 else None, dt.date(2000, 1 + i % 9, 1 + i % 20), str(i % 6)) for i in range(120)]
    sold.append(("900", "c1", None, None, "1"))  # a purchase without a date
    t = make_tables(spark, flight=flights, ticket=[(i, f) for i, _, _, _, f in sold], purchases=[x[:4] for x in sold])
    path = tempfile.mkdtemp(prefix="flightmart-mart-")
    mart.start_mart(t.purchases, t.ticket, t.flight, path)
    assert rows(mart.read_mart(spark, path)) == rows(sales_fact(t.purchases, t.ticket, t.flight))
    old = files(path)

    # a booking batch, of an old month, a new month, and a flight added with it
    new = [("1000", "c9", None, dt.date(2000, 3, 3), "2"), ("1001", "c9", "a1", dt.date(2001, 2, 2), "50")]
    more = make_tables(spark, flight=[flight_row(50)], ticket=[(i, f) for i, _, _, _, f in new], purchases=[x[:4] for x in new])
    flight = t.flight.unionByName(more.flight)
    touched = mart.update_mart(spark, path, more.purchases, more.ticket, flight, more.flight)
    assert touched == {2000 * 12 + 2, 2001 * 12 + 1}
    purchases, ticket = t.purchases.unionByName(more.purchases), t.ticket.unionByName(more.ticket)
    assert rows(mart.read_mart(spark, path)) == rows(sales_fact(purchases, ticket, flight))
    assert old.items() <= files(path).items() and {b for f, b in files(path).items() if f not in old} == {str(b) for b in touched}

    # a status batch and a new price of one flight, sold in some of the months
    changed = flight.withColumn("flight_status", F.when(F.col("flight_num") == "4", F.lit("delayed")).otherwise(F.col("flight_status"))) \
        .withColumn("price", F.when(F.col("flight_num") == "4", F.lit(Decimal("7.00"))).otherwise(F.col("price")).cast("decimal(10,2)"))
    before = files(path)
    touched = mart.update_mart(spark, path, more.purchases.limit(0), more.ticket.limit(0), changed, changed.filter("flight_num = '4'"))
    months = {r["p_date"].year * 12 + r["p_date"].month - 1 for r in sales_fact(purchases, ticket, flight).filter("flight_num = '4'").collect()}
    assert touched == months and len(months) < 9
    assert rows(mart.read_mart(spark, path)) == rows(sales_fact(purchases, ticket, changed))
    assert before.items() <= files(path).items() and {b for f, b in files(path).items() if f not in before} == {str(b) for b in touched}

    # nothing changed: nothing is written
    assert mart.update_mart(spark, path, more.purchases.limit(0), more.ticket.limit(0), changed, changed.limit(0)) == set()
    window = mart.read_mart(spark, path, dt.date(2000, 2, 1), dt.date(2000, 3, 31))
    assert {r["p_date"].month for r in window.collect()} == {2, 3}


def test_held_rows_are_joined_once(spark, monkeypatch):
    """A status batch reads the months it touches once for their new rows."""
    t = fixtures.load(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="flightmart-mart-")
    mart.start_mart(t.purchases, t.ticket, t.flight, path)
    plans, replace = [], mart.bucketed.replace

    def kept(spark_, path_, rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        replace(spark_, path_, rows, *rest)

    monkeypatch.setattr(mart.bucketed, "replace", kept)
    mart.update_mart(spark, path, t.purchases.limit(0), t.ticket.limit(0), t.flight, t.flight.filter("CAST(flight_num AS INT) % 3 = 0"))
    assert sum("Relation" in line and "bucket#" in line for line in plans[0].splitlines()) == 1
    assert sorted(map(str, mart.read_mart(spark, path).collect())) == sorted(map(str, sales_fact(t.purchases, t.ticket, t.flight).collect()))


def test_many_flights_are_cut_into_parts(spark, monkeypatch):
    """Sales are moved to their flights once; a batch brings a part's changed flights to the files of that part."""
    monkeypatch.setattr(mart, "FLIGHTS", 10)
    flights = [flight_row(n, "A" if n % 2 else "B") for n in range(40)]
    flights.append(flight_row(7, "C"))  # a number that comes twice
    sold = [(str(i), f"c{i % 7}", "a1" if i % 3 else None, dt.date(2000, 1 + i % 4, 1 + i % 20), str(i % 40)) for i in range(400)]
    sold += [(str(900 + i), "c1", None, None, str(i)) for i in range(40)]  # purchases without a date
    sold.append(("990", "c1", None, dt.date(2000, 9, 9), None))  # and one without a flight
    t = make_tables(spark, flight=flights, ticket=[(i, f) for i, _, _, _, f in sold], purchases=[x[:4] for x in sold])
    path = tempfile.mkdtemp(prefix="flightmart-mart-")
    written, write = [], mart.bucketed._write_version

    def kept(rows, path, version, gather=True, mode="overwrite"):
        written.append((rows._jdf.queryExecution().executedPlan().toString(), gather, mode))
        write(rows, path, version, gather, mode)

    monkeypatch.setattr(mart.bucketed, "_write_version", kept)
    mart.start_mart(t.purchases, t.ticket, t.flight, path)
    assert rows(mart.read_mart(spark, path)) == rows(sales_fact(t.purchases, t.ticket, t.flight))
    month_and_parts = {mart._month_and_parts(int(b)) for b in files(path).values()}
    assert month_and_parts == {(m, 8) for m in (-1, *range(24000, 24004))}
    assert [g for _, g, _ in written] == [False] and len(files(path)) == len(set(files(path).values()))  # a task holds one part
    old = files(path)

    new = [("1000", "c9", None, dt.date(2000, 3, 3), "2"), ("1001", "c9", "a1", dt.date(2001, 2, 2), "50")]
    more = make_tables(spark, flight=[flight_row(50)], ticket=[(i, f) for i, _, _, _, f in new], purchases=[x[:4] for x in new])
    flight = t.flight.unionByName(more.flight)
    assert mart.update_mart(spark, path, more.purchases, more.ticket, flight, more.flight) == {24002, 24013}
    purchases, ticket = t.purchases.unionByName(more.purchases), t.ticket.unionByName(more.ticket)
    assert rows(mart.read_mart(spark, path)) == rows(sales_fact(purchases, ticket, flight))
    assert old.items() <= files(path).items() and {mart._month_and_parts(int(b))[0] for f, b in files(path).items() if f not in old} == {24002, 24013}

    # flights of several parts change; one is no longer there, so its sales stay what they were
    new_status = F.when(F.col("flight_num").isin("1", "2", "3", "4", "50"), F.lit("delayed")).otherwise(F.col("flight_status"))
    changed, written[:] = flight.withColumn("flight_status", new_status).filter("flight_num <> '9'"), []
    before, wanted = files(path), rows(sales_fact(purchases, ticket, flight.withColumn("flight_status", new_status)))
    assert mart.update_mart(spark, path, more.purchases.limit(0), more.ticket.limit(0), changed, changed.filter("flight_num IN ('1', '2', '3', '4', '9', '50')")) == {-1, 24000, 24001, 24002, 24003, 24013}
    assert rows(mart.read_mart(spark, path)) == wanted and before.items() <= files(path).items()
    assert len(written) == 8 and [mode for _, _, mode in written] == ["overwrite"] + ["append"] * 7
    for p, gather, _ in written:  # the rows that are held are not shuffled, but written where they are read
        assert not gather and "hashpartitioning" not in p and "Rebalance" not in p, p
    march = mart.read_mart(spark, path, dt.date(2000, 2, 1), dt.date(2000, 3, 31))
    assert {r["p_date"].month for r in march.collect()} == {2, 3}


def test_bookings_find_sold_pairs_in_the_mart(spark):
    """Pairs already sold are read from the mart, where purchases and tickets are joined; the batch is the same."""
    from flightmart.plans import catalog
    plain = catalog._booking_rows(spark, SF_SMALL)
    t = fixtures.load(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="flightmart-mart-")
    mart.start_mart(t.purchases, t.ticket, t.flight, path)
    for a, b in zip(plain, catalog._booking_rows(spark, SF_SMALL, mart.read_mart(spark, path)), strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
