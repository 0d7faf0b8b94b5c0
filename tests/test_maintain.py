"""Maintenance jobs (O35-O42) and the integrity audit (O41) on micro tables."""

from __future__ import annotations

import datetime as dt

from flightmart.operators import maintain as mt
from flightmart.operators import quality as qa
from tests.conftest import flight_row, make_tables, ts

CHANGE_SCHEMA = "request_id long, ts timestamp_ntz, airline_name string, flight_num string, flight_status string"


def test_status_changes_unchanged_and_latest_wins(spark):
    t = make_tables(spark, flight=[flight_row("F", airline="A", status="upcoming"), flight_row("G", airline="A")])
    changes = spark.createDataFrame([
        (1, ts("2024-01-01 10:00:00"), "A", "F", "delayed"),
        (2, ts("2024-01-01 11:30:00"), "A", "F", "delayed"),      # same as now -> unchanged
        (3, ts("2024-01-02 09:00:00"), "A", "F", "upcoming"),
        (4, ts("2024-01-02 09:30:00"), "B", "F", "in-progress"),  # other airline's flight
        (5, ts("2024-01-03 08:00:00"), "A", "F", "delay"),        # creation spelling -> delayed
        (6, ts("2024-01-03 08:00:00"), "A", "F", "boarding"),     # not a status
        (7, ts("2024-01-03 09:00:00"), "A", "G", "upcoming"),     # equal to the base status
    ], CHANGE_SCHEMA)
    for unit in (["hour"], ["day"], ["month"], ["month", "day", "hour"]):
        got = {r.request_id: r.outcome for r in mt.flight_status_outcomes(changes, t.flight, chunk_units=unit).collect()}
        assert got == {1: "updated", 2: "unchanged", 3: "updated", 4: "unknown_flight", 5: "updated",
                       6: "bad_status", 7: "unchanged"}
    snap = {r.flight_num: r.flight_status for r in mt.apply_flight_status(changes, t.flight).collect()}
    assert snap == {"F": "delayed", "G": "upcoming"}


def test_status_change_requires_operator_of_the_airline(spark):
    t = make_tables(spark, flight=[flight_row("F", airline="A")],
                    airline_staff=[("op", "A", "f", "l", dt.date(1970, 1, 1)),
                                   ("adm", "A", "f", "l", dt.date(1970, 1, 1)),
                                   ("opb", "B", "f", "l", dt.date(1970, 1, 1))],
                    permission=[("op", "Operator"), ("adm", "Admin"), ("opb", "Operator")])
    changes = spark.createDataFrame([
        (1, ts("2024-01-01 10:00:00"), "A", "F", "delayed", "op"),
        (2, ts("2024-01-01 11:00:00"), "A", "F", "delayed", "adm"),
        (3, ts("2024-01-01 12:00:00"), "A", "F", "delayed", "opb"),
    ], CHANGE_SCHEMA + ", requester string")
    got = {r.request_id: r.outcome for r in mt.flight_status_outcomes(
        changes, t.flight, t.permission, t.airline_staff).collect()}
    assert got == {1: "updated", 2: "not_permitted", 3: "not_permitted"}


def test_new_flights_first_valid_wins(spark):
    t = make_tables(spark, flight=[flight_row("OLD")], airplane=[("A", "P1", 10)], airport=[("X", "c"), ("Y", "c")])
    cols = ("request_id long, ts timestamp_ntz, flight_num string, airline_name string, airplane_id string, "
            "depart_name string, arrive_name string, depart_time timestamp_ntz, arrive_time timestamp_ntz, "
            "price decimal(10,2), flight_status string")
    dep, arr = ts("2002-01-01 10:00:00"), ts("2002-01-01 12:00:00")
    from decimal import Decimal
    one = Decimal("1.00")
    reqs = spark.createDataFrame([
        (1, ts("2024-01-01 00:00:00"), "OLD", "A", "P1", "X", "Y", dep, arr, one, "upcoming"),
        (2, ts("2024-01-01 00:00:01"), "N1", "A", "P1", "X", "X", dep, arr, one, "upcoming"),   # same airport
        (3, ts("2024-01-01 00:00:02"), "N1", "A", "P1", "X", "Y", arr, dep, one, "upcoming"),   # bad time
        (4, ts("2024-01-01 00:00:03"), "N1", "A", "P1", "X", "Y", dep, arr, one, "delay"),      # accepted
        (5, ts("2024-01-01 00:00:04"), "N1", "A", "P1", "X", "X", dep, arr, one, "upcoming"),   # number now taken, but the airports are checked first
        (8, ts("2024-01-01 00:00:07"), "N1", "B", "P1", "X", "Q", dep, arr, one, "upcoming"),   # number now taken
        (6, ts("2024-01-01 00:00:05"), "N2", "B", "P1", "X", "Y", dep, arr, one, "upcoming"),   # plane not B's
        (7, ts("2024-01-01 00:00:06"), "N3", "A", "P1", "X", "Q", dep, arr, one, "upcoming"),   # unknown airport
    ], cols)
    out = mt.load_new_flights(reqs, t.flight, t.airplane, t.airport)
    got = {r.request_id: r.outcome for r in out.collect()}
    assert got == {1: "existing_flight_num", 2: "same_airport", 3: "bad_time", 4: "ok",
                   5: "same_airport", 6: "airplane_not_owned", 7: "unknown_airport", 8: "existing_flight_num"}
    rows = mt.new_flight_rows(reqs, out).collect()
    assert [(r.flight_num, r.flight_status) for r in rows] == [("N1", "delayed")]


def test_new_airplanes_integer_ids(spark):
    t = make_tables(spark, airplane=[("A", "7", 10)])
    reqs = spark.createDataFrame([(1, "A", "007", "5"), (2, "A", "x1", "5"), (3, "A", "8", "five"),
                                  (4, "A", "8", "5"), (5, "A", "08", "9")],
                                 "request_id long, airline_name string, airplane_id string, seats string")
    out = mt.load_new_airplanes(reqs, t.airplane)
    got = {r.request_id: r.outcome for r in out.collect()}
    assert got == {1: "existing_id", 2: "not_an_integer", 3: "not_an_integer", 4: "ok", 5: "existing_id"}
    assert [(r.id, r.seats) for r in mt.new_airplane_rows(reqs, out).collect()] == [("8", 5)]


def test_new_airports_upper_case(spark):
    t = make_tables(spark, airport=[("JFK", "NEW YORK")])
    reqs = spark.createDataFrame([(1, "jfk", "new york"), (2, "pvg", "shanghai"), (3, "PVG", "Shanghai")],
                                 "request_id long, name string, city string")
    got = {r.request_id: (r.name, r.city, r.outcome) for r in mt.load_new_airports(reqs, t.airport).collect()}
    assert got == {1: ("JFK", "NEW YORK", "existing"), 2: ("PVG", "SHANGHAI", "ok"), 3: ("PVG", "SHANGHAI", "existing")}


def test_permission_grants_drop_placeholder(spark):
    staff = [(u, "A", "f", "l", dt.date(1970, 1, 1)) for u in ("s1", "s2", "s3")]
    t = make_tables(spark, airline_staff=staff, permission=[("s1", ""), ("s2", "Admin"), ("s3", "")])
    grants = spark.createDataFrame([(1, "s1", "Admin"), (2, "s1", "Admin"), (3, "s2", "Admin"),
                                    (4, "s2", "Operator"), (5, "ghost", "Admin"), (6, "s3", "Root")],
                                   "request_id long, username string, permission string")
    got = {r.request_id: r.outcome for r in mt.permission_grant_outcomes(grants, t.permission, t.airline_staff).collect()}
    assert got == {1: "ok", 2: "already_granted", 3: "already_granted", 4: "ok", 5: "unknown_user",
                   6: "bad_permission"}
    snap = sorted((r.username, r.permission) for r in mt.apply_permission_grants(
        grants, t.permission, t.airline_staff).collect())
    assert snap == [("s1", "Admin"), ("s2", "Admin"), ("s2", "Operator"), ("s3", "")]


def test_agent_moves(spark):
    t = make_tables(spark, airline=[("A",), ("B",)], booking_agent=[("ag", "1", "A"), ("bg", "2", "B")])
    moves = spark.createDataFrame([(1, "ag", "A"), (2, "ag", "B"), (3, "ag", "B"), (4, "ghost", "A"),
                                   (5, "bg", "Z"), (6, "ag", "A")],
                                  "request_id long, email string, airline_name string")
    got = {r.request_id: r.outcome for r in mt.agent_move_outcomes(moves, t.booking_agent, t.airline).collect()}
    assert got == {1: "unchanged", 2: "updated", 3: "unchanged", 4: "unknown_agent", 5: "unknown_airline",
                   6: "updated"}
    snap = {r.email: r.airline_name for r in mt.assign_agents_to_airline(moves, t.booking_agent, t.airline).collect()}
    assert snap == {"ag": "A", "bg": "B"}


def test_registrations(spark):
    from tests.test_reports import cust
    t = make_tables(spark, airline=[("A",)], customer=[cust("c@x")], booking_agent=[("ag@x", "7", "A")],
                    airline_staff=[("st", "A", "f", "l", dt.date(1970, 1, 1))])
    regs = spark.createDataFrame([
        (1, ts("2024-01-01 00:00:00"), "customer", "c@x", "c", None, None),
        (2, ts("2024-01-01 00:00:01"), "customer", "new@x", "n", None, None),
        (3, ts("2024-01-01 00:00:02"), "customer", "new@x", "n", None, None),
        (4, ts("2024-01-01 00:00:03"), "agent", "ag@x", "a", "Z", "7"),   # all three wrong: email shown
        (5, ts("2024-01-01 00:00:04"), "agent", "ag@x", "a", "Z", "8"),   # email shown
        (6, ts("2024-01-01 00:00:05"), "agent", "a2@x", "a", "A", "9"),
        (7, ts("2024-01-01 00:00:06"), "agent", "a3@x", "a", "A", "9"),   # b_id taken in the batch
        (8, ts("2024-01-01 00:00:07"), "staff", "st", "s", "A", None),
        (9, ts("2024-01-01 00:00:08"), "staff", "st2", "s", "Z", None),
        (10, ts("2024-01-01 00:00:09"), "staff", "st3", "s", "A", None),
        (11, ts("2024-01-01 00:00:10"), "staff", "st", "s", "Z", None),   # both: unknown airline shown for staff
        (12, ts("2024-01-01 00:00:11"), "agent", "a4@x", "a", "Z", "7"),   # airline before b_id
    ], "request_id long, ts timestamp_ntz, kind string, key string, name string, airline_name string, b_id string")
    from flightmart.plans import jobs
    out = jobs.registration_outcomes(spark, regs, t.customer, t.booking_agent, t.airline_staff, t.airline)
    got = {r.request_id: r.outcome for r in out.collect()}
    assert got == {1: "existing", 2: "ok", 3: "existing", 4: "existing", 5: "existing", 6: "ok", 7: "existing_b_id",
                   8: "existing", 9: "unknown_airline", 10: "ok", 11: "unknown_airline", 12: "unknown_airline"}
    rows = mt.registration_rows(regs, out)
    assert [r.username for r in rows["permission"].collect()] == ["st3"]
    assert rows["permission"].collect()[0].permission == ""


def test_integrity_audit(spark):
    from pyspark.sql import types as T
    from flightmart.sources.schemas import AIRLINE_STAFF
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in AIRLINE_STAFF.fields])
    staff = spark.createDataFrame([(None, "A", "f", "l", dt.date(1970, 1, 1)),
                                   ("a-very-long-user-name-here", "A", "f", "l", dt.date(1970, 1, 1))], nullable)
    t = make_tables(spark,
                    airline=[("A",), ("A",)],
                    flight=[flight_row("F", airline="A", plane="P9", dep="X", arr="Y")],
                    airport=[("X", "c")],
                    airplane=[("A", "P1", 3)],
                    ticket=[("1", "F"), ("2", "NOPE")],
                    purchases=[("1", "c", None, dt.date(2001, 1, 1)), ("1", "c", None, dt.date(2001, 1, 1))],
                    airline_staff=staff)
    got = {(r.rule, r.table_name, r.key): r.n for r in qa.integrity_audit(t).collect()}
    assert got[("pk", "airline", "A")] == 2
    assert got[("fk", "flight.airplane_id", "P9")] == 1
    assert got[("fk", "flight.arrive_name", "Y")] == 1
    assert got[("fk", "ticket.flight_num", "NOPE")] == 1
    assert got[("fk", "purchases.customer_email", "c")] == 2
    assert got[("not_null", "airline_staff.username", None)] == 1
    assert got[("length", "airline_staff.username", "a-very-long-user-name-here")] == 1
    assert ("fk", "purchases.booking_agent_email", None) not in got


def test_previous_value_carries_across_chunks(spark):
    from pyspark.sql import functions as F

    from flightmart.functions.ordering import id_chunk, previous_value, running_before
    rows = [(1, "k", "a"), (2, "k", "b"), (7, "k", "c"), (8, "j", "x"), (9, "k", "d"), (12, "j", "y")]
    df = spark.createDataFrame(rows, "request_id long, key string, v string")
    for sizes in ([], [3], [6, 3], [100, 4, 2]):
        out = previous_value(df, ["key"], "v", ["request_id"], [id_chunk("request_id", n) for n in sizes], "prev")
        got = {r.request_id: r.prev for r in out.collect()}
        assert got == {1: None, 2: "a", 7: "b", 9: "c", 8: None, 12: "x"}
    assert out.filter(F.col("prev").isNull()).count() == 2
    for sizes in ([], [3], [6, 3]):
        out = running_before(df, ["key"], "request_id", ["request_id"], [id_chunk("request_id", n) for n in sizes], "before")
        assert {r.request_id: r.before for r in out.collect()} == {1: 0, 2: 1, 7: 3, 9: 10, 8: 0, 12: 8}



def test_admin_requester_checks(spark):
    staff = [("adm", "A", "f", "l", dt.date(1970, 1, 1)), ("op", "A", "f", "l", dt.date(1970, 1, 1)),
             ("admb", "B", "f", "l", dt.date(1970, 1, 1)), ("new", "A", "f", "l", dt.date(1970, 1, 1))]
    t = make_tables(spark, airline=[("A",), ("B",)], airline_staff=staff,
                    permission=[("adm", "Admin"), ("op", "Operator"), ("admb", "Admin"), ("new", "")],
                    booking_agent=[("ag", "1", "B")], airport=[("JFK", "NY")])
    # Any Admin may add airports
    reqs = spark.createDataFrame([(1, "pvg", "sh", "op"), (2, "pvg", "sh", "admb"), (3, "jfk", "ny", "adm")],
                                 "request_id long, name string, city string, requester string")
    got = {r.request_id: r.outcome for r in mt.load_new_airports(reqs, t.airport, t.permission,
                                                                t.airline_staff).collect()}
    assert got == {1: "not_permitted", 2: "ok", 3: "existing"}
    # Only an Admin of the grantee's airline may grant
    grants = spark.createDataFrame([(1, "new", "Operator", "admb"), (2, "new", "Operator", "op"),
                                    (3, "new", "Operator", "adm")],
                                   "request_id long, username string, permission string, requester string")
    got = {r.request_id: r.outcome for r in mt.permission_grant_outcomes(grants, t.permission,
                                                                        t.airline_staff).collect()}
    assert got == {1: "not_permitted", 2: "not_permitted", 3: "ok"}
    # Only an Admin of the target airline may move an agent there
    moves = spark.createDataFrame([(1, "ag", "A", "admb"), (2, "ag", "A", "adm")],
                                  "request_id long, email string, airline_name string, requester string")
    got = {r.request_id: r.outcome for r in mt.agent_move_outcomes(moves, t.booking_agent, t.airline, t.permission,
                                                                  t.airline_staff).collect()}
    assert got == {1: "not_permitted", 2: "updated"}


def _seq_airplanes(reqs, existing):
    ids, out = set(existing), {}
    for rid, _, raw_id, seats in sorted(reqs):
        try:
            norm, _ = str(int(raw_id)), int(seats)
        except ValueError:
            out[rid] = "not_an_integer"
            continue
        if norm in ids:
            out[rid] = "existing_id"
        else:
            out[rid] = "ok"
            ids.add(norm)
    return out


def _seq_grants(reqs, staff, held):
    held, out = set(held), {}
    for rid, user, perm in sorted(reqs):
        if user not in staff:
            out[rid] = "unknown_user"
        elif perm not in ("Admin", "Operator"):
            out[rid] = "bad_permission"
        elif (user, perm) in held:
            out[rid] = "already_granted"
        else:
            out[rid] = "ok"
            held.add((user, perm))
    return out


def test_loaders_equal_sequential_loops(spark):
    import random
    rnd = random.Random(11)
    existing = ["1", "2", "3"]
    t = make_tables(spark, airplane=[("A", i, 5) for i in existing])
    reqs = [(i, "A", rnd.choice(["1", "4", "04", "5", "x", "5.0", "6"]), rnd.choice(["10", "ten"]))
            for i in range(40)]
    df = spark.createDataFrame(reqs, "request_id long, airline_name string, airplane_id string, seats string")
    got = {r.request_id: r.outcome for r in mt.load_new_airplanes(df, t.airplane).collect()}
    assert got == _seq_airplanes(reqs, existing)

    staff = ["s1", "s2", "s3"]
    t = make_tables(spark, airline_staff=[(u, "A", "f", "l", dt.date(1970, 1, 1)) for u in staff],
                    permission=[("s1", "Admin"), ("s2", "")])
    reqs = [(i, rnd.choice(staff + ["zz"]), rnd.choice(["Admin", "Operator", "Root"])) for i in range(40)]
    df = spark.createDataFrame(reqs, "request_id long, username string, permission string")
    got = {r.request_id: r.outcome for r in mt.permission_grant_outcomes(df, t.permission, t.airline_staff).collect()}
    assert got == _seq_grants(reqs, set(staff), {("s1", "Admin"), ("s2", "")})


def test_previous_value_keeps_null_keys(spark):
    from flightmart.functions.ordering import id_chunk, previous_value
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "k", "c")], "request_id long, key string, v string")
    got = {r.request_id: r.prev for r in previous_value(df, ["key"], "v", ["request_id"], [id_chunk("request_id", 10)],
                                                        "prev").collect()}
    assert got == {1: None, 2: "a", 3: None}
