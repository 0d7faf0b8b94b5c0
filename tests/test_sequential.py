"""Batch maintenance jobs on the fixture data equal a plain one-at-a-time loop."""

from __future__ import annotations

from flightmart.operators import maintain as mt
from flightmart.sources import fixtures
from tests.conftest import SF_SMALL


def test_new_flights_airports_grants(spark):
    t = fixtures.load(spark, SF_SMALL)
    flights = {r.flight_num for r in t.flight.collect()}
    owned = {(r.id, r.airline_name) for r in t.airplane.collect()}
    airports = {r.name for r in t.airport.collect()}
    reqs = fixtures.new_flights(spark, SF_SMALL)
    exp = {}
    for r in sorted(reqs.collect(), key=lambda r: (r.ts, r.request_id)):
        if r.depart_name == r.arrive_name:
            o = "same_airport"
        elif r.arrive_time <= r.depart_time:
            o = "bad_time"
        elif r.flight_num in flights:
            o = "existing_flight_num"
        elif (r.airplane_id, r.airline_name) not in owned:
            o = "airplane_not_owned"
        elif r.depart_name not in airports or r.arrive_name not in airports:
            o = "unknown_airport"
        else:
            o = "ok"
            flights.add(r.flight_num)
        exp[r.request_id] = o
    assert {r.request_id: r.outcome for r in mt.load_new_flights(reqs, t.flight, t.airplane, t.airport).collect()} == exp

    names, exp = set(airports), {}
    ap = fixtures.new_airports(spark, SF_SMALL)
    for r in sorted(ap.collect(), key=lambda r: r.request_id):
        n = r.name.upper()
        exp[r.request_id] = "existing" if n in names else "ok"
        names.add(n)
    assert {r.request_id: r.outcome for r in mt.load_new_airports(ap, t.airport).collect()} == exp

    staff = {r.username for r in t.airline_staff.collect()}
    held = {(r.username, r.permission) for r in t.permission.collect()}
    gr, exp = fixtures.grants(spark, SF_SMALL), {}
    for r in sorted(gr.collect(), key=lambda r: r.request_id):
        if r.username not in staff:
            o = "unknown_user"
        elif r.permission not in ("Admin", "Operator"):
            o = "bad_permission"
        elif (r.username, r.permission) in held:
            o = "already_granted"
        else:
            o = "ok"
            held.add((r.username, r.permission))
        exp[r.request_id] = o
    got = mt.permission_grant_outcomes(gr, t.permission, t.airline_staff).collect()
    assert {r.request_id: r.outcome for r in got} == exp


def test_status_changes_and_agent_moves(spark):
    t = fixtures.load(spark, SF_SMALL)
    base = {r.flight_num: (r.airline_name, r.flight_status) for r in t.flight.collect()}
    ch = fixtures.status_changes(spark, SF_SMALL)
    cur, exp = {k: v[1] for k, v in base.items()}, {}
    for r in sorted(ch.collect(), key=lambda r: (r.ts, r.request_id)):
        st = {"delay": "delayed"}.get(r.flight_status, r.flight_status)
        if r.flight_num not in base or base[r.flight_num][0] != r.airline_name:
            exp[r.request_id] = "unknown_flight"
        elif st not in ("upcoming", "in-progress", "delayed"):
            exp[r.request_id] = "bad_status"
        else:
            exp[r.request_id] = "unchanged" if cur[r.flight_num] == st else "updated"
            cur[r.flight_num] = st
    assert {r.request_id: r.outcome for r in mt.flight_status_outcomes(ch, t.flight).collect()} == exp
    assert {r.flight_num: r.flight_status for r in mt.apply_flight_status(ch, t.flight).collect()} == cur

    agents = {r.email: r.airline_name for r in t.booking_agent.collect()}
    airlines = {r.name for r in t.airline.collect()}
    mv = fixtures.agent_moves(spark, SF_SMALL)
    cur, exp = dict(agents), {}
    for r in sorted(mv.collect(), key=lambda r: r.request_id):
        if r.email not in agents:
            exp[r.request_id] = "unknown_agent"
        elif r.airline_name not in airlines:
            exp[r.request_id] = "unknown_airline"
        else:
            exp[r.request_id] = "unchanged" if cur[r.email] == r.airline_name else "updated"
            cur[r.email] = r.airline_name
    assert {r.request_id: r.outcome for r in mt.agent_move_outcomes(mv, t.booking_agent, t.airline).collect()} == exp
    snap = mt.assign_agents_to_airline(mv, t.booking_agent, t.airline).collect()
    assert {r.email: r.airline_name for r in snap} == cur
