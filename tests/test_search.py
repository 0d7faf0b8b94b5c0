"""Search criteria (O04, O10) against a brute-force Python filter on the small fixture."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from flightmart.operators import airline as al
from flightmart.operators import search as se
from flightmart.sources import fixtures
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    t = fixtures.load(spark, SF_SMALL)
    flights = [r.asDict() for r in t.flight.collect()]
    city = {r.name: r.city for r in t.airport.collect()}
    return t, flights, city


def brute(flights, city, c, convention):
    def midnight(s):
        return dt.datetime.fromisoformat(s)
    out = set()
    for f in flights:
        ok = True
        if c.get("departure_date"):
            d0 = midnight(c["departure_date"])
            ok &= (d0 <= f["depart_time"] <= d0 + dt.timedelta(days=1)) if convention == "day" else f["depart_time"] >= d0
        if c.get("arrival_date"):
            d0 = midnight(c["arrival_date"])
            ok &= (d0 <= f["arrive_time"] <= d0 + dt.timedelta(days=1)) if convention == "day" else f["arrive_time"] <= d0
        if c.get("flight_num"):
            ok &= f["flight_num"] == c["flight_num"]
        if c.get("departure_airport"):
            ok &= f["depart_name"] == c["departure_airport"]
        if c.get("arrival_airport"):
            ok &= f["arrive_name"] == c["arrival_airport"]
        if c.get("departure_city"):
            ok &= city.get(f["depart_name"]) == c["departure_city"]
        if c.get("arrival_city"):
            ok &= city.get(f["arrive_name"]) == c["arrival_city"]
        if ok:
            out.add(f["flight_num"])
    return out


def random_criteria(rnd, flights, city):
    f = rnd.choice(flights)
    c = {}
    if rnd.random() < 0.4:
        c["departure_date"] = (f["depart_time"].date() - dt.timedelta(days=rnd.choice([0, 0, 1, 30]))).isoformat()
    if rnd.random() < 0.3:
        c["arrival_date"] = (f["arrive_time"].date() + dt.timedelta(days=rnd.choice([0, 1, 400]))).isoformat()
    if rnd.random() < 0.2:
        c["flight_num"] = f["flight_num"]
    if rnd.random() < 0.3:
        c["departure_airport"] = f["depart_name"]
    if rnd.random() < 0.3:
        c["arrival_airport"] = rnd.choice([f["arrive_name"], "NATION_3"])
    if rnd.random() < 0.4:
        c["departure_city"] = city[f["depart_name"]]
    if rnd.random() < 0.4:
        c["arrival_city"] = rnd.choice(sorted(set(city.values())))
    if rnd.random() < 0.2:
        c["flight_num"] = ""  # empty form field means "not given"
    return c


@pytest.mark.parametrize("seed", range(12))
def test_search_matches_brute_force(data, seed):
    t, flights, city = data
    rnd = random.Random(seed)
    c = random_criteria(rnd, flights, city)
    got = {r.flight_num for r in se.flight_search(t.flight, t.airport, c).collect()}
    assert got == brute(flights, city, c, "day"), c
    got = {r.flight_num for r in al.airline_flight_search(t.flight, t.airport, c).collect()}
    assert got == brute(flights, city, c, "bound"), c
