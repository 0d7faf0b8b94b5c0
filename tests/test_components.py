"""Connected components, and chains of conflicting registrations."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from flightmart.functions import components
from flightmart.operators import maintain as mt
from flightmart.plans import jobs
from tests.conftest import make_tables, ts
from tests.test_jobs import _sequential_registrations

REGS = "request_id long, ts timestamp_ntz, kind string, key string, name string, airline_name string, b_id string"


def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_the_plain_ones(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:03d}" for i in range(120)]
    rnd.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(50)] + [(rnd.choice(names[60:]), rnd.choice(names[60:])) for _ in range(40)] + [("n000", "n000")]
    got = components.connected(spark.createDataFrame(links, "a string, b string"))
    assert {r["node"]: r["label"] for r in got.collect()} == plain_components(links)
    assert components.connected(spark.createDataFrame([], "a string, b string")).isEmpty()


def outcomes(spark, rows):
    t = make_tables(spark, airline=[("A",)], booking_agent=[("a0", "b0", "A")], airline_staff=[("s0", "A", "f", "l", dt.date(1970, 1, 1))])
    found = jobs.registration_outcomes(spark, spark.createDataFrame(rows, REGS), t.customer, t.booking_agent, t.airline_staff, t.airline)
    return {r["request_id"]: r["outcome"] for r in found.collect()}


def sequential(rows):
    return _sequential_registrations(rows, [], ["a0"], ["b0"], ["s0"], {"A"})


def chain(n):
    """Agents that share by turns an email and a b_id with the one before."""
    start = ts("2001-07-01 00:00:00")
    return [(i, start + dt.timedelta(seconds=i), "agent", f"k{(i + 1) // 2}", "x", "A", f"b{i // 2 + 1}") for i in range(n)]


def test_a_long_chain_settles_in_few_rounds(spark, monkeypatch):
    rounds, spreads = [], []
    one_round, checkpoint = mt.registration_round, components.DataFrame.checkpoint
    monkeypatch.setattr(mt, "registration_round", lambda s: rounds.append(1) or one_round(s))
    monkeypatch.setattr(components.DataFrame, "checkpoint", lambda self, *a, **kw: spreads.append(1) or checkpoint(self, *a, **kw))
    rows = chain(10_000)
    assert outcomes(spark, rows) == sequential(rows)
    assert len(rounds) <= jobs.FIRST_ROUNDS and len(spreads) < 4 * 14 + 10  # log2(10,000) is 14


def test_components_too_large_for_a_task_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FOLD_RECORDS", 6)
    rows = chain(11)
    late = ts("2001-07-02 00:00:00")
    rows += [(100 + i, late + dt.timedelta(seconds=i), "agent", f"z{i // 2}", "x", "A", f"y{(i + 1) // 2}") for i in range(5)]
    rows += [(200, late, "agent", "nobid", "x", "A", None), (201, late, "agent", "nobid2", "x", "A", None), (202, late, "staff", "s0", "x", "A", None), (203, late, "customer", "c", "x", None, None)]
    assert outcomes(spark, rows) == {**sequential([r for r in rows if r[0] not in (200, 201)]), 200: "ok", 201: "ok"}


@pytest.mark.parametrize("first", [0, 1])
def test_components_give_the_sequential_outcomes(spark, first, monkeypatch):
    """Dense conflicts, settled mostly or all by components."""
    monkeypatch.setattr(jobs, "FIRST_ROUNDS", first)
    rnd = random.Random(first)
    start = ts("2001-07-01 00:00:00")
    rows = [(i, start + dt.timedelta(seconds=rnd.randint(0, 40)), kind, f"{kind[0]}{rnd.randint(0, 25)}", "x", rnd.choice(["A", "A", "A", "Z"]), f"b{rnd.randint(0, 20)}" if kind == "agent" else None)
            for i, kind in enumerate(rnd.choice(["agent", "agent", "staff", "customer"]) for _ in range(150))]
    assert outcomes(spark, rows) == sequential(rows)
