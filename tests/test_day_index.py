"""The cumulative day index against the reports that scan purchases."""

from __future__ import annotations

import datetime as dt
import random
import tempfile
from decimal import Decimal

import pytest

from flightmart.operators import agent as ag
from flightmart.operators import airline as al
from flightmart.operators.facts import sales_of
from flightmart.plans import day_index
from flightmart.sources import fixtures
from tests.conftest import SF_SMALL

AS_OF = fixtures.AS_OF


def span(days):
    return AS_OF - dt.timedelta(days=days), AS_OF


@pytest.fixture(scope="module")
def index(spark):
    sales = sales_of(fixtures.load(spark, SF_SMALL)).cache()
    paths = {}
    for key in ("airline_name", "booking_agent_email"):
        paths[key] = tempfile.mkdtemp(prefix="flightmart-index-")
        day_index.write_day_index(sales, key, paths[key])
    yield sales, paths
    sales.unpersist()


def test_reports_from_the_index(spark, index):
    sales, found = index
    t = fixtures.load(spark, SF_SMALL)
    rows = {(r["key"], (r["window_end"] - r["window_start"]).days): r for r in day_index.windows(spark, found["airline_name"], [span(30), span(31), span(365)]).collect()}
    for r in al.airline_ticket_counts(sales, t.airline, AS_OF).collect():
        assert (r["tickets_31d"], r["tickets_365d"]) == (rows[r["airline_name"], 31]["tickets"], rows[r["airline_name"], 365]["tickets"])
    for r in al.airline_revenue_split(sales, AS_OF).collect():
        got = rows[r["airline_name"], r["window_days"]]
        assert (r["revenue_direct"] or 0, r["revenue_agent"] or 0) == (got["revenue_direct"], got["revenue_agent"])
    agents = {r["key"]: r for r in day_index.windows(spark, found["booking_agent_email"], [span(30)]).collect()}
    for r in ag.agent_commission(sales, t.booking_agent, AS_OF).collect():
        got = agents.get(r["booking_agent_email"])
        assert (r["commission"], r["tickets"]) == ((got["revenue_agent"], got["tickets"]) if got else (0, 0))


def test_months_from_the_index(spark, index):
    sales, found = index
    t = fixtures.load(spark, SF_SMALL)
    months = al.airline_monthly_tickets_12m(sales, t.airline, AS_OF).collect()
    starts = sorted({r["month_start"] for r in months})
    spans = [(m, min(AS_OF, (m + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1))) for m in starts]
    got = {(r["key"], r["window_start"]): r["tickets"] for r in day_index.windows(spark, found["airline_name"], spans).collect()}
    assert {(r["airline_name"], r["month_start"]): r["tickets"] for r in months} == got


def test_a_window_reads_two_months(spark, index):
    used = day_index.windows(spark, index[1]["airline_name"], [(dt.date(1996, 5, 5), dt.date(2001, 3, 3))])
    plan = used._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "p_month" in filters and "lineitem" not in plan
    assert "(1996-05-01,2001-03-01)" in filters


def test_windows_equal_plain_sums(spark):
    rnd = random.Random(3)
    day = dt.date(1999, 11, 20)
    sales = [(rnd.choice(["A", "B", None]), rnd.choice([None, "a1"]), day + dt.timedelta(days=rnd.choice([0, 1, 11, 12, 40, 41, 400, 800])), Decimal(rnd.randint(-500, 5000)).scaleb(-2)) for _ in range(300)]
    sales += [("hot", None, day + dt.timedelta(days=i % 70), Decimal(1)) for i in range(2000)] + [("C", None, None, Decimal(5)), ("D", "a1", dt.date(2003, 1, 1), None)]
    df = spark.createDataFrame(sales, "airline_name string, booking_agent_email string, p_date date, price decimal(10,2)")
    path = tempfile.mkdtemp(prefix="flightmart-index-")
    day_index.write_day_index(df, "airline_name", path)
    points = [day + dt.timedelta(days=k) for k in (-30, -1, 0, 1, 11, 12, 39, 41, 70, 300, 1300)]
    spans = [(a, b) for a in points for b in points if a <= b]
    got = {(r["key"], r["window_start"], r["window_end"]): (r["tickets"], r["revenue_direct"], r["revenue_agent"]) for r in day_index.windows(spark, path, spans).collect()}
    for key in ("A", "B", "hot", "D"):
        for a, b in spans:
            mine = [s for s in sales if s[0] == key and s[2] and a <= s[2] <= b]
            assert got[key, a, b] == (len(mine), sum((s[3] or 0 for s in mine if s[1] is None), Decimal(0)), sum((s[3] or 0 for s in mine if s[1]), Decimal(0))), (key, a, b)
    assert {k for k, _, _ in got} == {"A", "B", "hot", "D"}


def test_sales_are_read_once(spark):
    """The joined sales are summed by day in one pass; all that follows reads the days."""
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    rows = [(f"k{i % 3}", None, dt.date(2000, 1, 1) + dt.timedelta(days=17 * i), Decimal(i)) for i in range(50)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "airline_name string, booking_agent_email string, p_date date, price decimal(10,2)")
    path = tempfile.mkdtemp(prefix="flightmart-index-")
    day_index.write_day_index(df, "airline_name", path)
    assert seen.value == len(rows)
    index = [tuple(r) for r in day_index.read_day_index(spark, path).select("key", "p_month", "p_date", "tickets").collect()]
    assert len(index) == len(set(index))
    months = {k: sorted({m for key, m, day, _ in index if key == k and day is None}) for k in ("k0", "k1", "k2")}
    for found in months.values():  # an opening row for each month, to the one after the last
        assert found[0] == dt.date(2000, 1, 1) or found[0] == dt.date(2000, 2, 1)
        assert found[-1] == dt.date(2002, 5, 1) and all((b - a).days in (28, 29, 30, 31) for a, b in zip(found, found[1:]))
