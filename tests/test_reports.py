"""Hand-made micro tables for the semantics decisions."""

from __future__ import annotations

from decimal import Decimal

import pytest

from flightmart.operators import agent as ag
from flightmart.operators import airline as al
from flightmart.operators import customer as cu
from flightmart.operators import search as se
from flightmart.operators.facts import sales_of
from tests.conftest import d, flight_row, make_tables, money


def cust(email):
    return (email, email, 1, "s", "c", "st", Decimal(1), "p", d("2030-01-01"), "pc", d("1980-01-01"))


def purchases_on(flight_num, rows):
    """rows: (ticket_id, customer, agent, p_date) all on one flight."""
    tickets = [(t, str(flight_num)) for t, *_ in rows]
    purchases = [(t, c, a, d(p)) for t, c, a, p in rows]
    return tickets, purchases


def test_six_month_calendar_months(spark):
    # as_of 2002-01-15: shown months Aug 2001 .. Jan 2002 (year end inside, Q1)
    tk, pu = purchases_on(1, [("1", "c", None, "2001-07-20"),   # before the first month: dropped
                              ("2", "c", None, "2001-08-01"),
                              ("3", "c", None, "2001-11-30"),
                              ("4", "c", None, "2002-01-15"),
                              ("5", "c", None, "2002-01-16")])  # after as_of: dropped
    t = make_tables(spark, flight=[flight_row(1, price="10.00")], ticket=tk, purchases=pu,
                    customer=[cust("c"), cust("z")])
    rows = cu.customer_monthly_spend_6m(sales_of(t), t.customer, d("2002-01-15")).collect()
    got = {(r.customer_email, r.month_start): r.spend for r in rows}
    assert len(got) == 12  # 6 months for both customers, zero filled
    assert got[("c", d("2001-08-01"))] == money(10)
    assert got[("c", d("2001-11-01"))] == money(10)
    assert got[("c", d("2002-01-01"))] == money(10)
    assert got[("c", d("2001-12-01"))] == money(0)
    assert all(v == 0 for (c, _), v in got.items() if c == "z")


def test_twelve_months_are_year_months(spark):
    # Q14: March 2001 must not be added to March 2002
    tk, pu = purchases_on(1, [("1", "c", None, "2001-03-15"), ("2", "c", None, "2002-03-01")])
    t = make_tables(spark, flight=[flight_row(1, airline="A")], ticket=tk, purchases=pu, airline=[("A",), ("B",)])
    rows = al.airline_monthly_tickets_12m(sales_of(t), t.airline, d("2002-03-10")).collect()
    got = {(r.airline_name, r.month_start): r.tickets for r in rows}
    assert len(got) == 24
    assert got[("A", d("2002-03-01"))] == 1
    assert got[("A", d("2001-04-01"))] == 0
    assert sum(v for (a, _), v in got.items() if a == "A") == 1


def test_range_ending_in_december_terminates(spark):
    # Q12: the reference's month loop never ends for a December end month in a later year
    tk, pu = purchases_on(1, [("1", "c", None, "2001-12-31")])
    t = make_tables(spark, flight=[flight_row(1, airline="A")], ticket=tk, purchases=pu, airline=[("A",)])
    rows = al.airline_monthly_tickets_range(sales_of(t), t.airline, d("2000-11-15"), d("2001-12-31"),
                                            d("2002-01-01")).collect()
    months = sorted(r.month_start for r in rows)
    assert months[0] == d("2000-11-01") and months[-1] == d("2001-12-01") and len(months) == 14
    assert {r.month_start: r.tickets for r in rows}[d("2001-12-01")] == 1  # O26 keeps the end date (Q2)


def test_spend_range_is_half_open(spark):
    # Q2: the customer range drops purchases on the end date
    tk, pu = purchases_on(1, [("1", "c", None, "2001-03-01"), ("2", "c", None, "2001-03-31")])
    t = make_tables(spark, flight=[flight_row(1, price="5.00")], ticket=tk, purchases=pu, customer=[cust("c")])
    rows = cu.customer_monthly_spend_range(sales_of(t), t.customer, d("2001-03-01"), d("2001-03-31"),
                                           d("2001-07-01")).collect()
    assert [(r.month_start, r.spend) for r in rows] == [(d("2001-03-01"), money(5))]


def test_range_checks(spark):
    t = make_tables(spark)
    with pytest.raises(ValueError):
        cu.customer_monthly_spend_range(sales_of(t), t.customer, d("2001-03-02"), d("2001-03-01"), d("2001-07-01"))
    with pytest.raises(ValueError):
        al.airline_monthly_tickets_range(sales_of(t), t.airline, d("2001-03-01"), d("2001-08-01"), d("2001-07-01"))


def test_day_search_includes_next_midnight(spark):
    # Q3: public search on day d matches d 00:00 .. (d+1) 00:00 inclusive
    flights = [flight_row(1, dep_t="2001-08-01 00:00:00", arr_t="2001-08-01 02:00:00"),
               flight_row(2, dep_t="2001-08-02 00:00:00", arr_t="2001-08-02 02:00:00"),
               flight_row(3, dep_t="2001-08-02 00:00:01", arr_t="2001-08-02 02:00:00")]
    t = make_tables(spark, flight=flights, airport=[("X", "C1"), ("Y", "C2")])
    got = {r.flight_num for r in se.flight_search(t.flight, t.airport, {"departure_date": "2001-08-01"}).collect()}
    assert got == {"1", "2"}
    assert se.flight_search(t.flight, t.airport, {}).count() == 3
    assert se.flight_search(t.flight, t.airport, {"departure_city": "C2"}).count() == 0
    assert se.flight_search(t.flight, t.airport, {"arrival_city": "C2", "flight_num": "3"}).count() == 1


def test_bound_search_end_date_is_midnight(spark):
    # Q3: an arrival date bound excludes flights arriving later on that day
    flights = [flight_row(1, dep_t="2001-08-01 10:00:00", arr_t="2001-08-02 00:00:00"),
               flight_row(2, dep_t="2001-08-01 10:00:00", arr_t="2001-08-02 01:00:00")]
    tk, pu = [("1", "1"), ("2", "2")], [("1", "c", None, d("2001-06-01")), ("2", "c", None, d("2001-06-01"))]
    t = make_tables(spark, flight=flights, ticket=tk, purchases=pu, airport=[("X", "C1"), ("Y", "C2")])
    got = {r.flight_num for r in cu.customer_upcoming_search(sales_of(t), t.airport,
                                                              {"arrival_date": "2001-08-02"}).collect()}
    assert got == {"1"}
    got = {r.flight_num for r in al.airline_flight_search(t.flight, t.airport, {"departure_date": "2001-08-01"},
                                                           airline="A").collect()}
    assert got == {"1", "2"}


def test_year_spend_counts_each_flight_once(spark):
    # Q4
    tk, pu = purchases_on(1, [("1", "c", None, "2001-06-01"), ("2", "c", None, "2001-06-02")])
    t = make_tables(spark, flight=[flight_row(1, price="50.00")], ticket=tk, purchases=pu,
                    customer=[cust("c"), cust("nobody")])
    got = {r.customer_email: r.year_spend for r in cu.customer_year_spend(sales_of(t), t.customer,
                                                                          d("2001-07-01")).collect()}
    assert got == {"c": money(50), "nobody": money(0)}


def test_agent_list_shows_all_passengers(spark):
    # Q5: the agent sees every purchase of flights it sold at least one ticket of
    tk, pu = purchases_on(1, [("1", "c1", "ag", "2001-06-01"), ("2", "c2", None, "2001-06-01"),
                              ("3", "c3", "other", "2001-06-01")])
    t = make_tables(spark, flight=[flight_row(1)], ticket=tk, purchases=pu)
    rows = ag.agent_upcoming_bookings(sales_of(t)).filter("booking_agent_email = 'ag'").collect()
    assert sorted(r.customer_email for r in rows) == ["c1", "c2", "c3"]
    own = ag.agent_upcoming_bookings(sales_of(t), own_only=True).filter("booking_agent_email = 'ag'").collect()
    assert [r.customer_email for r in own] == ["c1"]


def test_average_commission_is_half_even(spark):
    # Q6: 0.25 / 2 = 0.125 -> 0.12 ; 0.75 / 2 = 0.375 -> 0.38
    flights = [flight_row(1, price="0.10"), flight_row(2, price="0.15"), flight_row(3, price="0.60")]
    tk = [("1", "1"), ("2", "2"), ("3", "2"), ("4", "3")]
    pu = [("1", "c", "a1", d("2001-06-20")), ("2", "c", "a1", d("2001-06-20")),
          ("3", "c", "a2", d("2001-06-20")), ("4", "c", "a2", d("2001-06-20"))]
    t = make_tables(spark, flight=flights, ticket=tk, purchases=pu,
                    booking_agent=[("a1", "1", "A"), ("a2", "2", "A"), ("a3", "3", "A")])
    got = {r.booking_agent_email: (r.commission, r.tickets, r.avg_commission)
           for r in ag.agent_commission(sales_of(t), t.booking_agent, d("2001-07-01")).collect()}
    assert got["a1"] == (money("0.25"), 2, money("0.12"))
    assert got["a2"] == (money("0.75"), 2, money("0.38"))
    assert got["a3"] == (money(0), 0, money(0))


def test_top_k_ties_break_on_key(spark):
    # Q15: six customers tied; the five smallest emails are kept, ranks 1..5
    tk, pu = purchases_on(1, [(str(i), f"c{i}", "ag", "2001-06-01") for i in range(6)])
    t = make_tables(spark, flight=[flight_row(1)], ticket=tk, purchases=pu)
    rows = ag.agent_top_customers_by_tickets(sales_of(t), d("2001-07-01")).orderBy("rank").collect()
    assert [(r.rank, r.customer_email) for r in rows] == [(i + 1, f"c{i}") for i in range(5)]


def test_revenue_share_null_side_and_missing_airline(spark):
    # Q7: only direct sales -> agent side NULL in O22, 0.0 % in O23; airline B has no sales -> no row
    flights = [flight_row(1, airline="A", price="30.00"), flight_row(2, airline="B", price="10.00")]
    tk = [("1", "1"), ("2", "1"), ("3", "2")]
    pu = [("1", "c", None, d("2001-06-25")), ("2", "c", None, d("2001-06-26")), ("3", "c", None, d("1999-01-01"))]
    t = make_tables(spark, flight=flights, ticket=tk, purchases=pu)
    split = {(r.airline_name, r.window_days): (r.revenue_direct, r.revenue_agent)
             for r in al.airline_revenue_split(sales_of(t), d("2001-07-01")).collect()}
    assert split == {("A", 30): (money(60), None), ("A", 365): (money(60), None)}
    share = {(r.airline_name, r.window_days): (r.pct_direct, r.pct_agent)
             for r in al.airline_revenue_share(sales_of(t), d("2001-07-01")).collect()}
    assert share == {("A", 30): (100.0, 0.0), ("A", 365): (100.0, 0.0)}


def test_revenue_share_rounds_to_one_decimal(spark):
    flights = [flight_row(1, price="1.00"), flight_row(2, price="2.00")]
    tk = [("1", "1"), ("2", "2")]
    pu = [("1", "c", None, d("2001-06-25")), ("2", "c", "ag", d("2001-06-25"))]
    t = make_tables(spark, flight=flights, ticket=tk, purchases=pu)
    share = {r.window_days: (r.pct_direct, r.pct_agent)
             for r in al.airline_revenue_share(sales_of(t), d("2001-07-01")).collect()}
    assert share[30] == (33.3, 66.7)


def test_top_destinations_counts_flights_for_all_airlines(spark):
    # Q16: flights (not tickets) of all airlines, depart_time within the window up to as_of 00:00
    flights = [flight_row(1, airline="A", arr="Y", dep_t="2001-06-01 10:00:00", arr_t="2001-06-01 12:00:00"),
               flight_row(2, airline="B", arr="Y", dep_t="2001-06-02 10:00:00", arr_t="2001-06-02 12:00:00"),
               flight_row(3, airline="B", arr="Z", dep_t="2001-06-03 10:00:00", arr_t="2001-06-03 12:00:00"),
               flight_row(4, airline="B", arr="Z", dep_t="2001-07-01 00:00:01", arr_t="2001-07-01 12:00:00")]
    t = make_tables(spark, flight=flights, airport=[("X", "CX"), ("Y", "CY"), ("Z", "CZ")])
    rows = al.top_destinations(t.flight, t.airport, d("2001-07-01")).filter("window_days = 92").orderBy("rank")
    assert [(r.rank, r.city, r.flights) for r in rows.collect()] == [(1, "CY", 2), (2, "CZ", 1)]


def test_month_labels_and_keys(spark):
    from flightmart.functions.dates import month_key, month_label
    df = spark.createDataFrame([(d("2001-06-15"),), (d("2002-12-01"),)], "x date")
    rows = df.select(month_label("x").alias("l"), month_key("x").alias("k")).collect()
    assert [(r.l, r.k) for r in rows] == [("June", "2001-6"), ("Dec", "2002-12")]


def test_revenue_share_zero_revenue_is_null(spark):
    flights = [flight_row(1, price="0.00")]
    t = make_tables(spark, flight=flights, ticket=[("1", "1")], purchases=[("1", "c", None, d("2001-06-25"))])
    rows = al.airline_revenue_share(sales_of(t), d("2001-07-01")).collect()
    assert {(r.window_days, r.pct_direct, r.pct_agent) for r in rows} == {(30, None, None), (365, None, None)}


def test_agent_list_key_filter(spark):
    tk, pu = purchases_on(1, [("1", "c1", "ag", "2001-06-01"), ("2", "c2", "other", "2001-06-01")])
    t = make_tables(spark, flight=[flight_row(1)], ticket=tk, purchases=pu)
    agents = spark.createDataFrame([("ag",)], "booking_agent_email string")
    rows = ag.agent_upcoming_bookings(sales_of(t), agents=agents).collect()
    assert {(r.booking_agent_email, r.customer_email) for r in rows} == {("ag", "c1"), ("ag", "c2")}


def test_top_k_without_group(spark):
    from flightmart.functions.aggregates import top_k
    df = spark.createDataFrame([("a", 3), ("b", 5), ("c", 5), ("d", 1)], "k string, m long")
    rows = top_k(df, [], "m", 3, ["k"]).orderBy("rank").collect()
    assert [(r.rank, r.k) for r in rows] == [(1, "b"), (2, "c"), (3, "a")]


def test_agent_linear_form_joins_to_the_page(spark):
    from flightmart.sources import fixtures
    from tests.conftest import SF_SMALL
    sales = sales_of(fixtures.load(spark, SF_SMALL))
    flights = ag.agent_upcoming_flights(sales)
    passengers = ag.upcoming_passengers(sales)
    joined = flights.join(passengers.select("flight_num", "customer_email"), "flight_num")
    page = ag.agent_upcoming_bookings(sales)
    cols = sorted(page.columns)
    assert sorted(tuple(r[c] for c in cols) for r in joined.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in page.collect())


def test_commission_rate_and_default_range(spark):
    flights = [flight_row(1, price="100.00")]
    tk = [("1", "1"), ("2", "1"), ("3", "1")]
    pu = [("1", "c", "ag", d("2001-06-25")), ("2", "c", "ag", d("2001-05-01")), ("3", "c", "ag", d("2001-07-01"))]
    t = make_tables(spark, flight=flights, ticket=tk, purchases=pu, booking_agent=[("ag", "1", "A")])
    got = ag.agent_commission(sales_of(t), t.booking_agent, d("2001-07-01"), rate="0.1").collect()[0]
    assert (got.commission, got.tickets, got.avg_commission) == (money(20), 2, money(10))
    # missing begin -> as_of - 30, missing end -> as_of
    got = ag.agent_commission_range(sales_of(t), t.booking_agent, d("2001-07-01")).collect()[0]
    assert (got.commission, got.tickets) == (money(200), 2)
    got = ag.agent_commission_range(sales_of(t), t.booking_agent, d("2001-07-01"), begin="2001-04-01",
                                    end="2001-06-30").collect()[0]
    assert (got.commission, got.tickets) == (money(200), 2)


def test_next_30_days_bounds(spark):
    flights = [flight_row(1, dep_t="2001-07-01 00:00:00", arr_t="2001-07-01 03:00:00"),
               flight_row(2, dep_t="2001-06-30 23:00:00", arr_t="2001-07-01 03:00:00"),
               flight_row(3, dep_t="2001-07-30 22:00:00", arr_t="2001-07-31 00:00:00"),
               flight_row(4, dep_t="2001-07-30 22:00:00", arr_t="2001-07-31 00:00:01")]
    t = make_tables(spark, flight=flights)
    got = {r.flight_num for r in al.airline_flights_next_30_days(t.flight, d("2001-07-01")).collect()}
    assert got == {"1", "3"}


def test_months_of_customers_are_written_out_after_the_sums(spark):
    """The zeros cost one row for each customer in the sums, not one for each month; keys may be NULL, unknown or repeated."""
    sold = [("a", "2001-06-03", 5), ("a", "2001-06-09", 7), ("x", "2001-05-02", 3), (None, "2001-07-01", 2), ("a", "1999-01-01", 9), ("x", "2001-07-01", None)]
    sales = spark.createDataFrame([(c, d(p), None if v is None else money(v)) for c, p, v in sold], "customer_email string, p_date date, price decimal(10,2)")
    customer = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "email string")
    found = cu.customer_monthly_spend_6m(sales, customer, d("2001-07-01"), months=3)
    months = [d("2001-05-01"), d("2001-06-01"), d("2001-07-01")]
    spend = {("a", months[1]): money(12), (None, months[2]): money(2)}
    wanted = [(c, m, spend.get((c, m), money(0))) for c in ("a", "b", None) for m in months] + [("x", months[0], money(3)), ("x", months[2], None)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.index("Aggregate") and "Generate" not in text[text.index("Aggregate"):]
