"""Airline staff operators: flight lists (O09, O10) and reports.

All reports are computed for every airline at once; ``airline_name`` is a
group column.  Window widths are parameters whose defaults are the
reference's (quirk Q17: "last month" is 30 days for revenue, 31 for
tickets and agents).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.functions.aggregates import money, pct, top_k, zero_filled_sum
from flightmart.functions.dates import (as_date, days_before, in_range, in_window, last_months,
                                        midnight, month_spine)
from flightmart.functions.predicates import apply_criteria
from flightmart.sources.schemas import FLIGHT_COLUMNS


def _unpivot_windows(df: DataFrame, keys: Sequence[str], windows: Sequence[int],
                     measures: Sequence[str]) -> DataFrame:
    """Turn per-window columns ``{measure}_{w}`` into rows (keys, window_days, measures)."""
    structs = [F.struct(F.lit(int(w)).alias("window_days"),
                        *[F.col(f"{m}_{w}").alias(m) for m in measures])
               for w in windows]
    return df.select(*keys, F.inline(F.array(*structs)))


# ---------------------------------------------------------------- flight lists

def airline_flights_next_30_days(flight: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Per airline, flights with depart_time >= as_of and arrive_time <= as_of + days."""
    end = as_date(as_of) + dt.timedelta(days=days)
    return flight.filter((F.col("depart_time") >= midnight(as_of)) & (F.col("arrive_time") <= midnight(end)))


def airline_flight_search(flight: DataFrame, airport: DataFrame, criteria, airline: str | None = None) -> DataFrame:
    """Per airline flight search; dates are bounds (Q3), no status filter."""
    df = flight if airline is None else flight.filter(F.col("airline_name") == F.lit(airline))
    return apply_criteria(df, airport, criteria, "bound")


# ---------------------------------------------------------------- top-k reports

def airline_top_agents_by_tickets(sales: DataFrame, as_of: dt.date, windows: Sequence[int] = (31, 365),
                                  k: int = 5) -> DataFrame:
    """Per airline and window, top k non-null agents by tickets sold.

    One scan of the widest window; per-window counts are conditional
    aggregates, then unpivoted to (airline, window) groups for the top-k.
    """
    wmax = max(windows)
    agg = (sales.filter(in_window("p_date", as_of, wmax) & F.col("booking_agent_email").isNotNull())
           .groupBy("airline_name", "booking_agent_email")
           .agg(*[F.count(F.when(F.col("p_date") >= F.lit(days_before(as_of, w)), F.col("ticket_id")))
                  .alias(f"tickets_{w}") for w in windows]))
    rows = (_unpivot_windows(agg, ["airline_name", "booking_agent_email"], windows, ["tickets"])
            .filter(F.col("tickets") > 0))
    out = top_k(rows, ["airline_name", "window_days"], "tickets", k, ["booking_agent_email"])
    return out.select("airline_name", "window_days", "rank", "booking_agent_email", "tickets")


def airline_top_agents_by_sales(sales: DataFrame, as_of: dt.date, days: int = 365, k: int = 5) -> DataFrame:
    """Per airline, top k non-null agents by sum(price) in the window."""
    agg = (sales.filter(in_window("p_date", as_of, days) & F.col("booking_agent_email").isNotNull())
           .groupBy("airline_name", "booking_agent_email")
           .agg(money(F.sum("price")).alias("sales")))
    out = top_k(agg, ["airline_name"], "sales", k, ["booking_agent_email"])
    return out.select("airline_name", "rank", "booking_agent_email", "sales")


def airline_top_customers(sales: DataFrame, as_of: dt.date, days: int = 365, k: int = 10) -> DataFrame:
    """Per airline, top k customers by tickets in the window."""
    agg = (sales.filter(in_window("p_date", as_of, days))
           .groupBy("airline_name", "customer_email")
           .agg(F.count("ticket_id").alias("tickets")))
    out = top_k(agg, ["airline_name"], "tickets", k, ["customer_email"])
    return out.select("airline_name", "rank", "customer_email", "tickets")


def top_destinations(flight: DataFrame, airport: DataFrame, as_of: dt.date,
                     windows: Sequence[int] = (92, 365), k: int = 3,
                     per_airline: bool = False) -> DataFrame:
    """Top k arrival cities by number of flights departing in each window.

    All airlines together by default (Q16); ``per_airline=True`` ranks per
    airline instead.  Bounds compare depart_time with midnights.
    """
    wmax = max(windows)
    f = flight.filter((F.col("depart_time") >= midnight(days_before(as_of, wmax)))
                      & (F.col("depart_time") <= midnight(as_of)))
    win = F.array(*[F.when(F.col("depart_time") >= midnight(days_before(as_of, w)), F.lit(int(w)))
                    for w in windows])
    keyed = (f.join(airport, f["arrive_name"] == airport["name"])
             .select("airline_name", F.col("city"), "arrive_time", F.explode(win).alias("window_days"))
             .filter(F.col("window_days").isNotNull()))
    group = ["window_days", "city"] + (["airline_name"] if per_airline else [])
    agg = keyed.groupBy(*group).agg(F.count("arrive_time").alias("flights"))
    rank_group = ["window_days"] + (["airline_name"] if per_airline else [])
    out = top_k(agg, rank_group, "flights", k, ["city"])
    cols = (["airline_name"] if per_airline else []) + ["window_days", "rank", "city", "flights"]
    return out.select(*cols)


# ---------------------------------------------------------------- one-pass sums

def airline_ticket_counts(sales: DataFrame, airline: DataFrame, as_of: dt.date,
                          short_days: int = 31, long_days: int = 365) -> DataFrame:
    """Per airline, tickets sold in the last 31 and 365 days (0 when none)."""
    facts = (sales.filter(in_window("p_date", as_of, max(short_days, long_days)))
             .select("airline_name",
                     F.when(F.col("p_date") >= F.lit(days_before(as_of, short_days)), 1).otherwise(0).alias("s"),
                     F.when(F.col("p_date") >= F.lit(days_before(as_of, long_days)), 1).otherwise(0).alias("l")))
    out = zero_filled_sum(facts, airline.select(F.col("name").alias("airline_name")), ["airline_name"],
                          {f"tickets_{short_days}d": "s", f"tickets_{long_days}d": "l"})
    return out.select("airline_name", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


def airline_revenue_split(sales: DataFrame, as_of: dt.date, windows: Sequence[int] = (30, 365)) -> DataFrame:
    """Per airline and window, revenue of direct sales (agent NULL) and via agents.

    A side with no sales is NULL (SUM over no rows); an airline without any
    sale in a window has no row for it.  Both windows come from one scan
    through conditional aggregates.
    """
    wmax = max(windows)
    is_direct = F.col("booking_agent_email").isNull()
    aggs = []
    for w in windows:
        inside = F.col("p_date") >= F.lit(days_before(as_of, w))
        aggs += [
            F.sum(F.when(inside & is_direct, F.col("price"))).alias(f"revenue_direct_{w}"),
            F.sum(F.when(inside & ~is_direct, F.col("price"))).alias(f"revenue_agent_{w}"),
            F.count(F.when(inside, F.lit(1))).alias(f"n_{w}"),
        ]
    agg = sales.filter(in_window("p_date", as_of, wmax)).groupBy("airline_name").agg(*aggs)
    rows = _unpivot_windows(agg, ["airline_name"], windows, ["revenue_direct", "revenue_agent", "n"])
    return rows.filter(F.col("n") > 0).select(
        "airline_name", "window_days",
        money("revenue_direct").alias("revenue_direct"),
        money("revenue_agent").alias("revenue_agent"))


def airline_revenue_share(sales: DataFrame, as_of: dt.date, windows: Sequence[int] = (30, 365)) -> DataFrame:
    """O22 as percentages with one decimal; a NULL side counts as 0 (Q7)."""
    split = airline_revenue_split(sales, as_of, windows)
    d = F.coalesce(F.col("revenue_direct"), F.lit(0).cast("decimal(18,2)"))
    a = F.coalesce(F.col("revenue_agent"), F.lit(0).cast("decimal(18,2)"))
    positive = (d + a) > 0
    return split.select(
        "airline_name", "window_days",
        F.when(positive, pct(d, a)).alias("pct_direct"),
        F.when(positive, pct(a, d)).alias("pct_agent"))


# ---------------------------------------------------------------- month series

def _monthly_tickets(sales: DataFrame, airline: DataFrame, lo: dt.date, hi: dt.date,
                     first: dt.date, last: dt.date) -> DataFrame:
    facts = (sales.filter(in_range("p_date", lo, hi))
             .select("airline_name", F.trunc("p_date", "MM").alias("month_start"), F.lit(1).alias("n")))
    spine = month_spine(airline.select(F.col("name").alias("airline_name")), first, last)
    out = zero_filled_sum(facts, spine, ["airline_name", "month_start"], {"tickets": "n"})
    return out.select("airline_name", "month_start", F.col("tickets").cast("bigint").alias("tickets"))


def airline_monthly_tickets_12m(sales: DataFrame, airline: DataFrame, as_of: dt.date,
                                months: int = 12) -> DataFrame:
    """Per airline, tickets per calendar month for the last ``months`` months, as_of's the last.

    Year-month buckets (Q14 corrected); zero filled for every airline.
    """
    first, last = last_months(as_of, months)
    return _monthly_tickets(sales, airline, first, as_of, first, last)


def check_range(start: dt.date, end: dt.date, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Input checks of the range reports: from <= to and to <= as_of."""
    s, e = as_date(start), as_date(end)
    if s > e:
        raise ValueError("range start is after range end")
    if e > as_date(as_of):
        raise ValueError("range end is after the as-of date")
    return s, e


def airline_monthly_tickets_range(sales: DataFrame, airline: DataFrame, start: dt.date, end: dt.date,
                                  as_of: dt.date) -> DataFrame:
    """Per airline, tickets per month for start <= p_date <= end, zero filled."""
    s, e = check_range(start, end, as_of)
    return _monthly_tickets(sales, airline, s, e, s, e)


# ---------------------------------------------------------------- listings

def customer_purchase_history(sales: DataFrame) -> DataFrame:
    """Per (airline, customer), each purchase with its flight columns."""
    rest = [c for c in FLIGHT_COLUMNS if c != "airline_name"]
    return sales.select("airline_name", "customer_email", *rest, "ticket_id", "booking_agent_email", "p_date")


def flight_passenger_list(sales: DataFrame) -> DataFrame:
    """Per (airline, flight), the customer emails; one row per ticket."""
    return sales.select("airline_name", "flight_num", "customer_email")


def staff_permissions(airline_staff: DataFrame, permission: DataFrame) -> DataFrame:
    """Per airline, staff username and permission, one row per grant."""
    return (airline_staff.select("username", "airline_name")
            .join(permission, "username")
            .select("airline_name", "username", "permission"))
