"""Staff dashboard as one shared scan (O18-O22 together).

The reference runs a dozen statements per page view, each re-joining the
fact.  Here the sales of the widest window are read once and pre-aggregated
to the (airline, agent, customer) grain with conditional sums per window;
the five reports are then small aggregations of that pre-aggregate, which is
far smaller than the fact (one row per distinct triple, not per ticket).
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.functions.aggregates import money, pct, top_k, zero_filled_sum
from flightmart.functions.dates import days_before, in_window

AGENT = "booking_agent_email"


def dashboard_cube(sales: DataFrame, as_of: dt.date, ticket_windows=(31, 365), revenue_windows=(30, 365)) -> DataFrame:
    wmax = max(*ticket_windows, *revenue_windows)
    since = lambda w: F.col("p_date") >= F.lit(days_before(as_of, w))
    direct = F.col(AGENT).isNull()
    aggs = [F.count(F.when(since(w), F.lit(1))).alias(f"t{w}") for w in ticket_windows]
    aggs += [F.sum(F.when(since(w), F.col("price"))).alias(f"s{w}") for w in revenue_windows]
    aggs += [F.count(F.when(since(w), F.lit(1))).alias(f"n{w}") for w in revenue_windows]
    return (sales.filter(in_window("p_date", as_of, wmax))
            .groupBy("airline_name", AGENT, "customer_email").agg(*aggs))


def staff_dashboard(sales: DataFrame, airline: DataFrame, as_of: dt.date, persist: bool = True,
                    ticket_windows=(31, 365), revenue_windows=(30, 365)) -> dict[str, DataFrame]:
    """All staff-page reports from one scan.  Returns a dict of DataFrames
    (plus ``"cube"``, the shared pre-aggregate; unpersist it when done)."""
    cube = dashboard_cube(sales, as_of, ticket_windows, revenue_windows)
    if persist:
        cube = cube.persist(StorageLevel.MEMORY_AND_DISK)
    t_short, t_long = ticket_windows
    r_short, r_long = revenue_windows

    by_agent = (cube.filter(F.col(AGENT).isNotNull()).groupBy("airline_name", AGENT)
                .agg(*[F.sum(f"t{w}").alias(f"t{w}") for w in ticket_windows], F.sum(f"s{r_long}").alias("sales")))
    agent_rows = by_agent.select("airline_name", AGENT, F.inline(F.array(*[
        F.struct(F.lit(w).alias("window_days"), F.col(f"t{w}").alias("tickets")) for w in ticket_windows])))
    top_agents_tickets = top_k(agent_rows.filter(F.col("tickets") > 0), ["airline_name", "window_days"],
                               "tickets", 5, [AGENT]).select("airline_name", "window_days", "rank", AGENT, "tickets")
    top_agents_sales = top_k(by_agent.filter(F.col("sales").isNotNull()).withColumn("sales", money("sales")),
                             ["airline_name"], "sales", 5, [AGENT]).select("airline_name", "rank", AGENT, "sales")

    by_customer = (cube.groupBy("airline_name", "customer_email").agg(F.sum(f"t{t_long}").alias("tickets"))
                   .filter(F.col("tickets") > 0))
    top_customers = top_k(by_customer, ["airline_name"], "tickets", 10, ["customer_email"]).select(
        "airline_name", "rank", "customer_email", "tickets")

    counts = zero_filled_sum(cube, airline.select(F.col("name").alias("airline_name")), ["airline_name"],
                             {f"tickets_{t_short}d": f"t{t_short}", f"tickets_{t_long}d": f"t{t_long}"})
    counts = counts.select("airline_name", *[F.col(c).cast("bigint").alias(c) for c in counts.columns[1:]])

    is_direct = F.col(AGENT).isNull()
    split_wide = cube.groupBy("airline_name").agg(*[
        F.sum(F.when(is_direct, F.col(f"s{w}"))).alias(f"d{w}") for w in revenue_windows
    ] + [F.sum(F.when(~is_direct, F.col(f"s{w}"))).alias(f"a{w}") for w in revenue_windows
         ] + [F.sum(f"n{w}").alias(f"n{w}") for w in revenue_windows])
    split = split_wide.select("airline_name", F.inline(F.array(*[
        F.struct(F.lit(w).alias("window_days"), money(f"d{w}").alias("revenue_direct"),
                 money(f"a{w}").alias("revenue_agent"), F.col(f"n{w}").alias("n")) for w in revenue_windows])))
    split = split.filter(F.col("n") > 0).drop("n")
    zero = F.lit(0).cast("decimal(18,2)")
    d, a = F.coalesce("revenue_direct", zero), F.coalesce("revenue_agent", zero)
    share = split.select("airline_name", "window_days",
                         F.when(d + a > 0, pct(d, a)).alias("pct_direct"),
                         F.when(d + a > 0, pct(a, d)).alias("pct_agent"))
    return {
        "cube": cube,
        "airline_top_agents_by_tickets": top_agents_tickets,
        "airline_top_agents_by_sales": top_agents_sales,
        "airline_top_customers": top_customers,
        "airline_ticket_counts": counts,
        "airline_revenue_split": split,
        "airline_revenue_share": share,
    }
