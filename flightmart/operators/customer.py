"""Customer operators (O05, O06, O11-O13), for every customer at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.functions.aggregates import money, zero_filled_sum
from flightmart.functions.dates import in_range, in_window, last_months, month_start
from flightmart.functions.predicates import apply_criteria
from flightmart.operators.airline import check_range
from flightmart.sources.schemas import FLIGHT_COLUMNS, STATUS_UPCOMING


def customer_upcoming_flights(sales: DataFrame) -> DataFrame:
    """Per customer, the upcoming flights they hold a ticket for, each flight once.

    The status filter reaches the flight scan; the purchases are then cut
    down by the join before the (customer, flight) de-duplication, which
    shuffles once on that pair (partial de-duplication map-side).
    """
    up = sales.filter(F.col("flight_status") == F.lit(STATUS_UPCOMING))
    return (up.select("customer_email", *FLIGHT_COLUMNS)
            .dropDuplicates(["customer_email", "flight_num"]))


def customer_upcoming_search(sales: DataFrame, airport: DataFrame, criteria=None) -> DataFrame:
    """O05 restricted by search criteria; dates are bounds (Q3)."""
    return apply_criteria(customer_upcoming_flights(sales), airport, criteria, "bound")


def customer_year_spend(sales: DataFrame, customer: DataFrame, as_of: dt.date, days: int = 365) -> DataFrame:
    """Per customer, sum of price over the distinct flights bought in the window (Q4).

    Two aggregations: de-duplicate (customer, flight, price), then sum per
    customer; each has a map-side partial step, so a customer with a huge
    share of the rows is pre-reduced before any shuffle.
    """
    flights = (sales.filter(in_window("p_date", as_of, days))
               .select("customer_email", "flight_num", "price").distinct())
    out = zero_filled_sum(flights, customer.select(F.col("email").alias("customer_email")),
                          ["customer_email"], {"year_spend": "price"})
    return out.select("customer_email", money("year_spend").alias("year_spend"))


def _monthly_spend(sales: DataFrame, customer: DataFrame, lo: dt.date, hi: dt.date,
                   first: dt.date, last: dt.date, hi_inclusive: bool) -> DataFrame:
    """Sums of the months that have sales meet one row of each customer; the months are written out last.

    What is summed for the zeros is a row for each customer, however many months there are.
    A customer missing from ``customer`` has the months of its sales only.
    """
    facts = (sales.filter(in_range("p_date", lo, hi, end_inclusive=hi_inclusive))
             .groupBy("customer_email", F.trunc("p_date", "MM").alias("month_start")).agg(F.sum("price").alias("spend")))
    sold = facts.select("customer_email", F.struct("month_start", "spend").alias("_sold"))
    known = customer.select(F.col("email").alias("customer_email"), F.lit(None).cast(sold.schema["_sold"].dataType).alias("_sold"))
    by_customer = sold.unionByName(known).groupBy("customer_email").agg(
        F.collect_list("_sold").alias("_sold"), F.max(F.col("_sold").isNull()).alias("_known"))  # one entry for each month
    spine = F.sequence(F.lit(month_start(first)), F.lit(month_start(last)), F.expr("INTERVAL 1 MONTH"))
    spend = F.map_from_entries("_sold")
    every = F.transform(spine, lambda m: F.struct(m.alias("month_start"), F.coalesce(spend[m], F.lit(0)).alias("spend")))
    out = by_customer.select("customer_email", F.inline(F.when(F.col("_known"), every).otherwise(F.col("_sold"))))
    return out.select("customer_email", "month_start", money("spend").alias("spend"))


def customer_monthly_spend_6m(sales: DataFrame, customer: DataFrame, as_of: dt.date,
                              months: int = 6) -> DataFrame:
    """Per customer, spend in each of the last ``months`` calendar months, as_of's the last.

    True calendar months (Q1 corrected): purchases before the first shown
    month are not folded into any bar.  Zero filled for every customer.
    """
    first, last = last_months(as_of, months)
    return _monthly_spend(sales, customer, first, as_of, first, last, True)


def customer_monthly_spend_range(sales: DataFrame, customer: DataFrame, start: dt.date, end: dt.date,
                                 as_of: dt.date) -> DataFrame:
    """Per customer, spend by month for ``start <= p_date < end`` (Q2), zero filled.

    Raises ValueError when start > end or end > as_of (the reference's form checks).
    """
    s, e = check_range(start, end, as_of)
    return _monthly_spend(sales, customer, s, e, s, e, False)
