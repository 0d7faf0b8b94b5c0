"""Physical-plan checks: the plans we want at scale, not just correct results."""

from __future__ import annotations

import contextlib
import io

import pytest

from flightmart.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

TOP_K = ["agent_top_customers_by_spend", "agent_top_customers_by_tickets", "airline_top_agents_by_sales",
         "airline_top_agents_by_tickets", "airline_top_customers", "top_destinations"]
DATE_WINDOW = ["airline_revenue_split", "airline_ticket_counts", "agent_commission", "customer_year_spend",
               "airline_monthly_tickets_12m", "customer_monthly_spend_6m"]


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(q(spark, SF_SMALL)) for name, q in QUERIES.items()}


def test_no_cross_products_or_python(plans):
    for name, p in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in p, f"{name} plans a {bad}"


def test_top_k_is_limited_before_the_shuffle(plans):
    for name in TOP_K:
        assert "WindowGroupLimit" in plans[name], name


def test_date_windows_reach_the_scan(plans):
    for name in DATE_WINDOW:
        scans = [block for block in plans[name].split("\n\n") if "orders.parquet" in block]
        assert any("GreaterThanOrEqual(o_orderdate" in b for b in scans), name


def test_columns_are_pruned(plans):
    for name in DATE_WINDOW:
        for block in plans[name].split("\n\n"):
            if "lineitem.parquet" in block and "ReadSchema" in block:
                assert "l_extendedprice" not in block and "l_shipdate" not in block, name


def test_fact_windows_are_partitioned(plans):
    # single-partition exchanges may only carry bounded inputs: global aggregates
    # (one partial row per task) and the bucket table of the id assignment
    import re
    # (the saved searches' global aggregates are a count and a set of masks: test_saved_search.py)
    allowed = {"assign_ticket_ids", "booking_rows_ticket", "booking_rows_purchases", "integrity_audit",
               "searches_matched", "searches_matched_by_bounds", "customer_searches_matched"}
    for name, p in plans.items():
        if name not in allowed:
            for block in p.split("\n\n"):
                assert "SinglePartition" not in block or re.search(r"Input \[\d+\]: \[max#", block), (name, block)


def test_ordered_windows_are_chunked(plans):
    import re
    for name in ("book_tickets_direct", "apply_flight_status", "agent_move_outcomes"):
        specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plans[name])
        row_level = [s for s in specs if "request_id" in s]
        assert row_level, name
        # every window ordered by request (row level) also partitions by the chunk
        assert all("_chunk" in s for s in row_level), (name, row_level)


def test_hot_flight_join_is_split_by_aqe(spark):
    """A flight with a third of all tickets: with broadcast off, the fact's flight
    join is a sort-merge join and AQE splits the hot partition."""
    import datetime as dt
    import random

    from flightmart.operators.facts import sales_of
    from tests.conftest import flight_row, make_tables
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    saved = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        rnd = random.Random(1)
        n = 30000
        t = make_tables(spark, flight=[flight_row(f"F{i}") for i in range(300)],
                        ticket=[(str(i), "F0" if i % 3 == 0 else f"F{rnd.randint(1, 299)}") for i in range(n)],
                        purchases=[(str(i), f"c{i % 500}", None, dt.date(2001, 1, 1)) for i in range(n)])
        df = sales_of(t)
        assert df.count() == n
        df.collect()
        p = plan(df)
        assert "isFinalPlan=true" in p
        assert "SortMergeJoin(skew=true)" in p and "skewed" in p
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
