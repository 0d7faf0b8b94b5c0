"""Shared-scan dashboard and the month-partitioned sales mart."""

from __future__ import annotations

import collections
import contextlib
import io
import tempfile

from flightmart.operators import airline as al
from flightmart.operators.facts import sales_of
from flightmart.plans import dashboard, mart
from flightmart.sources import fixtures
from tests.conftest import SF_SMALL

AS_OF = fixtures.AS_OF


def bag(df):
    cols = sorted(df.columns)
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_dashboard_equals_separate_reports(spark):
    t = fixtures.load(spark, SF_SMALL)
    sales = sales_of(t)
    dash = dashboard.staff_dashboard(sales, t.airline, AS_OF)
    try:
        assert bag(dash["airline_top_agents_by_tickets"]) == bag(al.airline_top_agents_by_tickets(sales, AS_OF))
        assert bag(dash["airline_top_agents_by_sales"]) == bag(al.airline_top_agents_by_sales(sales, AS_OF))
        assert bag(dash["airline_top_customers"]) == bag(al.airline_top_customers(sales, AS_OF))
        assert bag(dash["airline_ticket_counts"]) == bag(al.airline_ticket_counts(sales, t.airline, AS_OF))
        assert bag(dash["airline_revenue_split"]) == bag(al.airline_revenue_split(sales, AS_OF))
        assert bag(dash["airline_revenue_share"]) == bag(al.airline_revenue_share(sales, AS_OF))
    finally:
        dash["cube"].unpersist()


def test_sales_mart_prunes_months(spark):
    t = fixtures.load(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="flightmart-mart-") + "/sales"
    mart.write_sales_mart(t.purchases, t.ticket, t.flight, path, files_per_month=2)
    window = mart.read_sales_window(spark, path, AS_OF, 30)
    assert bag(al.airline_revenue_split(window, AS_OF, windows=(30,))) == \
        bag(al.airline_revenue_split(sales_of(t), AS_OF, windows=(30,)))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        window.explain("formatted")
    assert "PartitionFilters: [isnotnull(p_month" in buf.getvalue()
    assert mart.read_sales_mart(spark, path).count() == sales_of(t).count()


def test_cluster_settings():
    from flightmart.session import cluster_settings
    s = cluster_settings(100 * 1024 ** 4, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert int(cluster_settings(10, 8)["spark.sql.shuffle.partitions"]) == 24


def test_read_tables_prunes_purchase_months(spark):
    import datetime as dt

    from flightmart.sources.schemas import PURCHASES
    from flightmart.sources.tables import read_tables, write_tables
    root = tempfile.mkdtemp(prefix="flightmart-tables-") + "/t"
    t = fixtures.load(spark, SF_SMALL)
    write_tables(t, root)
    window = (dt.date(2001, 6, 1), dt.date(2001, 7, 1))
    pruned = read_tables(spark, root, purchase_window=window).purchases
    assert pruned.columns == PURCHASES.fieldNames() and "p_month" not in PURCHASES.fieldNames()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        pruned.explain("formatted")
    assert "PartitionFilters: [isnotnull(p_month" in buf.getvalue()
    inside = "p_date BETWEEN DATE'2001-06-01' AND DATE'2001-07-01'"
    assert pruned.filter(inside).count() == t.purchases.filter(inside).count() > 0
    assert read_tables(spark, root).purchases.count() == t.purchases.count()


def test_checkpoint_dir_is_kept_when_set(spark):
    from flightmart.session import ensure_checkpoint_dir
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first


def test_bucketed_facts_join_without_shuffle(spark):
    from flightmart.operators.facts import sales_of
    from flightmart.sources.tables import read_bucketed_facts, write_bucketed_facts
    t = fixtures.load(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="flightmart-bucketed-")
    write_bucketed_facts(t, root, buckets=4, prefix="test_fm")
    b = read_bucketed_facts(spark, t, prefix="test_fm")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = b.purchases.join(b.ticket, "ticket_id")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            joined.explain()
        assert "SortMergeJoin" in buf.getvalue() and "Exchange" not in buf.getvalue()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert bag(sales_of(b)) == bag(sales_of(t))
