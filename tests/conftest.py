from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from flightmart.session import get_session
    warehouse = tempfile.mkdtemp(prefix="flightmart-warehouse-")
    s = get_session("local[4]", shuffle_partitions=4, app_name="flightmart-tests",
                    extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def flight_row(num, airline="A", plane="P1", dep="X", arr="Y", dep_t="2001-08-01 10:00:00",
               arr_t="2001-08-01 12:00:00", price="100.00", status="upcoming"):
    return (str(num), airline, plane, dep, arr, ts(dep_t), ts(arr_t), Decimal(price), status)


def make_tables(spark, **rows):
    """Micro Tables from row tuples in schema order; missing tables are empty."""
    from flightmart.sources.schemas import SCHEMAS
    from flightmart.sources.tables import Tables
    from pyspark.sql import DataFrame
    frames = {}
    for name, schema in SCHEMAS.items():
        given = rows.get(name, [])
        frames[name] = given if isinstance(given, DataFrame) else spark.createDataFrame(given, schema)
    return Tables(**frames)
