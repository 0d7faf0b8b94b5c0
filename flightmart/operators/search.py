"""Flight search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.functions.predicates import apply_criteria
from flightmart.sources.schemas import STATUS_UPCOMING


def public_upcoming_flights(flight: DataFrame) -> DataFrame:
    """All flights with status ``upcoming``."""
    return flight.filter(F.col("flight_status") == F.lit(STATUS_UPCOMING))


def flight_search(flight: DataFrame, airport: DataFrame, criteria=None) -> DataFrame:
    """Public search.  A date d means ``d 00:00 <= time <= (d+1) 00:00``.

    No status filter; no criteria returns every flight.  City criteria are
    left-semi joins with the airport table.
    """
    return apply_criteria(flight, airport, criteria, "day")
