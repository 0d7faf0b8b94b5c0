"""Optional search criteria folded into one predicate.

Two date conventions exist (quirk Q3):

* ``"day"`` (public search): a departure date d keeps flights with
  ``d 00:00 <= depart_time <= (d+1) 00:00`` (so 00:00 of the next day
  also matches); the same for the arrival date on ``arrive_time``.
* ``"bound"`` (customer, agent and staff searches): a departure date is a
  lower bound ``depart_time >= d 00:00`` and an arrival date an upper bound
  ``arrive_time <= d 00:00``.

City criteria go through the airport table (``name IN (SELECT name FROM
airport WHERE city = ?)``) and are applied as left-semi joins.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightmart.functions.dates import as_date, midnight


@dataclass(frozen=True)
class SearchCriteria:
    flight_num: str | None = None
    departure_airport: str | None = None
    arrival_airport: str | None = None
    departure_city: str | None = None
    arrival_city: str | None = None
    departure_date: dt.date | str | None = None
    arrival_date: dt.date | str | None = None

    @classmethod
    def of(cls, criteria: "SearchCriteria | dict | None") -> "SearchCriteria":
        if criteria is None:
            return cls()
        if isinstance(criteria, SearchCriteria):
            return criteria
        # Empty strings mean "not given", as on the search forms.
        return cls(**{k: (v if v not in ("", None) else None) for k, v in criteria.items()})


def column_predicates(c: SearchCriteria, convention: str, prefix: str = "") -> list[Column]:
    """The non-city predicates of the given criteria, as a list of Columns."""
    col = lambda name: F.col(prefix + name)
    preds: list[Column] = []
    if c.departure_date is not None:
        d = as_date(c.departure_date)
        if convention == "day":
            preds.append(col("depart_time").between(midnight(d), midnight(d + dt.timedelta(days=1))))
        else:
            preds.append(col("depart_time") >= midnight(d))
    if c.arrival_date is not None:
        d = as_date(c.arrival_date)
        if convention == "day":
            preds.append(col("arrive_time").between(midnight(d), midnight(d + dt.timedelta(days=1))))
        else:
            preds.append(col("arrive_time") <= midnight(d))
    if c.flight_num is not None:
        preds.append(col("flight_num") == F.lit(str(c.flight_num)))
    if c.departure_airport is not None:
        preds.append(col("depart_name") == F.lit(c.departure_airport))
    if c.arrival_airport is not None:
        preds.append(col("arrive_name") == F.lit(c.arrival_airport))
    return preds


def fold(preds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, preds) if preds else None


def apply_criteria(df: DataFrame, airport: DataFrame, criteria: "SearchCriteria | dict | None",
                   convention: str) -> DataFrame:
    """Filter ``df`` (which carries the flight columns) by the criteria."""
    c = SearchCriteria.of(criteria)
    pred = fold(column_predicates(c, convention))
    if pred is not None:
        df = df.filter(pred)
    if c.departure_city is not None:
        names = airport.filter(F.col("city") == F.lit(c.departure_city)).select(F.col("name").alias("_dep"))
        df = df.join(names, df["depart_name"] == names["_dep"], "left_semi")
    if c.arrival_city is not None:
        names = airport.filter(F.col("city") == F.lit(c.arrival_city)).select(F.col("name").alias("_arr"))
        df = df.join(names, df["arrive_name"] == names["_arr"], "left_semi")
    return df
