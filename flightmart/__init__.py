"""flightmart: airline ticket sales analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames plus keyword parameters (an explicit
``as_of`` date instead of a clock read) and returns a DataFrame.  No
operator triggers an action; the caller decides when to execute.
"""

from flightmart.sources.tables import Tables

__all__ = ["Tables"]
