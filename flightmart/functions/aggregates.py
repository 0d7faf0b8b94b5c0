"""Aggregate helpers: zero-filled group sums, top-k per group, shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(col: str | Column) -> Column:
    """Money leaves an operator as DECIMAL(18,2) (sum of DECIMAL(10,2) is wider)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def zero_filled_sum(facts: DataFrame, zeros: DataFrame, keys: Sequence[str],
                    measures: dict[str, str]) -> DataFrame:
    """Sum ``measures`` per ``keys`` over facts, with a zero row for every key of ``zeros``.

    Instead of a left join of a key table with the aggregate (two shuffles),
    the zero rows are unioned under the facts and one aggregation adds them
    up: one exchange, with map-side partial sums for hot keys.
    ``measures`` maps output name -> fact column; ``zeros`` carries the keys only.
    The output keys are the keys of ``zeros`` plus any key that has facts
    (a fact whose key is missing from the key table, i.e. a broken foreign
    key, still shows up; the integrity audit reports such rows).
    """
    fact_cols = [F.col(k) for k in keys] + [F.col(src).alias(out) for out, src in measures.items()]
    zero_cols = [F.col(k) for k in keys] + [F.lit(0).alias(out) for out in measures]
    combined = facts.select(*fact_cols).unionByName(zeros.select(*zero_cols))
    return combined.groupBy(*keys).agg(*[F.sum(out).alias(out) for out in measures])


def top_k(df: DataFrame, group: Sequence[str], measure: str, k: int,
          tie_break: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """The k largest ``measure`` rows per group, ties broken by ``tie_break`` ascending.

    ``row_number() <= k`` is planned as a WindowGroupLimit: each map task keeps
    only its k best rows per group before the shuffle, so a group holding a
    third of all rows still sends at most k rows per task to its reducer.
    With no group (``group=[]``) this is a global ORDER BY ... LIMIT k,
    planned as TakeOrderedAndProject.
    """
    order = [F.col(measure).desc()] + [F.col(c).asc() for c in tie_break]
    if not group:
        ranked = df.orderBy(*order).limit(k)
        w = Window.orderBy(*order)
        # k rows only: the single-partition window here sees at most k rows.
        return ranked.withColumn(rank_col, F.row_number().over(w).cast("int"))
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("int"))
            .filter(F.col(rank_col) <= k))


def safe_avg(total: str | Column, n: str | Column, scale: int = 2) -> Column:
    """Total / n rounded half-even to ``scale`` decimals, 0 when n is 0."""
    t = F.col(total) if isinstance(total, str) else total
    c = F.col(n) if isinstance(n, str) else n
    return F.when(c == 0, F.lit(0).cast(MONEY)).otherwise(F.bround(t / c, scale).cast(MONEY))


def pct(part: str | Column, other: str | Column) -> Column:
    """100 * part / (part + other) rounded half-up to one decimal.

    Computed exactly on integer cents: tenths = (2000*p + t) div (2*t).  The
    integer division is done as (a - a % b) / b, which is an exact integer,
    so no floating-point rounding can move a value across a .05 boundary.
    """
    p = F.col(part) if isinstance(part, str) else part
    o = F.col(other) if isinstance(other, str) else other
    p_c = (p * 100).cast("bigint")
    t_c = ((p + o) * 100).cast("bigint")
    a = p_c * 2000 + t_c
    b = t_c * 2
    tenths = F.round((a - a % b) / b).cast("bigint")
    return tenths / F.lit(10.0)
