"""Order-dependent helpers that stay partitioned when one key is very hot.

A plain ``lag`` / running sum over ``Window.partitionBy(key)`` sends all rows
of a key to one task.  These helpers cut each key's rows into chunks (time
buckets or id ranges), do the ordered work inside (key, chunk) pieces, and
carry across chunks through a table of one row per chunk, by levels of chunks
where one key may have very many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality with the renamed keys, so rows with a NULL key or chunk are kept."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def previous_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunks: Sequence[Column],
                   out: str) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same key in ``order`` (NULL for the first).

    ``chunks`` run from coarse to fine, each monotone in ``order`` (e.g.
    ``date_trunc`` of ts by day, then by second, when order starts with ts).
    Rows are ordered inside the finest pieces only; the last value of each
    piece is carried on by the same rule with one level less.
    """
    keys, level = list(keys), len(chunks)
    if not chunks:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.lag(value).over(w))
    names = [f"_chunk{level}_{i}" for i in range(level)]
    d = df.withColumns(dict(zip(names, chunks, strict=True)))
    last = d.groupBy(*keys, *names).agg(F.max_by(value, F.struct(*order)).alias(f"_last{level}"))
    carried = previous_value(last, keys, f"_last{level}", names, [F.col(n) for n in names[:-1]], f"_in{level}")
    prefix = f"_k{level}_"
    carried = carried.select(*[F.col(k).alias(prefix + k) for k in keys + names], f"_in{level}")
    w = Window.partitionBy(*keys, *names).orderBy(*order)
    return (d.join(carried, _on(keys + names, prefix)).drop(*[prefix + k for k in keys + names])
            .withColumn(out, F.when(F.row_number().over(w) == 1, F.col(f"_in{level}")).otherwise(F.lag(value).over(w)))
            .drop(*names, f"_in{level}"))


def running_before(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunks: Sequence[Column],
                   out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the earlier rows of the same key (0 for the first); ``chunks`` as above."""
    keys, level = list(keys), len(chunks)
    names = [f"_chunk{level}_{i}" for i in range(level)]
    d = df.withColumns(dict(zip(names, chunks, strict=True))) if names else df
    w = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(w), F.lit(0))
    if not names:
        return d.withColumn(out, inside)
    totals = d.groupBy(*keys, *names).agg(F.sum(value).alias(f"_sum{level}"))
    carried = running_before(totals, keys, f"_sum{level}", names, [F.col(n) for n in names[:-1]], f"_in{level}")
    prefix = f"_k{level}_"
    carried = carried.select(*[F.col(k).alias(prefix + k) for k in keys + names], f"_in{level}")
    return (d.join(carried, _on(keys + names, prefix)).drop(*[prefix + k for k in keys + names])
            .withColumn(out, F.col(f"_in{level}") + inside).drop(*names, f"_in{level}"))


def id_chunk(col: str, size: int) -> Column:
    """Chunk by ranges of a numeric id (for request tables without timestamps)."""
    return F.floor(F.col(col) / F.lit(size))
