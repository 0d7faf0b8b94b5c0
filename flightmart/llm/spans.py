"""Spans (kind, start, end) in code points, and the digests that queries return of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_text(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of an array of structs, by start, then kind as listed, then end; comma-joined."""
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(kinds) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
