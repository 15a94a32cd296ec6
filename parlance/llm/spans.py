"""Span lists as the digests that queries return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int>>"


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by start, then by the place of their kind in ``kinds``."""
    place = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda x: F.struct(x["start"], F.array_position(place, x["kind"]), x["end"], x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(listed(F.filter(spans, lambda x: x["kind"].isin(*kinds)), kinds), 256)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
