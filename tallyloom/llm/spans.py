"""Columns made from arrays of spans (kind, start, end)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once per row, however often ``fn`` names it, also
    inside functions over arrays."""
    return F.transform(F.array(value), fn)[0]


STEP = 256


def sums_before(values: Column) -> Column:
    """For each entry of an array of whole numbers the sum of those before it, block by block, so
    that long arrays take about STEP steps per entry and no entry copies all before it."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)

    def by_block(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / STEP).cast("int")), lambda b: F.slice(own, b * STEP + 1, STEP))
        return bound(cut, lambda blocks: bound(F.transform(blocks, total), lambda sums: joined(blocks, sums)))

    def joined(blocks: Column, sums: Column) -> Column:
        inside = lambda x, base: F.transform(x, lambda y, j: base + total(F.slice(x, 1, j)))
        each = F.transform(blocks, lambda x, b: bound(total(F.slice(sums, 1, b)), lambda base: inside(x, base)))
        return F.flatten(each)

    return bound(values, lambda own: F.when(F.size(own) > 0, by_block(own)).otherwise(F.array().cast("array<int>")))


def ordered(spans: Column, kinds: tuple[str, ...]) -> Column:
    """By start, then by the place of the kind in ``kinds``, then by end."""
    place = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.array_position(place, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")
        ),
    )
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def digest(spans: Column, base: tuple[str, ...]) -> Column:
    """Lower-case hex SHA-256 of the written base spans."""
    own = F.filter(spans, lambda x: x["kind"].isin(*base))
    return F.sha2(written(own), 256)
