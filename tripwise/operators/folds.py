"""Folds over sorted lists as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose outputs a fold gathers before they join the others, so long lists are copied seldom.
STRETCH = 512


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def stepped(items: Column, state: Column, step, out: str) -> Column:
    """A fold over a list: struct(state, out) of the last state and all outputs, in order.

    step(state, item) gives struct(state, emitted); emitted is a list of type `out`.
    """
    none = F.expr(f"cast(array() as {out})")

    def one(held: Column, item: Column) -> Column:
        return bound(
            step(held["state"], item),
            lambda r: F.struct(r["state"].alias("state"), F.when(F.size(r["emitted"]) > 0, F.concat(held["out"], r["emitted"])).otherwise(held["out"]).alias("out")),
        )

    def over(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(STRETCH))
        return F.aggregate(
            F.transform(starts, lambda i: F.slice(xs, i, STRETCH)),
            F.struct(state.alias("state"), none.alias("out")),
            lambda held, part: bound(
                F.aggregate(part, F.struct(held["state"].alias("state"), none.alias("out")), one),
                lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], r["out"]).alias("out")),
            ),
        )

    return bound(items, over)
