"""Running results over an array, and look-ups in a sorted one, inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.binding import let

# Elements that are folded with a growing array at a time: appending copies it.
BLOCK = 256


def scanned(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running merge of an array's elements, each one included.

    `merge` must be associative with `zero` as its neutral element. Blocks are
    merged on their own, then their results, and each block is gone through
    again from what comes before it, so an array costs little more than its
    length, however long it is.
    """

    def grown(items: Column, first: Column) -> Column:
        """`first` and every merge from it on; one element more than there are items."""
        return F.aggregate(
            items, F.array(first), lambda seen, x: F.concat(seen, F.array(merge(F.element_at(seen, -1), x)))
        )

    count = F.greatest(F.ceil(F.size(values) / F.lit(BLOCK)).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, merge))
        return let(grown(totals, zero), lambda before: F.flatten(F.transform(
            blocks, lambda block, b: F.slice(grown(block, F.get(before, b)), F.lit(2), F.size(block))
        )))

    return let(cut, over)


def count_below(ascending: Column, bound: Column, inclusive: bool = False) -> Column:
    """How many elements of an ascending array are less than `bound`, or equal to it: a binary search."""
    span = F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + 1)).cast("int"))

    def step(seen: Column, _: Column) -> Column:
        middle = F.floor((seen["low"] + seen["high"]) / 2).cast("int")
        value = F.get(ascending, middle)
        before = (value <= bound) if inclusive else (value < bound)
        return (
            F.when(seen["low"] >= seen["high"], seen)
            .when(before, F.struct((middle + 1).alias("low"), seen["high"].alias("high")))
            .otherwise(F.struct(seen["low"].alias("low"), middle.alias("high")))
        )

    return F.aggregate(steps, span, step, lambda seen: seen["low"])
