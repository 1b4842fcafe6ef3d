"""Running values and cuts of arrays, by built-in functions, in time linear in the array.

Running values are made block by block, so that appending to an array never copies more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that ``running`` appends one by one.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it, also within functions of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``items``: ``op`` over it and all before it. ``op`` is associative, and ``zero``, of the items' type, changes nothing.

    Each block is folded, the folds are added up, and each block then starts from what stands before it: what a step copies is a
    block, or one value a block.
    """
    grown = lambda first, of: F.aggregate(of, F.array(first), lambda s, x: F.concat(s, F.array(op(F.element_at(s, -1), x))))

    def states(blocks: Column) -> Column:
        before = grown(zero, F.transform(blocks, lambda b: F.aggregate(b, zero, op)))
        return let(before, lambda s: F.flatten(F.transform(blocks, lambda b, k: F.slice(grown(F.get(s, k), b), 2, BLOCK))))

    def cut(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(x, k * BLOCK + 1, BLOCK))
        return F.when(F.size(x) > 0, let(blocks, states)).otherwise(F.slice(F.array(zero), 1, 0))

    return let(items, cut)


def cut_at(items: Column, is_cut: Callable[[Column, Column], Column]) -> Column:
    """array<array>: the stretches of ``items`` between elements for which ``is_cut(element, place)`` holds; an empty array is one stretch."""

    def pieces(x: Column) -> Column:
        places = F.transform(F.filter(F.transform(x, lambda e, i: F.struct(i.alias("i"), is_cut(e, i).alias("c"))), lambda e: e["c"]), lambda e: e["i"])
        ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(x)))
        return let(ends, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda k: F.slice(x, F.get(b, k) + 2, F.get(b, k + 1) - F.get(b, k) - 1)))

    return let(items, pieces)
