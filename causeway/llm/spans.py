"""Spans of regular expressions with code-point offsets, by built-in functions only, in time linear in a text's matches.

The matches of a pattern and the gaps between them, which a split by the same pattern gives, add up to the text, so that running sums
of their lengths give every start and end. Running values of an array are made block by block, so that appending to an array never
copies more than a block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that ``running`` appends one by one.
BLOCK = 64
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


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


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, found: Column, pattern: str) -> Column:
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def placed(found: Column, between: Column, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches ``found`` with the gaps ``between``; empty without matches."""

    def spans(m: Column, g: Column) -> Column:
        ends = running(F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), x.alias("value"))))

    return F.when(F.size(found) > 0, let(found, lambda m: let(between, lambda g: spans(m, g)))).otherwise(F.array().cast(f"array<{SPAN}>"))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def touching(base: Column, others: Column) -> Column:
    """array<struct<kind, span>> of the spans ``others``, by start: the kind of a span of ``base`` that overlaps it, or null.

    Of several, that which reaches furthest of those that start before it, or else the first that starts in it. One sort and two
    passes over all spans.
    """
    return let(base, lambda b: let(others, lambda o: _touching(b, o)))


def _touching(base: Column, others: Column) -> Column:
    none = F.lit(None).cast("struct<at:bigint,kind:int>")
    alone = lambda o: F.struct(F.lit(None).cast("int").alias("kind"), o.alias("span"))

    def judged(all_: Column) -> Column:
        is_base = lambda x: x["span"].isNull()
        point = lambda x, at: F.when(is_base(x), F.struct(x[at].alias("at"), x["kind"].alias("kind"))).otherwise(none)
        reach = running(F.transform(all_, lambda x: point(x, "end")), none, lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(all_, lambda x: point(x, "start"))), none, lambda a, b: F.coalesce(b, a)))
        pick = lambda r, n, x: F.when(r["at"] > x["start"], r["kind"]).when(n["at"] < x["end"], n["kind"])
        kinds = let(reach, lambda r: let(after, lambda n: F.transform(all_, lambda x, i: F.struct(pick(F.get(r, i), F.get(n, i), x).alias("kind"), x["span"].alias("span")))))
        return F.filter(kinds, lambda x: x["span"].isNotNull())

    first = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("order"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(F.lit(False), F.get(others, F.lit(0))).alias("span")))
    second = F.transform(others, lambda o: F.struct(o["start"].alias("start"), F.lit(1).alias("order"), F.lit(None).cast("int").alias("kind"), o["end"].alias("end"), o.alias("span")))
    both = F.array_sort(F.concat(first, second))
    return F.when(F.size(others) == 0, F.transform(others, alone)).when(F.size(base) == 0, F.transform(others, alone)).otherwise(let(both, judged))


def with_spans(df, text: str, patterns: tuple[str, ...], valid, keep: list[str]):
    """``keep`` columns of ``df`` with ``base``: the valid spans of all patterns. ``valid(kind, value)`` tells which matches count."""
    found = df.select(*keep, text, *[all_matches(F.col(text), p).alias(f"__m{i}") for i, p in enumerate(patterns)])
    cut = found.select(*keep, text, *[f"__m{i}" for i in range(len(patterns))], *[gaps(F.col(text), F.col(f"__m{i}"), p).alias(f"__g{i}") for i, p in enumerate(patterns)])

    def of_kind(i: int) -> Column:
        return F.filter(placed(F.col(f"__m{i}"), F.col(f"__g{i}"), i), lambda s: valid(i, s["value"]))

    kinds = [of_kind(i) for i in range(len(patterns))]
    return cut.select(*dict.fromkeys([*keep, text]), reduce(lambda a, b: F.concat(a, b), kinds).alias("base"))
