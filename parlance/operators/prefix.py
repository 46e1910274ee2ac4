"""Running values along sequences of any length: blocks run apart, and what came before a block is carried into it.

A window over a whole sequence is one task however long the sequence is. Here a sequence is cut into blocks of its order, a
block is the window, its total is one row, and a window over the totals gives each block its carry. Rows are shuffled once, by sequence
and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def block_of(order: Column, block_rows: int) -> Column:
    return F.floor(order / block_rows).cast("long")


def _sum(total: Column, carry: Column) -> Column:
    return F.coalesce(carry, F.lit(0)) + F.coalesce(total, F.lit(0))


_KINDS = {"sum": (F.sum, _sum), "count": (F.count, _sum), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with, for each name, the running sum, count, min or max of a value up to and with each row of its sequence.

    keys: the sequence; null keys are keys like others. order: a number without ties inside a sequence, about as dense as an ordinal, as a block is a
    stretch of `block_rows` of it. Null values are left out: a sum is 0 and a min or max null until there is one.
    """
    key, block, *own = fresh(df, "key", "block", *values, *(f"carry_{n}" for n in values))
    given, carries = own[: len(values)], own[len(values) :]
    inside = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({key: F.struct(*keys), block: block_of(F.col(order), block_rows), **{g: v for g, (_, v) in zip(given, values.values(), strict=True)}})
    kinds = [_KINDS[k] for k, _ in values.values()]
    again = [F.sum if f is F.count else f for f, _ in kinds]
    totals = rows.groupBy(key, block).agg(*(f(g).alias(g) for (f, _), g in zip(kinds, given, strict=True)))
    carried = totals.select(key, block, *(f(g).over(before).alias(c) for f, g, c in zip(again, given, carries, strict=True)))
    joined = rows.join(carried, [key, block])
    run = {n: join(f(g).over(inside), F.col(c)) for n, (f, join), g, c in zip(values, kinds, given, carries, strict=True)}
    return joined.select(*df.columns, *(v.alias(n) for n, v in run.items()))


def clamped(rows: DataFrame, key: str, order: list[str], start: str, length: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `start` and `end` of intervals of which none starts after the end of the one before it; start and length are longs.

    As end = min(start, end before) + length, the end is the sum of lengths so far plus the least of (start - lengths before), also where a block
    begins with a carry: two windows on longs. A null start is where the one before ends; a null length is 0.
    """
    names = fresh(rows, "key", "block", "length", "passed", "least", "total", "base", "carry")
    k, block, size, passed, least, total, base, carry = names
    given = rows.withColumns({k: F.struct(key), block: block_of(F.col(order[0]), block_rows), size: F.coalesce(F.col(length), F.lit(0))})
    inside = Window.partitionBy(k, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    room = F.col(start) - (F.col(passed) - F.col(size))
    given = given.withColumn(passed, F.sum(size).over(inside)).withColumn(least, F.min(room).over(inside))
    before = Window.partitionBy(k).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = given.groupBy(k, block).agg(F.sum(size).alias(total), F.min(least).alias(least))
    blocks = blocks.withColumn(base, F.coalesce(F.sum(total).over(before), F.lit(0)))
    blocks = blocks.select(k, block, (F.col(base) + F.min(F.col(least) - F.col(base)).over(before)).alias(carry))
    end = F.col(passed) + F.least(F.col(least), F.col(carry))
    others = [c for c in rows.columns if c not in (start, length, "end")]
    return given.join(blocks, [k, block]).select(*others, (end - F.col(size)).alias("start"), end.alias("end"))
