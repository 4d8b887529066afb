"""Stretches of an order, values carried along it, and rows by rank, without a sort of the whole table."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.columns import TEMPORAL, col, dtype, free_names, is_numeric, usable

#: Stretches that an order is cut into.
STRETCHES = 200
#: Rows that one task may hold as the first or the last ones of an order.
TOP_ROWS = 100_000
#: Rows of one key that are put in order by one task.
KEY_ROWS = 1_000_000


def _position(df: DataFrame, name: str) -> Column | None:
    """The order column as a double, to cut its range into stretches; None for types without one."""
    kind = dtype(df, name)
    if is_numeric(kind):
        return usable(df, name).cast("double")
    return F.unix_micros(col(name).cast("timestamp")).cast("double") if isinstance(kind, TEMPORAL) else None


def stretch_of(df: DataFrame, name: str) -> Column:
    """The number of the stretch of the order that a row is in, by at most STRETCHES - 1 cuts; nulls come first.

    Cuts of numbers and times are quantiles by a sketch; those of other types are values of a sample of fixed size.
    Equal values are in one stretch.
    """
    position = _position(df, name)
    if position is None:
        position = col(name)
        turn, out = free_names(df, "turn", "value")
        some = df.select(position.alias(out), F.xxhash64(position).alias(turn)).filter(F.col(out).isNotNull()).distinct().orderBy(turn).limit(20 * STRETCHES)
        found = sorted(r[0] for r in some.select(out).collect())
        cuts = found[:: max(1, len(found) // STRETCHES)][1:]
    else:
        shares = F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)])
        cuts = sorted(set(df.agg(F.percentile_approx(position, shares, F.lit(10_000))).first()[0] or []))
    if not cuts:
        return F.when(position.isNull(), -1).otherwise(0)
    # Two short searches instead of one long one: chunks of cuts that end at or before the value, then cuts of the next.
    size = math.ceil(math.sqrt(len(cuts)))
    chunks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    upto = lambda some: F.size(F.filter(some, lambda c: c <= position))
    number = upto(F.array(*[F.lit(c[-1]) for c in chunks]))
    none = F.slice(F.array(F.lit(cuts[0])), 1, 0)
    return F.when(position.isNull(), -1).otherwise(number * size + upto(F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks], none), number)))


def _with_stretches(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns that number the stretches of the order by ``names``: of the first one, and within values that many rows share, of the next."""
    made = []
    for i, name in enumerate(names):
        (stretch,) = free_names(df, f"stretch{i}")
        if not made:
            df = df.withColumn(stretch, stretch_of(df, name))
        else:
            # A value that very many rows share is a cut, so it is the least of its stretch; its rows are cut by the next
            # column, and the stretch's other rows come after them. The value comes as text, which casts back to it.
            least = F.min(F.struct(*[x for c in names[:i] for x in (col(c).isNotNull().alias(f"s{c}"), col(c).alias(c))]))
            values = [least.getField(c).cast("string").alias(f"v{j}") for j, c in enumerate(names[:i])]
            counts = df.groupBy(*made).agg(F.count(F.lit(1)).alias("n"), *values).collect()
            large = [r for r in counts if r["n"] > 4 * sum(c["n"] for c in counts) / STRETCHES and r["n"] > TOP_ROWS]
            if not large:
                break
            at = lambda r: [F.col(m) == r[m] for m in made] + [col(c).eqNullSafe(F.lit(r[f"v{j}"]).cast(dtype(df, c))) for j, c in enumerate(names[:i])]
            hot = reduce(Column.__or__, [reduce(Column.__and__, at(r)) for r in large])
            df = df.withColumn(stretch, F.when(hot, stretch_of(df.filter(hot), name)).otherwise(2 * STRETCHES))
        made.append(stretch)
    return df, made


def carried(df: DataFrame, what: Column, order_by: list[str], partition_by: list[str], sides: tuple[bool, ...], out: list[str]) -> DataFrame:
    """Add to each row the last (side True) or next (False) non-null ``what`` in order, its own included, as the columns ``out``.

    The order is ascending, nulls first, within the rows of equal ``partition_by``. Keys of at most KEY_ROWS rows are put in
    order by a task each. Beyond, and without keys, the order is cut into stretches; each stretch of a key is ordered alone,
    and what is missing at its end comes from the nearest other stretch of the key that has it, found among as many rows as
    there are stretches. So neither a whole table nor a key that holds much of it is ever one task.
    """
    keys = [col(c) for c in partition_by]
    upward, downward = [col(c).asc_nulls_first() for c in order_by], [col(c).desc_nulls_last() for c in order_by]
    along = lambda keys, side, last: Window.partitionBy(*keys).orderBy(*(upward if side else downward)).rowsBetween(Window.unboundedPreceding, last)
    if keys:
        (size,) = free_names(df, "size")
        largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)).agg(F.max(size)).first()[0] or 0
        if largest <= KEY_ROWS:
            return df.select("*", *[F.last(what, ignorenulls=True).over(along(keys, side, 0)).alias(o) for side, o in zip(sides, out)])
    placed, stretches = _with_stretches(df, order_by)
    names = free_names(placed, *[f"end{i}" for i in range(len(sides))], *[f"key{i}" for i in range(len(keys))], *[f"at{i}" for i in range(len(stretches))])
    ends, key_names, places = names[: len(sides)], names[len(sides) : len(sides) + len(keys)], names[len(sides) + len(keys) :]
    # The outermost value of each stretch, in order: an aggregate with partial results.
    at = F.struct(*[F.struct(col(c).isNotNull(), col(c)) for c in order_by])
    there = F.when(what.isNotNull(), at)
    outermost = [(F.max_by if side else F.min_by)(F.when(what.isNotNull(), what), there).alias(e) for side, e in zip(sides, ends)]
    groups = placed.groupBy(*[k.alias(n) for k, n in zip(keys, key_names)], *[F.col(s).alias(p) for s, p in zip(stretches, places)]).agg(*outermost)
    by_place = lambda side: Window.partitionBy(*key_names).orderBy(*[F.col(p).asc() if side else F.col(p).desc() for p in places]).rowsBetween(Window.unboundedPreceding, -1)
    others = groups.select(*key_names, *places, *[F.last(e, ignorenulls=True).over(by_place(side)).alias(e) for side, e in zip(sides, ends)])
    same = reduce(Column.__and__, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, key_names)] + [F.col(s) == F.col(p) for s, p in zip(stretches, places)])
    own = free_names(placed, *[f"own{i}" for i in range(len(sides))])
    near = placed.select("*", *[F.last(what, ignorenulls=True).over(along([*keys, *map(F.col, stretches)], side, 0)).alias(o) for side, o in zip(sides, own)])
    # Without keys there are as many rows as stretches.
    joined = near.join(others if keys else F.broadcast(others), same, "left")
    return joined.select(*[col(c) for c in df.columns], *[F.coalesce(a, e).alias(o) for a, e, o in zip(own, ends, out)])


def interpolated(df: DataFrame, name: str, known: Column, where: Column, order_by: list[str], partition_by: list[str]) -> DataFrame:
    """``name`` as double, where asked for on the line between the last and the next ``known`` value of its key in order.

    The line runs over the first order column, a number or a time. Between values at one place it is level. Without a known
    value on both sides, or where the place is null, the result is null.
    """
    for c in [*order_by, *partition_by]:
        dtype(df, c)
    position = _position(df, order_by[0])
    if position is None:
        raise ValueError(f"no line runs over {order_by[0]} of type {dtype(df, order_by[0]).simpleString()}")
    before, after = free_names(df, "before", "after")
    point = F.when(known.isNotNull() & position.isNotNull(), F.struct(known.cast("double").alias("v"), position.alias("x")))
    df = carried(df, point, order_by, partition_by, (True, False), [before, after])
    a, b = F.col(before), F.col(after)
    width = b["x"] - a["x"]
    line = F.when(width == 0, a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * ((position - a["x"]) / width))
    value = F.when(where, F.when(position.isNotNull(), line)).otherwise(col(name).cast("double"))
    return df.select(*[value.alias(c) if c == name else col(c) for c in df.columns if c not in (before, after)])


def rows_by_rank(df: DataFrame, name: str, n: int, first: int, last: int) -> DataFrame:
    """Of the ``n`` rows in ascending order of a column (nulls first) those from rank ``first`` up to ``last``, sorted.

    Ranks near either end are a top-k. Others are found in rounds: stretches of the order are counted, and only the
    rows of those that hold the ranks go on. Rows of equal values are in the order of a hash of their columns where there are
    many rows, so that one value may hold them all; else in any.
    """
    last, columns = min(last, n), df.columns
    order = [name]
    if last > TOP_ROWS and n - first > TOP_ROWS:
        (turn,) = free_names(df, "turn")
        hashed = [col(f.name) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        df, order = df.withColumn(turn, F.xxhash64(*hashed)), [name, turn]
    while last > TOP_ROWS and n - first > TOP_ROWS:
        dealt, made = _with_stretches(df, order)
        counts = sorted(tuple(r) for r in dealt.groupBy(*made).agg(F.count(F.lit(1)).alias("rows")).collect())
        below, held, kept = 0, 0, []
        for *number, rows in counts:
            if below + held + rows <= first:
                below += rows
            elif below + held < last:
                held += rows
                kept.append(number)
        if held == n:
            break  # equal rows, which are the same in any order
        place = F.struct(*made)
        end = lambda numbers: F.struct(*[F.lit(x).alias(m) for x, m in zip(numbers, made)])
        df = dealt.filter((place >= end(kept[0])) & (place <= end(kept[-1]))).drop(*made)
        n, first, last = held, first - below, last - below
    size, along = max(0, last - first), [col(c).asc_nulls_first() for c in order]
    if last <= n - first:
        return df.orderBy(*along).offset(first).limit(size).select(*map(col, columns))
    back = df.orderBy(*[col(c).desc_nulls_last() for c in order]).offset(n - last).limit(size)
    return back.orderBy(*along).select(*map(col, columns))
