"""Quantiles of columns as numbers, exact whatever the number of distinct values.

Exact quantiles are selected in rounds, each one pass over all columns. A KLL sketch per column brackets every wanted rank.
Where a bracket holds few values, the next round counts them, and all below as one, and the rank's value is found by
running sums; else the values in it are counted, and only they go on. A round keeps about one value in 250. What
reaches the driver is one value per rank. No task ever holds all distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of approximate quantiles: relative error of at most its inverse.
ACCURACY = 1000
#: Size of the sketches that bracket exact ranks, and the half width of a bracket in ranks relative to all rows: their
#: errors stay below it in nearly all cases, and a bracket that misses its rank costs a round.
SKETCH, WIDTH = 4096, 0.002
#: Values, counted with their copies, that are sorted in one task.
SMALL = 1 << 16
#: Values of all columns together that one aggregate may hold, which then gives their quantiles in one pass.
DIRECT = 1 << 18
#: Bytes that Spark expects of a plan up to which the first pass makes no sketches; if it is wrong they take a pass of their own.
SMALL_PLAN = 1 << 22


@dataclass
class _Search:
    """The search for one order statistic of a column: ``rank`` counts from 0 among the ``rows`` values from low to high."""

    column: int
    rank: int
    rows: int
    low: float | None = None
    high: float | None = None
    found: float | None = None
    #: Values that a sketch puts around the rank, which is not counted from them yet.
    bracket: tuple[float, float] | None = None

    def inside(self, values: list[Column]) -> Column:
        return _between(values[self.column], self.low, self.high)


def _between(v: Column, low: float | None, high: float | None) -> Column:
    return v if low is None else F.when((v >= F.lit(low)) & (v <= F.lit(high)), v)


def _ends(v: Column, shares: Sequence[float]) -> Column:
    """The values around each share, two for each, by one sketch; null without values."""
    sketch = F.kll_sketch_agg_double(v, F.lit(SKETCH))
    at = [F.lit(float(e)) for x in shares for e in (max(0.0, x - WIDTH), min(1.0, x + WIDTH))]
    return F.when(F.count(v) > 0, F.array(*[F.kll_sketch_get_quantile_double(sketch, e) for e in at]))


def quantiles(df: DataFrame, values: Sequence[Column], shares: Sequence[float] | Sequence[Sequence[float]], approximate: bool = False) -> list[list[float] | None]:
    """For each of the double ``values`` its quantiles at ``shares``, by linear interpolation; None without values.

    ``shares`` are those of all values, or a list for each. Nulls don't count, and there must be no NaN. ``approximate``
    takes one pass with sketches instead.
    """
    return quantiles_beside(df, values, shares, [], approximate)[0]


def quantiles_beside(df: DataFrame, values: Sequence[Column], shares: Sequence[float] | Sequence[Sequence[float]], more: Sequence[Column], approximate: bool = False) -> tuple[list[list[float] | None], list]:
    """``quantiles``, and what the aggregates ``more`` give, which are part of the first pass.

    That pass counts the values and, unless the plan looks small, brackets every rank by one sketch per column. The second
    gives the quantiles of small tables, or finds the ranks among the values in their brackets; where those are many,
    rounds that keep ever fewer come before it.
    """
    if not values:
        return [], list(df.agg(*[m.alias(f"m{i}") for i, m in enumerate(more)]).first()) if more else []
    each = [list(s) for s in shares] if not isinstance(shares[0], float) else [list(shares)] * len(values)
    if approximate:
        ends = [F.percentile_approx(v, F.array(*map(F.lit, x)), F.lit(ACCURACY)) for v, x in zip(values, each)]
    elif df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SMALL_PLAN:
        ends = [F.lit(None)] * len(values)  # most likely there will be no use for them
    else:
        ends = [_ends(v, x) for v, x in zip(values, each)]
    wanted = [*map(F.count, values), *ends, *more]
    first = list(df.agg(*[w.alias(f"x{i}") for i, w in enumerate(wanted)]).first())
    counts, brackets, beside = first[: len(values)], first[len(values) : 2 * len(values)], first[2 * len(values) :]
    if approximate:
        return brackets, beside
    if sum(counts) <= DIRECT:
        wanted = [F.percentile(v, F.array(*map(F.lit, s))).alias(f"q{i}") for i, (v, s) in enumerate(zip(values, each))]
        return list(df.agg(*wanted).first()), beside
    found = {}
    for i, n in enumerate(counts):
        for j, x in enumerate(each[i] if n else []):
            for k in (math.floor(x * (n - 1)), math.ceil(x * (n - 1))):
                found[i, k] = _Search(i, k, n, bracket=brackets[i] and (brackets[i][2 * j], brackets[i][2 * j + 1]))
    # What a bracket is expected to hold decides whether its values are looked at or counted first.
    small = lambda w: w.rows * (2 * WIDTH if w.bracket else 1) <= SMALL
    while open_ := [w for w in found.values() if w.found is None]:
        if large := [w for w in open_ if not small(w)]:
            _narrow(df, list(values), large)
        else:
            _look(df, list(values), open_)
    out: list[list[float] | None] = []
    for i, n in enumerate(counts):
        at = [s * (n - 1) for s in each[i]]
        ranks = [(found[i, math.floor(x)].found, found[i, math.ceil(x)].found) for x in at] if n else []
        out.append([a if a == b else a + (b - a) * (x - math.floor(x)) for x, (a, b) in zip(at, ranks)] if n else None)
    return out, beside


def _narrow(df: DataFrame, values: list[Column], searches: list[_Search]) -> None:
    """One round: a bracket around each rank, and where the rank lies in it."""
    asked = [w for w in searches if w.bracket is None]
    if asked:
        row = df.agg(*[_ends(w.inside(values), [w.rank / (w.rows - 1)]).alias(f"b{j}") for j, w in enumerate(asked)]).first()
        for w, ends in zip(asked, row):
            w.bracket = tuple(ends)
    ends = [w.bracket for w in searches]
    for w in searches:
        w.bracket = None
    counts = []
    for j, w in enumerate(searches):
        v, (low, high) = w.inside(values), ends[j]
        counts += [F.count_if(v < F.lit(low)).alias(f"below{j}"), F.count_if((v >= F.lit(low)) & (v <= F.lit(high))).alias(f"inside{j}")]
    row = df.agg(*counts).first()
    for j, w in enumerate(searches):
        (low, high), below, inside = ends[j], row[f"below{j}"], row[f"inside{j}"]
        if low == high and below <= w.rank < below + inside:
            w.found = low
        elif below <= w.rank < below + inside and inside < w.rows:
            w.low, w.high, w.rank, w.rows = low, high, w.rank - below, inside
        else:
            # The sketch missed the rank or took in all: halve the range of values instead.
            _halve(df, values, w)


def _halve(df: DataFrame, values: list[Column], w: _Search) -> None:
    v = w.inside(values)
    ends = df.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    middle = ends["low"] / 2 + ends["high"] / 2
    if not ends["low"] <= middle < ends["high"]:
        middle = ends["low"]
    row = df.agg(F.count_if(v <= F.lit(middle)).alias("under"), F.max(F.when(v <= F.lit(middle), v)).alias("last"), F.min(F.when(v > F.lit(middle), v)).alias("next")).first()
    if w.rank < row["under"]:
        w.low, w.high, w.rows = ends["low"], row["last"], row["under"]
    else:
        w.low, w.high, w.rank, w.rows = row["next"], ends["high"], w.rank - row["under"], w.rows - row["under"]
    if w.low == w.high:
        w.found = w.low


def _look(df: DataFrame, values: list[Column], searches: list[_Search]) -> None:
    """The last round: the few values left of all searches, counted and sorted; ranks that a sketch's bracket misses stay open."""
    # Ranks of one bracket share its values. Where they count from all values, those below the bracket are one group.
    brackets: dict[tuple, list[_Search]] = {}
    for w in searches:
        brackets.setdefault((w.column, *(w.bracket or (w.low, w.high)), w.bracket is not None), []).append(w)
    groups, cells = list(brackets.values()), []
    for j, (column, low, high, below) in enumerate(brackets):
        v = groups[j][0].inside(values)
        kept, shown = (v <= F.lit(high), F.when(v >= F.lit(low), v)) if below else (v.isNotNull(), v)
        cells.append(F.struct(F.lit(j).alias("j"), kept.alias("kept"), shown.alias("v")))
    counted = df.select(F.inline(F.array(*cells))).filter("kept").groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.create_map(*[x for j, g in enumerate(groups) for x in (F.lit(j), F.array(*[F.lit(w.rank) for w in g]))])
    hit = F.exists(ranks[F.col("j")], lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    found = counted.withColumn("upto", upto).filter(hit & F.col("v").isNotNull()).collect()
    for w in searches:
        w.bracket = None
    for r in found:
        for w in groups[r.j]:
            if r.upto - r.n <= w.rank < r.upto:
                w.found = r.v
    # A rank that its bracket misses halves its values.
    for w in searches:
        if w.found is None:
            _halve(df, values, w)
