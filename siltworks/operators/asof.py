"""As-of joins: to each row the last row of another table at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import col, dtype
from siltworks.functions.order import carried


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[tuple[str, str]] = (), ties: list[str] = (), prefix: str = "right_", tolerance=None) -> DataFrame:
    """The columns of ``left``, and after ``prefix`` those of the last row of ``right`` at or before it; null without any.

    Rows meet where the pairs of columns ``by`` are equal; a null key, or a null place in the order, meets nothing. Of rows
    of ``right`` at one place the last one by the columns ``ties`` counts. ``tolerance``, a column or number of the order's
    kind that is added to the right row's place, leaves out what lies further back.

    Both tables are put in one order and the right rows are carried along it, over stretches with a carried row where a key
    has very many rows: no pair of rows is made but those of the result.
    """
    pairs = [(f"k{i}", a, b) for i, (a, b) in enumerate(by)]
    kind = dtype(right, right_on)
    rows = F.struct(*[col(c) for c in left.columns])
    others = F.struct(*[col(c) for c in right.columns])
    tied = [f"t{i}" for i in range(len(ties))]
    l = left.select(*[col(a).alias(k) for k, a, _ in pairs], col(left_on).cast(kind).alias("at"), F.lit(1).alias("side"), *[F.lit(None).cast(dtype(right, t)).alias(n) for n, t in zip(tied, ties)], rows.alias("row"))  # noqa: E741
    r = right.select(*[col(b).cast(dtype(left, a)).alias(k) for k, a, b in pairs], col(right_on).alias("at"), F.lit(0).alias("side"), *[col(t).alias(n) for n, t in zip(tied, ties)], others.alias("other"))
    for c in ["at", *[k for k, _, _ in pairs]]:
        r = r.filter(F.col(c).isNotNull())
    both = l.unionByName(r, allowMissingColumns=True)
    there = F.when(F.col("side") == 0, F.struct(F.col("at").alias("place"), F.col("other").alias("row")))
    met = carried(both, there, ["at", "side", *tied], [k for k, _, _ in pairs], (True,), ["met"]).filter("side = 1")
    good = F.col("at").isNotNull() & F.col("met").isNotNull()
    if tolerance is not None:
        good = good & (F.col("at") <= F.col("met.place") + tolerance)
    found = F.when(good, F.col("met.row"))
    return met.select(*[F.col("row").getField(c).alias(c) for c in left.columns], *[found.getField(c).alias(prefix + c) for c in right.columns])
