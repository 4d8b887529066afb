"""What a treatment changed, cell by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.columns import as_text, col, dtype, is_numeric, usable

#: Kinds of change. Those of rows have no column.
KINDS = ("nulled", "filled", "changed", "row gone", "row new", "repeated key")


def _comparable(before: DataFrame, after: DataFrame, name: str) -> tuple[Column, Column]:
    """Values of a column that can be told apart: numbers as double where the type changed, texts for other types."""
    a, b = dtype(before, name), dtype(after, name)
    if a == b:
        return usable(before, name), usable(after, name)
    if is_numeric(a) and is_numeric(b):
        return usable(before, name).cast("double"), usable(after, name).cast("double")
    return as_text(before, name), as_text(after, name)


def _changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """key, column_name, kind, old, new of each change; both frames meet in one shuffle."""
    names = [c for c in before.columns if c in after.columns and c not in keys]
    values = {c: _comparable(before, after, c) for c in names}
    side = lambda df, i, n: df.select(F.struct(*[col(k).alias(k) for k in keys]).alias("key"), F.lit(i).alias("side"), F.struct(*[values[c][i].alias(f"v{j}") for j, c in enumerate(names)], F.lit(0).alias("there")).alias("row"))
    both = side(before, 0, names).unionByName(side(after, 1, names))
    of = lambda i: F.col("side") == i
    met = both.groupBy("key").agg(*[F.first(F.when(of(i), F.col("row")), ignorenulls=True).alias(f"r{i}") for i in (0, 1)], *[F.count_if(of(i)).alias(f"n{i}") for i in (0, 1)])
    text = lambda c: c.cast("string")
    change = lambda column, kind, old, new: F.struct(F.lit(column).cast("string").alias("column_name"), kind.alias("kind"), old.alias("old"), new.alias("new"))
    none = F.lit(None).cast("string")
    row_kind = F.when((F.col("n0") > 1) | (F.col("n1") > 1), "repeated key").when(F.col("n1") == 0, "row gone").when(F.col("n0") == 0, "row new")
    cells = []
    for j, c in enumerate(names):
        a, b = F.col(f"r0.v{j}"), F.col(f"r1.v{j}")
        kind = F.when(row_kind.isNull() & ~a.eqNullSafe(b), F.when(b.isNull(), "nulled").when(a.isNull(), "filled").otherwise("changed"))
        cells.append(change(c, kind, text(a), text(b)))
    return met.select("key", F.inline(F.array(change(None, row_kind, none, none), *cells))).filter("kind is not null")


def cell_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """column_name, kind, n: the changes from one frame to another, whose rows are told by ``keys``, by column and kind.

    Kinds: nulled, filled, changed; without a column row gone, row new, and repeated key (one that several rows of a frame
    have, which are not compared). NaN in a floating column is missing. Columns of one frame only are left out. Keys compare
    null-safely. A column whose type changed is compared as numbers, or as text.
    """
    return _changes(before, after, keys).groupBy("column_name", "kind").agg(F.count(F.lit(1)).alias("n"))


def change_examples(before: DataFrame, after: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """The key columns, column_name, kind, old, new (as text) of the first ``limit`` changes by key of each column and kind."""
    turn = F.row_number().over(Window.partitionBy("column_name", "kind").orderBy("key"))
    first = _changes(before, after, keys).withColumn("turn", turn).filter(F.col("turn") <= limit)
    return first.select(*[F.col("key").getField(k).alias(k) for k in keys], "column_name", "kind", "old", "new")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``after`` with a change in a cell, or that are new."""
    some = _changes(before, after, keys).filter("kind in ('nulled', 'filled', 'changed', 'row new')").select("key").distinct()
    same = reduce(Column.__and__, [col(k).eqNullSafe(F.col("key").getField(k)) for k in keys])
    return after.join(some, same, "left_semi")
