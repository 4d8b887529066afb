"""Profiles of a dataset: completeness, distributions, distinct values, duplicates.

All operators are lazy and take one pass whatever the number of columns: either one wide aggregate that is then
turned into rows, or one unpivot into (column, value) cells that are grouped once with partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.columns import as_text, col, dtype, free_names, is_numeric, missing, present, usable
from siltworks.functions.order import rows_by_rank


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part * F.lit(100.0) / F.greatest(whole, F.lit(1)), 2)


def _rows_of(structs: list[Column]) -> Column:
    """One row per struct; the structs' fields as columns."""
    return F.inline(F.array(*structs))


def completeness_mean(df: DataFrame) -> DataFrame:
    """mean_pct: present cells in percent of all cells; 0.0 without rows or columns."""
    cells = sum((F.when(present(df, c), 1).otherwise(0) for c in df.columns), F.lit(0))
    share = F.sum(cells) * F.lit(100.0) / (F.count(F.lit(1)) * max(1, len(df.columns)))
    return df.agg(F.when(F.count(F.lit(1)) > 0, share).otherwise(F.lit(0.0)).alias("mean_pct"))


def completeness_by_column(df: DataFrame, order: str | None = None) -> DataFrame:
    """column_name, n_rows, n_present, pct of each column; no rows for an empty dataset.

    ``order`` asc or desc sorts by pct, then name.
    """
    counts = [F.count(F.when(present(df, c), 1)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *counts).filter("n > 0")
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_present")) for i, c in enumerate(df.columns)]
    out = wide.select(_rows_of(rows)).withColumn("pct", F.col("n_present") * F.lit(100.0) / F.col("n_rows"))
    if order not in (None, "asc", "desc"):
        raise ValueError(f"order must be asc, desc or None, not {order}")
    return out if order is None else out.orderBy(F.col("pct").asc() if order == "asc" else F.col("pct").desc(), "column_name")


def completeness_by_row(df: DataFrame, row_key: str, order: str = "desc", page: int = 0, page_size: int = 1000) -> DataFrame:
    """row_key, pct of one page of rows, ordered by pct then key (asc, desc) or by key alone (key).

    Pages beyond the last give the last one, negative ones the first. The first page is a top-k. For others rows are
    counted by pct, which has as many values as there are columns, and the page's ranks are looked up among the rows
    of its one or few values: neither a global window nor a top-k of all earlier pages.
    """
    dtype(df, row_key)
    if order not in ("asc", "desc", "key"):
        raise ValueError(f"order must be one of ['asc', 'desc', 'key'], not {order}")
    cells = sum((F.when(present(df, c), 1).otherwise(0) for c in df.columns), F.lit(0))
    rows = df.select(col(row_key).alias("row_key"), F.round(cells * F.lit(100.0) / len(df.columns), 2).alias("pct"))
    orders = {"asc": ["pct", "row_key"], "desc": [F.desc("pct"), "row_key"], "key": ["row_key"]}[order]
    if page <= 0:
        return rows.orderBy(*orders).limit(page_size)
    if order == "key":
        groups = [(None, df.count())]
    else:
        groups = sorted(((r.pct, r.n) for r in rows.groupBy("pct").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=order == "desc")
    total = sum(n for _, n in groups)
    first = min(page, max(0, -(-total // page_size) - 1)) * page_size
    parts, before = [], 0
    for pct, n in groups:
        low, high = max(0, first - before), min(n, first + page_size - before)
        if low < high:
            parts.append(rows_by_rank(rows if pct is None else rows.filter(F.col("pct") == pct), "row_key", n, low, high))
        before += n
    return reduce(DataFrame.unionByName, parts).orderBy(*orders) if parts else rows.limit(0)


def page_count(df: DataFrame, page_size: int = 1000) -> int:
    return max(1, -(-df.count() // page_size))


def _cell_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (text), n over all columns: one unpivot, one grouping with partial sums."""
    names = columns or df.columns
    cells = [F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in names]
    return df.select(_rows_of(cells)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_by_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_name, n_distinct (missing is one value), pct of rows. ``approximate`` takes sketches instead of a shuffle."""
    if approximate:
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[(F.approx_count_distinct(as_text(df, c)) + F.coalesce(F.max(missing(df, c).cast("int")), F.lit(0))).alias(f"c{i}") for i, c in enumerate(df.columns)])
        rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").cast("long").alias("n_distinct"), _percent(F.col(f"c{i}"), F.col("n")).alias("pct")) for i, c in enumerate(df.columns)]
        return wide.select(_rows_of(rows))
    out = _cell_counts(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("total"))
    return out.select("column_name", "n_distinct", _percent(F.col("n_distinct"), F.col("total")).alias("pct"))


def duplicate_metrics(df: DataFrame) -> DataFrame:
    """column_name, n_values seen twice or more (missing is a value), n_rows that hold them, pct of all rows."""
    twice = F.col("n") >= 2
    out = _cell_counts(df).groupBy("column_name").agg(F.count_if(twice).alias("n_values"), F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("n_rows"), F.sum("n").alias("total"))
    return out.select("column_name", "n_values", "n_rows", _percent(F.col("n_rows"), F.col("total")).alias("pct"))


def missing_analysis(df: DataFrame) -> DataFrame:
    """column_name, dtype, missing_count, missing_ratio (percent), non_missing_count, unique_count (without missing)."""
    gone = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    out = _cell_counts(df).groupBy("column_name").agg(gone.alias("missing_count"), F.sum("n").alias("total"), F.count("value").alias("unique_count"))
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("name")) for c in df.columns]))
    names = df.sparkSession.range(1).select(rows)  # columns of an empty dataset are listed too
    out = F.broadcast(names).join(out, F.col("name") == F.col("column_name"), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        F.col("name").alias("column_name"), kinds[F.col("name")].alias("dtype"), number("missing_count").alias("missing_count"), _percent(number("missing_count"), number("total")).alias("missing_ratio"),
        (number("total") - number("missing_count")).alias("non_missing_count"), number("unique_count").alias("unique_count"),
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """value (text, missing as null), n."""
    return df.select(as_text(df, name).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, name: str, k: int = 50, min_count: int = 1) -> DataFrame:
    """value, n, pct of all rows for the k most frequent values with at least ``min_count`` rows; ties by value."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    top = value_counts(df, name).filter(F.col("n") >= min_count).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)
    return top.crossJoin(F.broadcast(total)).select("value", "n", _percent(F.col("n"), F.col("total")).alias("pct"))


def duplicate_top_values(df: DataFrame, name: str, k: int = 50) -> DataFrame:
    return top_values(df, name, k, min_count=2)


def duplicate_rows(df: DataFrame, keys: list[str], limit: int | None = 100, order_by: list[str] | None = None) -> DataFrame:
    """Rows whose key occurs more than once (null keys are equal), at most ``limit`` of them, in ``order_by`` if given.

    Keys are counted with partial sums and joined back, so a hot key is spread by skew-join handling.
    """
    if not keys:
        raise ValueError("keys must name a column")
    for c in [*keys, *(order_by or [])]:
        dtype(df, c)
    names = free_names(df, *[f"key{i}" for i in range(len(keys))])
    groups = df.groupBy(*[col(c).alias(k) for c, k in zip(keys, names)]).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select(*names)
    same = [col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, names)]
    out = df.join(groups, same, "left_semi")
    if order_by:
        out = out.orderBy(*[col(c) for c in order_by])
    return out if limit is None else out.limit(limit)


def duplicate_key_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns and n of the keys that occur more than once."""
    return df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """bucket, x (its lower end), n of equal-width buckets that hold values; the last one is closed.

    A constant column gives one bucket at its value, an all-missing one a row of null bucket and x. Missing
    values are in no bucket otherwise, and infinite ones never.
    """
    if not is_numeric(dtype(df, name)):
        raise ValueError(f"histogram needs a numeric column: {name}")
    if bins < 1:
        raise ValueError("bins must be positive")
    v = F.when(F.abs(usable(df, name).cast("double")) < F.lit(float("inf")), usable(df, name).cast("double"))
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / w), F.lit(bins - 1))).when(F.col("v").isNotNull(), 0)
    rows = df.select(v.alias("v")).crossJoin(F.broadcast(ends)).filter("v is not null or lo is null")
    out = rows.select(bucket.cast("int").alias("bucket"), "lo", w.alias("w")).groupBy("bucket", "lo", "w").agg(F.count(F.lit(1)).alias("n"))
    return out.select("bucket", (F.col("bucket") * F.col("w") + F.col("lo")).alias("x"), "n")


def distribution(df: DataFrame, name: str, max_bars: int = 2000, top_k: int = 50, other: str = "Autres") -> DataFrame:
    """value, n: all values if there are at most ``max_bars``, else the ``top_k`` and the sum of the rest as ``other``.

    A top-k of max_bars + 1 rows shows which case it is; only those go on, in one row, to which the rest is added.
    """
    order = [F.desc("n"), F.asc_nulls_first("value")]
    top = value_counts(df, name).orderBy(*order).limit(max_bars + 1)
    place, bars = F.row_number().over(Window.orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy())
    shown = top.withColumns({"place": place, "bars": bars}).filter((F.col("bars") <= max_bars) | (F.col("place") <= top_k))
    row = shown.agg(F.collect_list(F.struct("value", "n")).alias("all"), F.sum("n").alias("seen"))
    row = row.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    rest = F.struct(F.lit(other).alias("value"), (F.col("total") - F.col("seen")).alias("n"))
    return row.select(F.inline(F.when(F.col("total") > F.col("seen"), F.array_append("all", rest)).otherwise(F.col("all"))))


def profile_distribution(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """label, n: the histogram of a numeric column (label: lower end as text), the distribution of any other."""
    if is_numeric(dtype(df, name)):
        return histogram(df, name, bins).select(F.col("x").cast("string").alias("label"), "n")
    return distribution(df, name).select(F.col("value").alias("label"), "n")


def distributions(df: DataFrame, names: list[str], bins: int = 30, max_bars: int = 2000, top_k: int = 50, other: str = "Autres") -> DataFrame:
    """column_name, label, n of several columns: the histogram of a numeric one, the distribution of any other.

    Two passes whatever the number of columns: one for the ends of all histograms, one that groups the cells of all
    columns, numbers by bucket and others by value.
    """
    if not names:
        raise ValueError("names must hold a column")
    numbers = [c for c in dict.fromkeys(names) if is_numeric(dtype(df, c))]
    value = {c: usable(df, c).cast("double") for c in numbers}
    ends = df.agg(*[x for c in numbers for x in (F.min(value[c]), F.max(value[c]))]).first() if numbers else ()
    labels = {}
    for i, c in enumerate(numbers):
        low, high = ends[2 * i], ends[2 * i + 1]
        width = None if low is None else (high - low) / bins
        at = F.floor((value[c] - F.lit(low)) / F.lit(width)) if width else F.lit(0)
        start = F.least(at, F.lit(bins - 1)) * F.lit(width) + F.lit(low) if low is not None else F.lit(None).cast("double")
        labels[c] = F.when(value[c].isNotNull() | F.lit(low is None), F.struct(start.cast("string").alias("label")))
    # A missing value of a column of text is a label of its own, one of a column of numbers is none.
    cells = [F.struct(F.lit(c).alias("column_name"), labels[c] if c in labels else F.struct(as_text(df, c).alias("label"))) for c in dict.fromkeys(names)]
    cells = [x.cast("struct<column_name:string,cell:struct<label:string>>") for x in cells]
    counted = df.select(_rows_of(cells)).filter("cell is not null").groupBy("column_name", F.col("cell.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    texts = [c for c in dict.fromkeys(names) if c not in labels]
    if not texts:
        return counted
    # Columns of more values than there may be bars are few; each has its own top-k.
    many = {r.column_name for r in counted.filter(F.col("column_name").isin(texts)).groupBy("column_name").agg(F.count(F.lit(1)).alias("bars")).filter(F.col("bars") > max_bars).collect()}
    parts = [counted.filter(~F.col("column_name").isin(sorted(many)))] if many else [counted]
    for c in sorted(many):
        parts.append(distribution(df, c, max_bars, top_k, other).select(F.lit(c).alias("column_name"), F.col("value").alias("label"), "n"))
    return reduce(DataFrame.unionByName, parts)


def missing_preview(df: DataFrame, name: str) -> DataFrame:
    """label, n as shown beside a missing-value treatment: 50 or 60 bins by size, or the top 50 with missing as <NA>."""
    if is_numeric(dtype(df, name)):
        return profile_distribution(df, name, bins=50 if df.limit(5000).count() < 5000 else 60)
    return top_values(df, name, 50).select(F.coalesce("value", F.lit("<NA>")).alias("label"), "n")
