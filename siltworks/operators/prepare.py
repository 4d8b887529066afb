"""Preparation for modelling: encodings, scalings, row norms, principal components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import as_text, col, dtype, is_numeric, missing, usable
from siltworks.functions.quantiles import quantiles

#: Categories that one-hot encoding turns into columns at most; more is an error, not a cut.
MAX_CATEGORIES = 1000


def categories(df: DataFrame, name: str, limit: int = MAX_CATEGORIES) -> list[str]:
    found = [r.v for r in df.select(as_text(df, name).alias("v")).filter("v is not null").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{name} has more than {limit} values")
    return sorted(found)


def one_hot(df: DataFrame, name: str, values: list[str] | None = None) -> DataFrame:
    """A column ``<name>_<value>`` of 0 and 1 per value in place of the column; missing is 0 in all."""
    text = as_text(df, name)
    values = categories(df, name) if values is None else values
    marks = [F.when(text == v, 1).otherwise(0).alias(f"{name}_{v}") for v in values]
    return df.select(*[col(c) for c in df.columns if c != name], *marks)


def ordinal(df: DataFrame, name: str, values: list[str] | None = None) -> DataFrame:
    """The place of each value in ``values`` (default: sorted), from 0; missing and others are null."""
    text = as_text(df, name)
    values = categories(df, name) if values is None else values
    place = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), text)
    new = F.when(place > 0, place - 1).cast("int")
    return df.select(*[new.alias(c) if c == name else col(c) for c in df.columns])


def numbers(df: DataFrame, names: list[str]) -> list[Column]:
    for c in names:
        if not is_numeric(dtype(df, c)):
            raise ValueError(f"not a numeric column: {c}")
    return [usable(df, c).cast("double") for c in names]


def scaled(df: DataFrame, names: list[str], stats: list[tuple[float | None, float | None]]) -> DataFrame:
    """(x - center) / spread in place; a spread of 0 gives 0. Missing is null."""
    place = dict(zip(names, zip(numbers(df, names), stats)))

    def scale(c: str) -> Column:
        x, (center, spread) = place[c]
        return ((x - F.lit(center)) / F.lit(spread) if spread else x - x).alias(c)

    return df.select(*[scale(c) if c in place else col(c) for c in df.columns])


def _by_aggregates(df: DataFrame, names: list[str], center, spread) -> DataFrame:
    """Scale by two aggregates per column, all of them in one pass when called."""
    row = df.agg(*[x.alias(f"s{i}{k}") for i, v in enumerate(numbers(df, names)) for k, x in enumerate((center(v), spread(v)))]).first() if names else ()
    return scaled(df, names, list(zip(row[::2], row[1::2])))


def scale_standard(df: DataFrame, names: list[str]) -> DataFrame:
    return _by_aggregates(df, names, F.avg, F.stddev_pop)


def scale_minmax(df: DataFrame, names: list[str]) -> DataFrame:
    return _by_aggregates(df, names, F.min, lambda v: F.max(v) - F.min(v))


def scale_robust(df: DataFrame, names: list[str], approximate: bool = False) -> DataFrame:
    """By median and interquartile range; ``approximate`` takes sketches."""
    found = quantiles(df, numbers(df, names), [0.25, 0.5, 0.75], approximate)
    return scaled(df, names, [(q[1], q[2] - q[0]) if q else (None, None) for q in found])


def normalize_l2(df: DataFrame, names: list[str]) -> DataFrame:
    """Each row's values divided by their Euclidean norm; a norm of 0 leaves 0; a missing value makes the row's null."""
    v = {c: usable(df, c).cast("double") for c in names}
    norm = F.sqrt(sum((x * x for x in v.values()), F.lit(0.0)))
    return df.select(*[F.when(norm > 0, v[c] / norm).otherwise(v[c]).alias(c) if c in v else col(c) for c in df.columns])


def _moments(whole: DataFrame, names: list[str]) -> tuple[list[float], list[list[float]]]:
    """Means and covariances as one aggregate of len(names)^2 / 2 sums."""
    v = [col(c).cast("double") for c in names]
    pairs = [(i, j) for i in range(len(v)) for j in range(i + 1)]
    row = whole.agg(*[F.avg(x) for x in v], *[F.covar_pop(v[i], v[j]) for i, j in pairs]).first()
    cov = [[0.0] * len(v) for _ in v]
    for (i, j), x in zip(pairs, row[len(v) :]):
        cov[i][j] = cov[j][i] = x
    return list(row[: len(v)]), cov


def _wide_moments(whole: DataFrame, names: list[str]) -> tuple[list[float], list[list[float]]]:
    """The same for many columns: each task adds up the products of its centred rows in blocks of an Arrow batch, one row per column; rows of tasks are summed by column."""
    v = [col(c).cast("double") for c in names]
    first = whole.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"a{i}") for i, x in enumerate(v)]).first()
    n, means, width = first[0], list(first[1:]), len(v)
    if not n:
        return means, []

    def products(batches):
        import numpy as np
        import pyarrow as pa

        center, total = np.array(means), np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - center
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    def added(key, table):
        import numpy as np
        import pyarrow as pa

        sums = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([list(np.asarray(sums))], pa.list_(pa.float64()))})

    parts = whole.select(F.array(*v).alias("x")).mapInArrow(products, "i int, sums array<double>")
    rows = parts.groupBy("i").applyInArrow(added, "i int, sums array<double>").collect()
    return means, [[x / n for x in r.sums] for r in sorted(rows, key=lambda r: r.i)]


#: Columns up to which covariances are aggregates of their own.
NARROW = 32


def pca(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """Columns pc1 ... pck beside the others: projections of centred rows on the principal components.

    Rows with a missing value drop out. The sign of a component is such that its largest weight is positive. Only the
    covariances reach the driver; of more than NARROW columns they are summed over Arrow batches, so that plans stay short.
    """
    import numpy as np

    numbers(df, names)
    if not 1 <= k <= len(names):
        raise ValueError("k must be from 1 to the number of columns")
    gone = [missing(df, c) for c in names]
    whole = df.filter(~(F.greatest(*gone) if len(gone) > 1 else gone[0]))
    means, cov = _moments(whole, names) if len(names) <= NARROW else _wide_moments(whole, names)
    if means[0] is None:
        raise ValueError("no row without missing values")
    vectors = np.linalg.eigh(np.array(cov))[1][:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    row = F.array(*[col(c).cast("double") for c in names])

    def projected(p: int) -> Column:
        if len(names) <= NARROW:
            return sum(((col(c).cast("double") - F.lit(m)) * F.lit(float(w)) for c, m, w in zip(names, means, vectors[:, p])), F.lit(0.0))
        weights = F.array(*[F.lit(float(w)) for w in vectors[:, p]])
        offset = float(sum(m * w for m, w in zip(means, vectors[:, p])))
        return F.aggregate(F.zip_with(row, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) - F.lit(offset)

    return whole.select(*[col(c) for c in df.columns if c not in names], *[projected(p).alias(f"pc{p + 1}") for p in range(k)])
