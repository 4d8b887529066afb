"""Profiles that merge: sketches of parts of the data are stored, and united later without reading the data again; heavy hitters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import as_text, col, dtype, is_numeric, present, usable
from siltworks.operators.profile import top_values

#: Logarithm of a distinct sketch's size: its standard error is 1.04 / 2^(LOG / 2), 0.8 %.
DISTINCT_LOG = 14
#: Size of a quantile sketch: ranks are off by at most a quarter of a percent of all values, nearly always.
QUANTILE_SIZE = 2048
#: Values that a heavy-hitter summary keeps, and those of them that are counted for each one asked for.
TRACKED, SPARE = 10_000, 4
#: A summary of DataSketches misses no value of a share above this, over the size of its map.
_MISS = 3.5


def sketch_columns(df: DataFrame, names: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """A row for each part of the data, named by the columns ``by``, and each column: what of it can be united later.

    column_name, n_rows, n_present, low and high (of numbers), distincts and ranks (sketches; no ranks of other types). One
    pass. Parts that are written once need no second look: append the rows of new parts, or replace those of changed ones.
    """
    names = [c for c in df.columns if c not in by] if names is None else names
    wanted, rows = [], []
    for i, c in enumerate(names):
        number = usable(df, c).cast("double") if is_numeric(dtype(df, c)) else None
        none = F.lit(None).cast("double")
        wanted += [F.count_if(present(df, c)).alias(f"n{i}"), F.hll_sketch_agg(as_text(df, c), F.lit(DISTINCT_LOG)).alias(f"d{i}")]
        wanted += [(none if number is None else F.min(number)).alias(f"l{i}"), (none if number is None else F.max(number)).alias(f"h{i}")]
        wanted.append((F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE))).alias(f"r{i}"))
        parts = zip(("n_present", "distincts", "low", "high", "ranks"), "ndlhr")
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), *[F.col(f"{x}{i}").alias(n) for n, x in parts]))
    wide = df.groupBy(*[col(c) for c in by]).agg(F.count(F.lit(1)).alias("n_rows"), *wanted).filter("n_rows > 0")
    return wide.select(*[col(c) for c in by], F.inline(F.array(*rows)))


def unite_profiles(sketches: DataFrame, shares: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column_name, n_rows, n_present, n_distinct, low, high, quantiles (at ``shares``) of all parts together.

    Counts and ends are exact, n_distinct is within 2.4 % and the quantiles' ranks within 0.25 % in nearly all cases.
    Quantiles are null where there are no numbers. No parts give no rows.
    """
    ranks = F.kll_merge_agg_double("ranks")
    merged = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("n_present"), F.hll_sketch_estimate(F.hll_union_agg("distincts")).alias("n_distinct"),
        F.min("low").alias("low"), F.max("high").alias("high"), ranks.alias("ranks"),
    )
    found = F.array(*[F.kll_sketch_get_quantile_double("ranks", F.lit(float(s))) for s in shares])
    return merged.select("column_name", "n_rows", "n_present", "n_distinct", "low", "high", F.when(F.col("low").isNotNull(), found).alias("quantiles"))


def heavy_hitters(df: DataFrame, name: str, k: int = 50, tracked: int = TRACKED) -> DataFrame:
    """value, n, pct of the ``k`` most frequent values, as ``profile.top_values`` gives them, without shuffling all values.

    One pass keeps a bounded summary and names candidates; a second counts those exactly, by a join with at most SPARE * k
    rows. A value that the summary does not name occurs no more often than its bound says. Where that does not settle the
    last place, because the values are too even, all values are counted after all.
    """
    # A null is a value, too; a mark tells it from the empty text.
    marked = df.select(F.coalesce(F.concat(F.lit("="), as_text(df, name)), F.lit("")).alias("v"))
    kept = max(tracked, SPARE * k)
    row = marked.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(v, {SPARE * k}, {kept})").alias("top")).first()
    if not row["rows"]:
        return top_values(df, name, k)
    error = _MISS / (1 << (int(kept / 0.75) - 1).bit_length()) * row["rows"]
    unseen = error + (row["top"][-1]["count"] if len(row["top"]) == SPARE * k else 0)
    spark = df.sparkSession
    candidates = spark.createDataFrame([(t["item"],) for t in row["top"]], "v string")
    found = marked.join(F.broadcast(candidates), "v").groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    ranked = sorted((r.n for r in found), reverse=True)
    if sum(ranked) < row["rows"] and (len(ranked) < k or ranked[k - 1] <= unseen):
        return top_values(df, name, k)
    values = spark.createDataFrame([(r.v[1:] if r.v else None, r.n) for r in found], "value string, n long")
    return values.select("value", "n", F.round(F.col("n") * 100.0 / F.lit(row["rows"]), 2).alias("pct")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)
