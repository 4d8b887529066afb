"""Values carried along an order, lines between them, and statistics that rules share."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.functions import order
from siltworks.operators import missing, outliers, profile
from siltworks.plans.pipeline import Pipeline


def line(rows):
    """Values of (x, v) rows in order, None filled between neighbours that are there."""
    out = []
    for i, (x, v) in enumerate(rows):
        before = next(((a, b) for a, b in reversed(rows[: i + 1]) if b is not None and a is not None), None)
        after = next(((a, b) for a, b in rows[i:] if b is not None and a is not None), None)
        if v is not None:
            out.append(v)
        elif x is None or not before or not after:
            out.append(None)
        else:
            (a, b), (c, d) = before, after
            out.append(b if a == c else b + (d - b) * ((x - a) / (c - a)))
    return out


@pytest.mark.parametrize("key_rows", [10**6, 50])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_interpolation(spark, monkeypatch, keys, key_rows):
    """A key with a third of the rows, a null one, gaps at both ends, ties and nulls in the order; by plain windows and by stretches."""
    monkeypatch.setattr(order, "KEY_ROWS", key_rows)
    rng = random.Random(8)
    rows = []
    for i in range(900):
        x = None if rng.random() < 0.02 else rng.choice([i, i, 400])
        rows.append((rng.choice(["hot", "hot", None, "b", "c", "d"]), x, i, rng.uniform(0, 9) if rng.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "k string, x long, n long, v double").repartition(5)
    out = missing.apply_missing(df, [{"column": "v", "action": "interpolate"}], order_by=["x", "n"], partition_by=keys)
    assert out.columns == df.columns
    found = {r.n: r.v for r in out.collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0] if keys else 0, []).append(r)
    for group in groups.values():
        for r, want in zip(group, line([(r[1], r[3]) for r in group])):
            assert found[r[2]] == pytest.approx(want), r


def test_interpolation_over_time_and_odd_columns(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) as t, if(id in (0, 2, 3, 9), null, cast(id * id as int)) as `v.x`, 'k' as before from range(10)")
    out = missing.apply_missing(df, [{"column": "v.x", "action": "interpolate"}], order_by="t")
    assert [r[1] for r in out.orderBy("t").collect()] == [None, 1.0, 6.0, 11.0, 16.0, 25.0, 36.0, 49.0, 64.0, None]
    assert out.columns == df.columns
    assert missing.apply_missing(df.limit(0), [{"column": "v.x", "action": "interpolate"}], order_by="t").count() == 0
    with pytest.raises(ValueError, match="no line"):
        missing.apply_missing(df, [{"column": "v.x", "action": "interpolate"}], order_by="before")
    for rules in ([{"column": "before", "action": "interpolate"}], [{"column": "v.x", "action": "interpolate"}]):
        with pytest.raises(ValueError):
            missing.apply_missing(df, rules)


def test_outliers_on_the_line(spark):
    df = spark.range(100).selectExpr("id", "case when id = 50 then 9999D when id = 0 then -9999D when id = 70 then null else cast(id as double) end as v")
    out = {r.id: r.v for r in outliers.apply_outliers(df, [{"column": "v", "method": "iqr", "action": "interpolate"}], order_by="id").collect()}
    assert (out[50], out[0], out[70], out[3]) == (50.0, None, None, 3.0)
    with pytest.raises(ValueError, match="order_by"):
        outliers.apply_outliers(df, [{"column": "v", "method": "iqr", "action": "interpolate"}])


def test_a_hot_order_value_is_cut_by_the_next_column(spark, monkeypatch):
    """Two thirds of all rows share the first order value: no stretch holds them all."""
    monkeypatch.setattr(order, "TOP_ROWS", 100)
    df = spark.range(6000).selectExpr("if(id % 3 = 0, id, -1) as x", "id", "if(id % 10 = 0, cast(id as double), null) as v")
    placed, stretches = order._with_stretches(df, ["x", "id"])
    assert len(stretches) == 2 and placed.groupBy(*stretches).count().agg(F.max("count")).first()[0] < 200
    out = {r.id: r.v for r in missing.apply_missing(df, [{"column": "v", "action": "ffill"}], order_by=["x", "id"]).collect()}
    last = None
    for x, i in sorted((i if i % 3 == 0 else -1, i) for i in range(6000)):
        last = float(i) if i % 10 == 0 else last
        assert out[i] == last


def jobs_of(spark, action):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    before = set(tracker.getJobIdsForGroup("counted"))
    action()
    spark.sparkContext._jsc.clearJobGroup()
    return len(set(tracker.getJobIdsForGroup("counted")) - before)


def test_rules_of_different_columns_share_their_passes(spark):
    names = [f"v{i}" for i in range(10)]
    df = spark.range(20_000).select("id", *[(F.abs(F.xxhash64("id", F.lit(i))) % 10_000 / 7.0).alias(c) for i, c in enumerate(names)])
    rules = [{"column": c, "method": m, "action": "median"} for c, m in zip(names, ["mad"] * 10)]
    assert jobs_of(spark, lambda: outliers.apply_outliers(df, rules).count()) <= 12
    alone = df
    for r in rules:
        alone = outliers.apply_outliers(alone, [r])
    both = outliers.apply_outliers(df, rules)
    assert both.exceptAll(alone).count() == 0 and both.columns == alone.columns
    # A rule that drops rows comes before the statistics of the next.
    rules = [{"column": "v0", "method": "z", "z_threshold": 1.0, "action": "drop"}, {"column": "v1", "method": "iqr", "iqr_k": 0.2, "action": "mean"}, {"column": "v1", "method": "mad", "action": "flag"}]
    alone = df
    for r in rules:
        alone = outliers.apply_outliers(alone, [r])
    assert outliers.apply_outliers(df, rules).exceptAll(alone).count() == 0
    fills = [{"column": c, "action": a} for c, a in zip(names, ["mean", "median"] * 5)]
    gaps = df.select("id", *[F.when(F.col("id") % (i + 2) != 0, F.col(c)).alias(c) for i, c in enumerate(names)])
    alone = gaps
    for r in fills:
        alone = missing.apply_missing(alone, [r])
    assert missing.apply_missing(gaps, fills).exceptAll(alone).count() == 0
    assert jobs_of(spark, lambda: missing.apply_missing(gaps, fills).count()) <= 8


@pytest.mark.parametrize("plan", [0, 1 << 40])
def test_exact_quantiles_of_large_columns(spark, monkeypatch, plan):
    from siltworks.functions import quantiles

    monkeypatch.setattr(quantiles, "DIRECT", 100)
    monkeypatch.setattr(quantiles, "SMALL", 50)
    monkeypatch.setattr(quantiles, "SMALL_PLAN", plan)
    df = spark.range(30_000).select((F.abs(F.xxhash64("id")) % 5000).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 7.0).alias("b"), F.lit(None).cast("double").alias("c"))
    found, more = quantiles.quantiles_beside(df, [F.col("a"), F.col("b"), F.col("c")], [[0.1, 0.5], [0.5], [0.5]], [F.count(F.lit(1))])
    a = [r[0] for r in df.select(F.percentile("a", F.array(F.lit(0.1), F.lit(0.5)))).collect()][0]
    assert found == [pytest.approx(a), [7.0], None] and more == [30_000]


def test_infinities(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (None,), (float("nan"),)], "v double")
    assert sorted(tuple(r) for r in profile.histogram(df, "v", 2).collect()) == [(0, 1.0, 1), (1, 1.5, 1)]
    assert [tuple(r) for r in outliers.outlier_bounds(df, ["v"], "z").collect()] == [("v", None, None)]


def test_names_of_flags_and_written_steps(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)] + [(99, 500.0)], "i int, v double").withColumn("IS_OUTLIER_v", F.lit("old"))
    out = outliers.apply_outliers(df, [{"column": "v", "method": "iqr", "action": "flag"}])
    assert out.columns == ["i", "v", "is_outlier_v"] and out.agg(F.sum("is_outlier_v")).first()[0] == 1
    p = Pipeline().with_step("missing_values", [{"column": "v", "action": "median"}]).with_step("duplicates", [{"columns": ["v"], "action": "first"}]).with_step("outliers", [{"column": "v", "method": "iqr", "action": "cap"}])
    df = df.drop("IS_OUTLIER_v")
    assert p.apply(df, order_by="i", written=True).exceptAll(p.apply(df, order_by="i")).count() == 0


@pytest.mark.parametrize("hot", [0.0, 0.7, 1.0])
def test_pages_inside_a_hot_value(spark, monkeypatch, hot):
    """Pages of an order where one value holds most rows, or all: each row is on one page, and no page sorts them all."""
    monkeypatch.setattr(order, "TOP_ROWS", 300)
    df = spark.range(4000).select("id", F.when(F.col("id") % 1000 < 1000 * hot, 5).otherwise(F.col("id") % 997).alias("v"), F.lit("x").alias("turn"))
    seen, last = [], None
    for first in range(0, 4000, 800):
        page = order.rows_by_rank(df, "v", 4000, first, first + 800).collect()
        assert len(page) == 800 and [r.v for r in page] == sorted(r.v for r in page) and (last is None or page[0].v >= last)
        seen += [r.id for r in page]
        last = page[-1].v
    assert sorted(seen) == list(range(4000))
    equal = spark.range(2000).select(F.lit(1).alias("v"))
    assert order.rows_by_rank(equal, "v", 2000, 900, 1100).count() == 200
