import math

import pytest
from pyspark.sql import types as T

from siltworks.operators import outliers, profile


def rows(df, *names):
    return [tuple(r[n] for n in (names or df.columns)) for r in df.collect()]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "a double, b string")


@pytest.fixture
def nan(spark):
    return spark.createDataFrame([(math.nan,), (1.0,), (2.0,), (None,)], "a double")


def test_empty_table(empty):
    assert rows(profile.completeness_mean(empty)) == [(0.0,)]
    assert rows(profile.completeness_by_column(empty)) == []
    assert rows(profile.histogram(empty, "a")) == []
    assert rows(profile.top_values(empty, "b")) == []
    assert rows(profile.distribution(empty, "b")) == []
    assert sorted(rows(profile.missing_analysis(empty))) == [("a", "double", 0, 0.0, 0, 0), ("b", "string", 0, 0.0, 0, 0)]
    for method in outliers.METHODS:
        assert rows(outliers.outlier_overview(empty, method=method)) == [("a", 0, 0.0)]
        assert rows(outliers.outlier_bounds(empty, method=method)) == [("a", None, None)]


def test_nan_is_missing(nan):
    assert rows(profile.completeness_by_column(nan)) == [("a", 4, 2, 50.0)]
    assert rows(profile.missing_analysis(nan)) == [("a", "double", 2, 50.0, 2, 2)]
    assert rows(profile.distinct_by_column(nan)) == [("a", 3, 75.0)]
    assert rows(outliers.boxplot_stats(nan, "a")) == [(1.0, 1.25, 1.5, 1.75, 2.0)]
    assert sum(r.n for r in profile.histogram(nan, "a").collect()) == 2


def test_distinct_counts_null_once(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, v int")
    assert rows(profile.distinct_by_column(df).filter("column_name = 'k'")) == [("k", 3, 60.0)]
    assert rows(profile.distinct_by_column(df, approximate=True).filter("column_name = 'k'")) == [("k", 3, 60.0)]
    assert rows(profile.duplicate_metrics(df).filter("column_name = 'k'")) == [("k", 2, 4, 80.0)]
    assert len(rows(profile.duplicate_rows(df, ["k"]))) == 4
    assert sorted(rows(profile.duplicate_key_groups(df, ["k"])), key=str) == [("a", 2), (None, 2)]
    assert rows(profile.duplicate_top_values(df, "k")) == [(None, 2, 40.0), ("a", 2, 40.0)]


def test_histogram_ends(spark):
    df = spark.createDataFrame([(0.0,), (15.0,), (30.0,)], "a double")
    assert sorted(rows(profile.histogram(df, "a"))) == [(0, 0.0, 1), (15, 15.0, 1), (29, 29.0, 1)]


def test_histogram_constant_and_missing(spark):
    assert rows(profile.histogram(spark.createDataFrame([(5,)] * 3, "a int"), "a")) == [(0, 5.0, 3)]
    assert rows(profile.histogram(spark.createDataFrame([(None,), (None,)], "a double"), "a")) == [(None, None, 2)]


def test_histogram_of_small_integers(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "a bigint, b tinyint")
    for c in "ab":
        assert sum(r.n for r in profile.histogram(df, c).collect()) == 10


def test_distribution_switch(spark):
    df = spark.createDataFrame([(str(i % 7),) for i in range(30)], "a string")
    assert len(rows(profile.distribution(df, "a", max_bars=7))) == 7
    out = dict(rows(profile.distribution(df, "a", max_bars=6, top_k=2, other="rest")))
    assert out == {"0": 5, "1": 5, "rest": 20}


def test_pages(spark):
    df = spark.range(25).selectExpr("id", "if(id % 2 = 0, id, null) as v")
    assert profile.page_count(df, 10) == 3
    assert len(rows(profile.completeness_by_row(df, "id", "key", page=99, page_size=10))) == 5
    assert rows(profile.completeness_by_row(df, "id", "asc", page_size=1)) == [(1, 50.0)]
    assert len(rows(profile.completeness_by_row(df, "id", page=-3, page_size=10))) == 10
    with pytest.raises(ValueError):
        profile.completeness_by_row(df, "id", "sideways")


def test_missing_preview_of_numbers(spark):
    df = spark.range(100).selectExpr("cast(id as double) as a")
    assert len(rows(profile.missing_preview(df, "a"))) == 50


def test_nested_values_as_text(spark):
    schema = T.StructType([T.StructField("s", T.StructType([T.StructField("b", T.IntegerType())])), T.StructField("l", T.ArrayType(T.IntegerType()))])
    df = spark.createDataFrame([((1,), [1, 2]), ((1,), [3])], schema)
    assert sorted(rows(profile.distinct_by_column(df))) == [("l", 2, 100.0), ("s", 1, 50.0)]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "x")], "`a.b` double, `c d` string")
    assert sorted(rows(profile.completeness_by_column(df, order="asc"))) == [("a.b", 2, 1, 50.0), ("c d", 2, 2, 100.0)]
    assert rows(outliers.outlier_overview(df)) == [("a.b", 0, 0.0)]


def test_half_rounds_up(spark):
    df = spark.createDataFrame([(i,) for i in [1] + [2] * 799], "a int")
    assert (("1", 1, 0.13)) in rows(profile.top_values(df, "a"))


def test_approximate_bounds_are_near(spark):
    df = spark.range(10_001).selectExpr("cast(id as double) as a")
    exact, near = (rows(outliers.outlier_bounds(df, approximate=x))[0] for x in (False, True))
    assert near[1] == pytest.approx(exact[1], abs=60) and near[2] == pytest.approx(exact[2], abs=60)


def test_unknown_column_and_method(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="unknown column"):
        profile.histogram(df, "nope")
    with pytest.raises(ValueError, match="unknown method"):
        outliers.outlier_bounds(df, method="magic")
