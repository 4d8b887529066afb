import math
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltworks.operators.duplicates import apply_duplicates
from siltworks.operators.formats import allowed_format_actions, apply_formats
from siltworks.operators.missing import allowed_missing_strategies, apply_missing, missing_counts
from siltworks.operators.normalise import normalize_markers
from siltworks.operators.outliers import apply_outliers, sample_fraction
from siltworks.plans.pipeline import Pipeline


def col(df, name):
    return [r[name] for r in df.collect()]


# Formats


def fmt(df, column, action, **more):
    return apply_formats(df, [{"column": column, "action": action}], **more)


def test_bad_number_is_named(spark):
    df = spark.createDataFrame([("1,5",), ("abc",), (None,)], "s string")
    with pytest.raises(ValueError, match="1 values of s are no numbers, such as 'abc'"):
        fmt(df, "s", "to_numeric")
    assert col(fmt(df, "s", "to_numeric", on_error="null"), "s") == [1.5, None, None]


def test_fraction_is_no_integer(spark):
    df = spark.createDataFrame([("1",), ("2,5",)], "s string")
    with pytest.raises(ValueError, match="1 values of s have a fraction"):
        fmt(df, "s", "to_integer")
    big = spark.createDataFrame([("9007199254740993",), ("1e3",), ("4.0",)], "s string")
    out = fmt(big, "s", "to_integer")
    assert col(out, "s") == [9007199254740993, 1000, 4] and out.schema["s"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("values", [["oui", "non", "1"], ["oui", "yes"], ["maybe", "no"], ["oui"]])
def test_not_a_boolean(spark, values):
    with pytest.raises(ValueError):
        fmt(spark.createDataFrame([(v,) for v in values], "s string"), "s", "to_boolean")


def test_boolean_words(spark):
    df = spark.createDataFrame([(" Vrai",), ("FAUX",), (None,)], "s string")
    assert col(fmt(df, "s", "to_boolean"), "s") == [True, False, None]
    assert col(fmt(spark.createDataFrame([(1.0,), (0.0,)], "s double"), "s", "to_boolean"), "s") == [True, False]


def test_dates(spark):
    df = spark.createDataFrame([(datetime(2024, 5, 6, 7, 8), "2024-05-06", "06/05/2024")], "t timestamp_ntz, s string, u string")
    assert col(fmt(df, "t", "to_date"), "t") == [date(2024, 5, 6)]
    assert col(fmt(df, "s", "to_date"), "s") == [date(2024, 5, 6)]
    with pytest.raises(ValueError):
        fmt(df, "u", "to_date")
    assert col(fmt(df, "u", "to_date", date_formats=("yyyy-MM-dd", "dd/MM/yyyy")), "u") == [date(2024, 5, 6)]
    with pytest.raises(ValueError):
        fmt(df, "t", "to_numeric")
    with pytest.raises(ValueError):
        fmt(spark.range(1), "id", "to_date")


@pytest.mark.parametrize("rule", [{"column": "s"}, {"action": "to_string"}, {"column": "s", "action": "to_moon"}, {"column": "x", "action": "to_string"}])
def test_bad_format_rules(spark, rule):
    with pytest.raises(ValueError):
        apply_formats(spark.createDataFrame([("1",)], "s string"), [rule])


def test_allowed(spark):
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], "s string, i int, b boolean, d date, n timestamp_ntz, a array<int>").schema}
    assert [len(allowed_format_actions(kinds[c])) for c in "sibdna"] == [5, 4, 2, 2, 2, 1]
    assert [len(allowed_missing_strategies(kinds[c])) for c in "sibdna"] == [5, 7, 5, 5, 5, 2]


# Missing values


def miss(df, column, action, value=None, **more):
    return apply_missing(df, [{"column": column, "action": action, "value": value}], **more)


def test_statistics_ignore_nan(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (3.0,), (None,)], "a double")
    assert col(miss(df, "a", "mean"), "a") == [2.0, 1.0, 3.0, 2.0]
    assert col(miss(df, "a", "median"), "a") == [2.0, 1.0, 3.0, 2.0]
    assert col(miss(df, "a", "drop_rows"), "a") == [1.0, 3.0]
    assert [tuple(r) for r in missing_counts(df).collect()] == [("a", 2)]


def test_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "b", "a", None, "c"]], "k string")
    assert col(miss(df, "k", "mode"), "k")[4] == "a"


def test_integers_widen_only_when_needed(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert miss(df, "a", "constant", "2").schema["a"].dataType.simpleString() == "int"
    assert col(miss(df, "a", "constant", "2,5"), "a") == [1.0, 2.5]
    assert col(miss(df, "a", "mean"), "a") == [1.0, 1.0]


def test_typed_constants(spark):
    df = spark.createDataFrame([(None, None, None)], "b boolean, d date, t timestamp_ntz")
    assert col(miss(df, "b", "constant", "Oui"), "b") == [True]
    assert col(miss(df, "d", "constant", "2024-01-02"), "d") == [date(2024, 1, 2)]
    assert col(miss(df, "t", "constant", "2024-01-02 03:04:05"), "t") == [datetime(2024, 1, 2, 3, 4, 5)]
    for c, bad in (("b", "maybe"), ("d", "soon"), ("t", "")):
        with pytest.raises(ValueError):
            miss(df, c, "constant", bad)


@pytest.mark.parametrize("action", ["mean", "median", "mode"])
def test_nothing_to_take(spark, action):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    with pytest.raises(ValueError):
        miss(df, "a", action)
    assert col(miss(df, "a", action, on_error="null"), "a") == [None, None]


@pytest.mark.parametrize("rule", [{"column": "s", "action": "mean"}, {"column": "s", "action": "constant"}, {"column": "s", "action": "ffill"}, {"column": "x", "action": "mode"}, {"column": "s", "action": "guess"}, {"column": "s"}])
def test_bad_missing_rules(spark, rule):
    with pytest.raises(ValueError):
        apply_missing(spark.createDataFrame([("1",)], "s string"), [rule])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=40), st.booleans())
def test_ordered_fill_matches_pandas(spark, values, text_order):
    import pandas as pd

    df = spark.createDataFrame([(i, f"{i:03}", v) for i, v in enumerate(values)], "i int, k string, v int")
    for action in ("ffill", "bfill"):
        out = {r.i: r.v for r in miss(df, "v", action, order_by="k" if text_order else "i").collect()}
        expected = getattr(pd.Series(values, dtype="Int64"), action)()
        assert [out[i] for i in range(len(values))] == [None if pd.isna(v) else v for v in expected]


# Duplicates


def test_first_last_none(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, v int")
    keep = lambda action, **more: sorted(col(apply_duplicates(df, [{"columns": ["k"], "action": action}], **more), "v"))
    assert keep("first", order_by="v") == [1, 3, 5]
    assert keep("last", order_by="v") == [2, 4, 5]
    assert keep("none") == [5]
    assert len(keep("first")) == 3
    with pytest.raises(ValueError):
        keep("last")
    with pytest.raises(ValueError):
        keep("some")
    with pytest.raises(ValueError):
        apply_duplicates(df, [{"columns": [], "action": "first"}])
    with pytest.raises(ValueError):
        apply_duplicates(df, [{"columns": ["x"], "action": "first"}])


# Outliers


def out(df, action, **rule):
    return apply_outliers(df, [{"column": "a", "method": "iqr", "action": action, **rule}])


@pytest.fixture
def spiky(spark):
    return spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]] + [(None,), (math.nan,)], "a double")


def test_treatments(spiky):
    assert len(col(out(spiky, "drop"), "a")) == 7
    assert sum(col(out(spiky, "flag"), "is_outlier_a")) == 1
    assert col(out(spiky, "median"), "a")[5] == 3.5
    assert col(out(spiky, "mean"), "a")[5] == pytest.approx(115 / 6)
    assert col(out(spiky, "constant", constant="7,5"), "a")[5] == 7.5
    assert col(out(spiky, "cap"), "a")[5] == 8.5
    assert col(out(spiky, "custom_cap", lower_bound=2, upper_bound=4), "a")[:6] == [2, 2, 3, 4, 4, 4]
    assert col(out(spiky, "cap"), "a")[6] is None


def test_no_spread_changes_nothing(spark):
    same = spark.createDataFrame([(5,)] * 3, "a int")
    assert col(out(same, "custom_cap", lower_bound=0, upper_bound=1), "a") == [5.0] * 3
    assert col(out(same, "flag"), "is_outlier_a") == [0] * 3
    nothing = spark.createDataFrame([(None,)], "a double")
    for method in ("iqr", "z", "mad"):
        assert col(apply_outliers(nothing, [{"column": "a", "method": method, "action": "median"}]), "a") == [None]


@pytest.mark.parametrize("rule", [{"action": "constant"}, {"action": "custom_cap", "lower_bound": 4, "upper_bound": 4}, {"action": "custom_cap", "lower_bound": 1}, {"action": "explode"}, {"action": "drop", "method": "guess"}, {"action": "constant", "constant": "x"}])
def test_bad_outlier_rules(spiky, rule):
    with pytest.raises(ValueError):
        apply_outliers(spiky, [{"column": "a", "method": "iqr", **rule}])


def test_outliers_need_numbers(spark):
    with pytest.raises(ValueError):
        out(spark.createDataFrame([("x",)], "a string"), "drop")
    with pytest.raises(ValueError):
        out(spark.createDataFrame([(1.0,)], "b double"), "drop")


def test_capping_to_fixed_bounds_settles(spiky):
    once = out(spiky, "custom_cap", lower_bound=2, upper_bound=4)
    assert col(out(once, "custom_cap", lower_bound=2, upper_bound=4), "a")[:6] == col(once, "a")[:6]


def test_zero_threshold_means_default(spiky):
    assert col(out(spiky, "cap", iqr_k=0), "a")[:6] == col(out(spiky, "cap"), "a")[:6]


def test_sample_fraction(spark):
    assert 0 < len(col(sample_fraction(spark.range(1000).selectExpr("cast(id as double) as a"), "a", n=100), "value")) <= 100


# Pipelines


def test_a_step_applied_again_moves_to_the_end():
    p = Pipeline().with_step("outliers", [{"column": "a"}]).with_step("missing", [{"column": "b", "action": "mode"}]).with_step("outliers", [{"column": "c"}])
    assert [n for n, _ in p.steps] == ["missing_values", "outliers"]
    assert p.rules("outliers") == [{"column": "c"}]
    assert p.without("missing").rules("missing_values") == []
    with pytest.raises(ValueError):
        p.with_step("magic", [])


def test_last_rule_of_a_column_counts():
    p = Pipeline().with_step("formats", [{"column": "a", "action": "to_string"}, {"column": "a", "action": "to_date"}])
    assert p.rules("formats") == [{"column": "a", "action": "to_date"}]
    d = Pipeline().with_step("duplicates", [{"columns": ["a"], "action": "first"}, {"columns": ["a"], "action": "none"}])
    assert len(d.rules("duplicates")) == 2


def test_json_round_trip(spark):
    p = Pipeline().with_step("missing", [{"column": "é", "action": "constant", "value": "ü"}])
    assert Pipeline.from_json(p.to_json()) == p
    assert p.describe(spark).collect()[0].parameters == '{"value": "ü"}'
    with pytest.raises(ValueError):
        Pipeline.from_json('[{"params": []}]')


def test_rules_see_what_rules_before_left(spark):
    df = spark.createDataFrame([("1",), ("3",), (None,)], "a string")
    p = Pipeline().with_step("formats", [{"column": "a", "action": "to_numeric"}]).with_step("missing_values", [{"column": "a", "action": "mean"}])
    assert col(p.apply(df), "a") == [1.0, 3.0, 2.0]


def test_markers_settle(spark):
    df = spark.createDataFrame([("  NA\t",), (' null ',), ("x ",), (None,), ("nano",)], "s string")
    once = normalize_markers(df)
    assert col(once, "s") == [None, None, "x ", None, "nano"]
    assert col(normalize_markers(once), "s") == col(once, "s")
