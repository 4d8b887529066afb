import pytest

from siltworks.operators import dates, formats


def read(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    out = formats.apply_formats(df, [{"column": "d", "action": "to_date"}], date_formats="infer", **more)
    return [None if r.d is None else r.d.isoformat() for r in out.orderBy("i").collect()]


def test_the_column_decides_the_order_of_day_and_month(spark):
    assert read(spark, ["03/04/2020", "13/04/2020"]) == ["2020-04-03", "2020-04-13"]
    assert read(spark, ["03/04/2020", "04/13/2020"]) == ["2020-03-04", "2020-04-13"]
    # Other separators are other columns, so to say; equal readings are no question.
    assert read(spark, ["03/04/2020", "04/13/2020", "03-04-2020", "13-04-2020"]) == ["2020-03-04", "2020-04-13", "2020-04-03", "2020-04-13"]
    assert read(spark, ["05/05/2020"]) == ["2020-05-05"]
    assert read(spark, ["13/04/2020", "04/14/2020"]) == ["2020-04-13", "2020-04-14"]


def test_open_questions_raise_with_counts(spark):
    with pytest.raises(ValueError, match="2 dates with slashes .* 0 are with the day first, 0 "):
        read(spark, ["03/04/2020", "05/06/2020", "7/7/2020"])
    with pytest.raises(ValueError, match="1 dates with slashes .* 1 are with the day first, 2 "):
        read(spark, ["03/04/2020", "13/04/2020", "04/14/2020", "04/15/2020"])


def test_shapes(spark):
    texts = ["2020-02-29", " 2020-2-9T10:11:12.5Z\t", "2020-02-09 10:11", "2020/02/09", "20200209", "9.2.2020", "9 Feb 2020", "9 february 2020", "FEB. 9, 2020", "February 9, 2020 10:11:12 +02:00", None]
    assert read(spark, texts) == ["2020-02-29", *["2020-02-09"] * 9, None]
    assert read(spark, ["2021-02-29", "x", "", "12", "9 Foo 2020", "2020-02-01"], on_error="null") == [None] * 5 + ["2020-02-01"]
    with pytest.raises(ValueError, match="2 values of d are no dates, such as '2021-02-29', 'x'"):
        read(spark, ["2021-02-29", "x", "2020-02-01"])
    assert dates.date_formats(spark.createDataFrame([], "d string"), "d") == {}


def test_examples_and_numbers(spark):
    df = spark.createDataFrame([(t,) for t in ["\t7 ", "1e400", "x", "x", "b", "c", "d", "e", "f", None, "1,5"]], "v string")
    out = formats.apply_formats(df, [{"column": "v", "action": "to_numeric"}], on_error="null").collect()
    assert [r.v for r in out] == [7.0, *[None] * 9, 1.5]
    with pytest.raises(ValueError, match="8 values of v are no numbers, such as '1e400', 'b', 'c', 'd', 'e'"):
        formats.apply_formats(df, [{"column": "v", "action": "to_numeric"}])
    shown = formats.format_examples(df, [{"column": "v", "action": "to_numeric"}], limit=2)
    assert sorted(tuple(r) for r in shown.collect()) == [("v", "to_numeric", "1e400", 1), ("v", "to_numeric", "b", 1)]
    assert formats.format_examples(df, []).count() == 0
