"""What keeps plans and tasks small: quantiles in rounds, rules of constant cost, hot keys, free names."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks.functions import quantiles as q
from siltworks.functions.columns import free_names
from siltworks.operators import missing, outliers, prepare, profile

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def expected(values):
    return [float(np.quantile(values, s)) for s in SHARES] if values else None


@pytest.mark.parametrize("small", [q.SMALL, 40])
def test_quantiles_of_several_columns(spark, monkeypatch, small):
    monkeypatch.setattr(q, "SMALL", small)
    monkeypatch.setattr(q, "DIRECT", 0 if small == 40 else q.DIRECT)
    monkeypatch.setattr(q, "SKETCH", 50)
    monkeypatch.setattr(q, "WIDTH", 0.05)
    rng = random.Random(3)
    columns = [
        [rng.gauss(0, 1) for _ in range(900)],
        [float(rng.randrange(5)) for _ in range(900)],
        [0.0] * 450 + [float(i) for i in range(450)],
        [rng.choice([-1e300, 1e300, 1e-300, 0.0]) for _ in range(900)],
        [None] * 899 + [7.5],
        [None] * 900,
        [math.exp(rng.gauss(0, 9)) if rng.random() < 0.7 else None for _ in range(900)],
    ]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"c{i} double" for i in range(len(columns))))
    found = q.quantiles(df, [F.col(c) for c in df.columns], SHARES)
    for own, values in zip(found, columns):
        wanted = expected([v for v in values if v is not None])
        assert own is None if wanted is None else own == pytest.approx(wanted, rel=1e-9), (own, wanted)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c double")
    before, q.SMALL, q.DIRECT = (q.SMALL, q.DIRECT), 5, 0
    try:
        assert q.quantiles(df, [F.col("c")], SHARES)[0] == pytest.approx(expected(values), rel=1e-9, abs=1e-9)
    finally:
        q.SMALL, q.DIRECT = before


@pytest.mark.parametrize(("order", "kind"), [("asc", "long"), ("desc", "string"), ("key", "date"), ("key", "string"), ("asc", "double")])
def test_deep_pages(spark, monkeypatch, order, kind):
    """All pages of tables whose pages are found in rounds, with a null key and many rows of one percentage."""
    from siltworks.functions import order as o

    monkeypatch.setattr(o, "TOP_ROWS", 60)
    monkeypatch.setattr(o, "STRETCHES", 9)
    rng = random.Random(8)
    made = {"long": "id", "string": "lpad(id, 5, 'k')", "date": "date_add(date'2000-01-01', int(id))", "double": "double(id) / 7"}[kind]
    cells = [(i, 1 if rng.random() < 0.9 else None, 2 if rng.random() < 0.5 else None) for i in range(700)]
    df = spark.createDataFrame(cells, "id long, a int, b int").selectExpr(f"if(id = 3, null, {made}) as k", "a", "b").repartition(6)
    whole = [tuple(r) for r in profile.completeness_by_row(df, "k", order, page_size=700).collect()]
    assert len(whole) == 700
    for page in (1, 7, 99):
        at = min(page, 13) * 50
        assert [tuple(r) for r in profile.completeness_by_row(df, "k", order, page, 50).collect()] == whole[at : at + 50]
    assert profile.completeness_by_row(df.limit(0), "k", order, 3).collect() == []


def test_ranks_among_equal_values(spark, monkeypatch):
    from siltworks.functions import order as o

    monkeypatch.setattr(o, "TOP_ROWS", 20)
    df = spark.range(500).selectExpr("5 as k", "id")
    assert o.rows_by_rank(df, "k", 500, 200, 240).count() == 40
    mixed = spark.range(500).selectExpr("if(id < 300, 5, id) as k", "id")
    assert [r.k for r in o.rows_by_rank(mixed, "k", 500, 290, 310).collect()] == [5] * 10 + list(range(300, 310))


def test_several_distributions_are_those_of_each_column(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet").selectExpr("*", "null as nothing", "double('nan') as nan", "7 as seven", "if(o_orderkey % 3 = 0, null, o_totalprice) as gaps", "if(o_orderkey % 3 = 0, null, o_orderstatus) as holes", "string(o_custkey) as many")
    names = ["o_totalprice", "o_orderstatus", "o_orderdate", "nan", "seven", "gaps", "holes", "many"]
    together = {}
    for r in profile.distributions(df, names, max_bars=100).collect():
        together.setdefault(r.column_name, set()).add((r.label, r.n))
    for c in names:
        alone = profile.histogram(df, c).selectExpr("string(x) as label", "n") if c in ("o_totalprice", "nan", "seven", "gaps") else profile.distribution(df, c, max_bars=100).selectExpr("value as label", "n")
        assert together[c] == {tuple(r) for r in alone.collect()}, c


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation") + df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_rules_add_a_constant_to_the_plan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    df, seen = events, []
    start = time.time()
    for i in range(10):
        rule = {"column": "value", "method": "mad", "action": ("cap", "median", "mean")[i % 3]}
        df = outliers.apply_outliers(df, [rule])
        df = missing.apply_missing(df, [{"column": "value", "action": ("median", "mean")[i % 2]}])
        seen.append(scans(df))
    planning = time.time()
    df.explain("formatted")
    assert set(seen) == {1} and time.time() - planning < 5 and time.time() - start < 120
    assert scans(prepare.scale_robust(df, ["value"])) == 1


def test_names_of_operators_are_free(spark):
    names = ["_stat", "_bounds", "_center", "_c0", "_s0", "_key0", "_position", "_stretch", "_fill", "stretch", "end", "fill", "carry", "key0", "turn", "n_rows", "STRETCH_"]
    rows = [(i, float(i) if i % 3 else None, "a" if i % 2 else "b", *([f"x{i}"] * len(names))) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "v", "k", *names])
    assert free_names(df, "stretch", "STRETCH") == ["stretch__", "STRETCH___"]
    out = df
    for action in ("mean", "median", "mode", "ffill", "bfill"):
        out = missing.apply_missing(df, [{"column": "v", "action": action}], order_by="id", partition_by=["k"] if action == "bfill" else None)
        assert out.columns == df.columns and out.filter("_stat <> concat('x', id)").count() == 0
    for action in ("cap", "median", "flag", "drop"):
        assert outliers.apply_outliers(df, [{"column": "v", "method": "z", "action": action}]).columns[: len(df.columns)] == df.columns
    assert prepare.scale_standard(df, ["v"]).columns == df.columns
    assert profile.duplicate_rows(df, ["k"], limit=None).count() == 40 and profile.duplicate_rows(df, ["k"]).columns == df.columns


@pytest.mark.parametrize(("order", "forward"), [("number", True), ("text", False), ("flag", True), ("number", False)])
def test_fill_with_a_hot_partition(spark, order, forward):
    """A key with most rows, a null key, equal order values in one stretch, orders of every kind of type."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        key = rng.choice(["hot"] * 8 + [None, "b"])
        rows.append((key, i, f"t{i:05d}", i >= 700, rng.random() if rng.random() < 0.05 else None))
    df = spark.createDataFrame(rows, "k string, number long, text string, flag boolean, v double").repartition(5)
    by = [order, "number"] if order == "flag" else [order]
    action = "ffill" if forward else "bfill"
    for keys in ([], ["k"]):
        out = {r.number: r.v for r in missing.apply_missing(df, [{"column": "v", "action": action}], order_by=by, partition_by=keys).collect()}
        last = {}
        for k, n, _, _, v in rows if forward else rows[::-1]:
            place = k if keys else 0
            last[place] = v if v is not None else last.get(place)
            assert out[n] == last[place]
    assert missing.apply_missing(df.limit(0), [{"column": "v", "action": action}], order_by=by, partition_by=["k"]).collect() == []
