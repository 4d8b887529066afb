"""Fit and transform apart, sparse vectors, wide components, sketches that merge, cell changes, as-of joins, streams."""

import bisect
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions import order
from siltworks.operators import asof, changes, fitted, prepare, sketches
from siltworks.operators.profile import top_values
from siltworks.streaming import clean, duplicates


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust"])
def test_scales_of_other_rows(spark, kind):
    df = spark.range(100).select("id", (F.col("id") * 1.5).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("b"), F.lit(3.0).alias("c"))
    model = fitted.fit(df, kind, ["a", "b", "c"])
    again = fitted.Fitted.from_json(model.to_json())
    assert again == model
    operator = {"standard": prepare.scale_standard, "minmax": prepare.scale_minmax, "robust": prepare.scale_robust}[kind]
    assert rows(again.transform(df)) == rows(operator(df, ["a", "b", "c"]))
    # Of other rows the scale is still that of the fit.
    part = df.filter("id > 90")
    assert rows(again.transform(part)) == [r for r in rows(operator(df, ["a", "b", "c"])) if r[0] > 90]
    assert again.transform(df.limit(0)).columns == df.columns


def test_values_that_fitting_did_not_see(spark):
    seen = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    new = spark.createDataFrame([("b",), ("z",), (None,), ("a",)], "k string").coalesce(1)
    model = lambda kind, unseen: fitted.Fitted.from_json(fitted.fit(seen, kind, "k", unseen).to_json())
    assert [tuple(r) for r in model("onehot", "ignore").transform(new).collect()] == [(0, 1), (0, 0), (0, 0), (1, 0)]
    other = model("onehot", "other").transform(new)
    assert other.columns == ["k_a", "k_b", "k_other"] and [tuple(r) for r in other.collect()] == [(0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 0, 0)]
    assert [r.k for r in model("ordinal", "ignore").transform(new).collect()] == [1, None, None, 0]
    assert [r.k for r in model("ordinal", "other").transform(new).collect()] == [1, 2, None, 0]
    for kind in ("onehot", "ordinal"):
        with pytest.raises(ValueError, match="1 values of k"):
            model(kind, "raise").transform(new)
        assert model(kind, "raise").transform(seen).count() == 3
    for bad in (lambda: fitted.fit(seen, "words", "k"), lambda: fitted.fit(seen, "onehot", ["k", "k"]), lambda: fitted.Fitted("onehot", ("k",), (), "what")):
        with pytest.raises(ValueError):
            bad()


def test_sparse_vectors(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), F.col("id") % 1700)).alias("k.x"), F.lit(1).alias("place")).repartition(7)
    places = fitted.dictionary(df, "k.x")
    values = sorted({f"v{i % 1700}" for i in range(3000) if i % 10})
    assert [tuple(r) for r in places.orderBy("place").collect()] == list(zip(values, range(len(values))))
    out = fitted.sparse_one_hot(df, "k.x", places)
    assert out.columns == ["id", "place", "k.x"]
    for r in out.collect():
        v = r["k.x"]
        want = [bisect.bisect_left(values, f"v{r.id % 1700}")] if r.id % 10 else []
        assert (v.size, v.indices.tolist(), v.values.tolist()) == (len(values), want, [1.0] * len(want))
    unseen = fitted.sparse_one_hot(spark.createDataFrame([("nope",)], "k string"), "k", places).first().k
    assert (unseen.size, unseen.numNonzeros()) == (len(values), 0)


def test_components_of_hundreds_of_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 300)) * 5 + rng.normal(size=(400, 300))
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(base)], "id int, x array<double>").repartition(4)
    df = df.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    started = time.time()
    out = prepare.pca(df, names, 3)
    assert time.time() - started < 60 and out.columns == ["id", "pc1", "pc2", "pc3"]
    found = np.array([r[1:] for r in sorted(out.collect())])
    centred = base - base.mean(axis=0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    want = centred @ v[:3].T
    assert np.allclose(np.abs(found), np.abs(want), atol=1e-6)
    narrow = prepare.pca(df, names[:5], 5)
    assert np.allclose(np.cov(np.array([r[-5:] for r in narrow.collect()]).T, bias=True), np.diag(np.linalg.eigvalsh(np.cov(base[:, :5].T, bias=True))[::-1]), atol=1e-8)


def test_sketches_of_parts_unite(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 3).alias("day"), "id", (F.xxhash64("id") % 1000 / 3.0).alias("v"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 9)).alias("t"), F.lit(None).cast("double").alias("gone"))
    path = str(tmp_path / "sketches")
    sketches.sketch_columns(df.filter("day < 2"), by=["day"]).write.parquet(path)
    first = {r.column_name: r for r in sketches.unite_profiles(spark.read.parquet(path)).collect()}
    assert first["id"].n_rows == 20_000
    # The third day alone is read for its sketches.
    sketches.sketch_columns(df.filter("day = 2"), by=["day"]).write.mode("append").parquet(path)
    united = {r.column_name: r for r in sketches.unite_profiles(spark.read.parquet(path)).collect()}
    assert (united["id"].n_rows, united["t"].n_present, united["t"].n_distinct, united["id"].low, united["id"].high) == (30_000, 24_000, 9, 0.0, 29_999.0)
    assert abs(united["id"].n_distinct - 30_000) < 0.024 * 30_000 and abs(united["v"].n_distinct - 1999) < 0.024 * 1999
    assert all(abs(q / 30_000 - s) < 0.0025 for q, s in zip(united["id"].quantiles, (0.25, 0.5, 0.75)))
    assert (united["gone"].n_present, united["gone"].n_distinct, united["gone"].quantiles, united["t"].quantiles) == (0, 0, None, None)
    assert sketches.unite_profiles(sketches.sketch_columns(df.limit(0), ["v"], ["day"])).count() == 0


def test_heavy_hitters(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 7).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id")).alias("v"))
    plan = sketches.heavy_hitters(df, "v", 8, tracked=100)
    assert rows(plan) == rows(top_values(df, "v", 8))
    even = spark.range(5000).select((F.col("id") % 2500).alias("v"))
    assert rows(sketches.heavy_hitters(even, "v", 20, tracked=100)) == rows(top_values(even, "v", 20))
    text = spark.createDataFrame([("",), (None,), ("a",), ("a",), ("=",)], "v string")
    assert rows(sketches.heavy_hitters(text, "v")) == rows(top_values(text, "v"))
    assert sketches.heavy_hitters(text.limit(0), "v").count() == 0


def test_cell_changes(spark):
    schema = "k string, a int, b string, c double, old int"
    before = spark.createDataFrame([("x", 1, "p", 1.0, 0), ("y", 2, None, float("nan"), 0), (None, 3, "q", None, 0), ("gone", 4, "r", 4.0, 0), ("two", 1, "a", 1.0, 0), ("two", 2, "b", 1.0, 0)], schema)
    after = spark.createDataFrame([("x", 1.0, "p", None, "z"), ("y", 2.5, "s", None, "z"), (None, 3.0, "q", 7.0, "z"), ("new", 5.0, "t", 5.0, "z"), ("two", 1.0, "a", 1.0, "z")], "k string, a double, b string, c double, new string")
    assert rows(changes.cell_changes(before, after, ["k"])) == sorted(
        [("a", "changed", 1), ("b", "filled", 1), ("c", "nulled", 1), ("c", "filled", 1), (None, "row gone", 1), (None, "row new", 1), (None, "repeated key", 1)], key=str
    )
    shown = {(r.column_name, r.kind): (r.k, r.old, r.new) for r in changes.change_examples(before, after, ["k"]).collect()}
    assert shown["a", "changed"] == ("y", "2.0", "2.5") and shown["c", "filled"] == (None, None, "7.0") and shown[None, "row new"][0] == "new"
    assert {r.k for r in changes.changed_rows(before, after, ["k"]).collect()} == {"x", "y", None, "new"}
    assert changes.cell_changes(before.limit(0), after.limit(0), ["k"]).count() == 0
    wide = spark.range(1000).selectExpr("id", "id as v")
    some = changes.change_examples(wide, wide.selectExpr("id", "v + 1 as v"), ["id"], 3)
    assert [r.id for r in some.orderBy("id").collect()] == [0, 1, 2]


@pytest.mark.parametrize("key_rows", [10**6, 50])
def test_asof_join(spark, monkeypatch, key_rows):
    """A key with two thirds of the rows, null keys and places, ties, by plain windows and by stretches."""
    monkeypatch.setattr(order, "KEY_ROWS", key_rows)
    rng = random.Random(key_rows)
    some = lambda n: [(i, rng.choice(["hot", "hot", "b", None, "c"]), None if rng.random() < 0.03 else rng.randrange(300)) for i in range(n)]
    left, right = some(800), some(500)
    l = spark.createDataFrame(left, "id int, k string, t int").repartition(4)  # noqa: E741
    r = spark.createDataFrame(right, "id long, key string, at long").repartition(4)
    out = asof.asof_join(l, r, "t", "at", [("k", "key")], ["id"])
    assert out.columns == ["id", "k", "t", "right_id", "right_key", "right_at"] and out.count() == 800

    def last(k, t, reach=10**9):
        found = [(at, i) for i, key, at in right if key == k and k is not None and at is not None and t is not None and t - reach <= at <= t]
        return max(found)[1] if found else None

    assert {x.id: x.right_id for x in out.collect()} == {i: last(k, t) for i, k, t in left}
    near = asof.asof_join(l, r, "t", "at", [("k", "key")], ["id"], tolerance=2)
    assert {x.id: x.right_id for x in near.collect()} == {i: last(k, t, 2) for i, k, t in left}
    alone = asof.asof_join(l, r, "t", "at", [], ["id"])
    best = lambda t: max(((at, i) for i, _, at in right if at is not None and t is not None and at <= t), default=(0, None))[1]
    assert {x.id: x.right_id for x in alone.collect()} == {i: best(t) for i, _, t in left}
    assert asof.asof_join(l, r.limit(0), "t", "at", [("k", "key")]).filter("right_id is not null").count() == 0
    assert asof.asof_join(l.limit(0), r, "t", "at").count() == 0


def test_first_rows_of_a_stream(spark, tmp_path):
    """Repetitions within a batch, in a later batch and after a restart go; a row later than the watermark goes, too."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "t timestamp, k string, i int"

    def arrive(number, values):
        spark.createDataFrame([(f"2024-01-01 {t}", k, i) for t, k, i in values], "t string, k string, i int").select(F.col("t").cast("timestamp").alias("t"), "k", "i").coalesce(1).write.parquet(str(source / str(number)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        clean.write_stream(duplicates.first_rows_stream(stream, ["k"], "t", "1 hour"), out, str(tmp_path / "state")).awaitTermination()
        return sorted((r.k or "", r.i) for r in spark.read.parquet(out).collect())

    assert [k for k, _ in arrive(0, [("10:00:00", "a", 1), ("10:01:00", "a", 1), ("10:02:00", None, 3), ("10:03:00", None, 3)])] == ["", "a"]
    assert arrive(1, [("10:30:00", "a", 4), ("12:30:00", "b", 5)]) == [("", 3), ("a", 1), ("b", 5)]
    # Beyond the watermark of 11:30 the state of a is gone: a new one counts, a late row does not.
    assert arrive(2, [("11:00:00", "late", 6), ("12:40:00", "a", 7)]) == [("", 3), ("a", 1), ("a", 7), ("b", 5)]
