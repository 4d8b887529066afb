from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltworks.llm import mixing


def fill(sizes, weights, total, epochs):
    """Clamp and reshare until no source is above its cap."""
    target, left, open_ = {}, total, set(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight >= epochs * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / weight for s in open_}
        for s in over:
            target[s] = epochs * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(df, rows):
    size, by_source = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.source] += r.size
        by_source[r.source].append(r)
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = fill(size, weights, 1.5 * sum(size.values()), 2)
    for s, own in by_source.items():
        assert all(r.source_size == size[s] and r.target == pytest.approx(target[s]) for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own) / 2 + 1
        assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in own)
        whole = int(target[s] / size[s]) if size[s] else 0
        assert all(r.copies in (whole, whole + 1) for r in own)


@pytest.mark.parametrize("stretch", [4096, 3])
def test_documents(documents, monkeypatch, stretch):
    monkeypatch.setattr(mixing, "STRETCH", stretch)
    take = lambda: sorted(mixing.mix_sources(documents).join(documents.select("doc_id", "source", "text"), "doc_id").collect(), key=lambda r: r.doc_id)
    rows = take()
    check(documents, rows)
    assert all(r.size == len(r.text.encode().split()) for r in rows)
    assert rows == take()
    other = mixing.mix_sources(documents, seed=1).collect()
    assert {r.doc_id: r.copies for r in other} != {r.doc_id: r.copies for r in rows}


def test_hot_source_and_null_source(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 else None if i % 2 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").collect())


def test_odd_rows(odd, nothing):
    out = mixing.mix_sources(odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 6))
    assert mixing.mix_sources(nothing).collect() == []
    kept = mixing.mix_sources(odd, keep_text=True)
    assert kept.count() == odd.count() and "extra" in kept.columns and dict(kept.dtypes)["size"] == "bigint"


def test_rows_that_share_an_id_or_have_none(spark):
    """Each row keeps its own text, size and source; names of other columns do not matter."""
    rows = [(1, "a b c", "x"), (1, "d", "y"), (None, "e f", "y"), (None, "g h i j", "x"), (2, None, None), (2, "k", "x"), (1, "a b c", "x")]
    names = ["_id", "_row", "_all", "turn", "stretch", "start", "place", "a.b"]
    df = spark.createDataFrame([(*r, *([f"n{k}"] * len(names))) for k, r in enumerate(rows)], ["doc_id", "text", "source", *names])
    out = mixing.mix_sources(df, keep_text=True)
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken", "copies"]
    found = {r._id: r for r in out.collect()}
    assert len(found) == len(rows) and sorted(found) == [f"n{k}" for k in range(len(rows))]
    for k, (doc_id, text, source) in enumerate(rows):
        r = found[f"n{k}"]
        assert (r.doc_id, r.text, r.source, r.size, r.source_size) == (doc_id, text, source, len((text or "").split()), {"x": 11, "y": 3, None: 0}[source])
    check(df, list(found.values()))


def test_documents_match_sql(spark, small):
    from siltworks.llm.queries import queries
    from tests.oracle import duck, same_rows

    same_rows(queries()["op2_source_mix"](spark, small), duck(small), mixing.ORACLE_SQL)


def test_all_empty(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix_sources(df).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_water_level(spark):
    df = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    out = {r.source: r.target for r in mixing.water_fill(df, 600.0, 2.0).collect()}
    assert out == pytest.approx(fill({"a": 10, "b": 100, "c": 1000}, {"a": 5, "b": 2, "c": 1}, 600, 2))
    assert {r.source: r.target for r in mixing.water_fill(df, 1e9, 2.0).collect()} == {"a": 20.0, "b": 200.0, "c": 2000.0}
    assert mixing.water_fill(df.filter(F.lit(False)), 0.0, 2.0).collect() == []
