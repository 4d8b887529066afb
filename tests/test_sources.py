import json

import pytest
from pyspark.sql import functions as F

from siltworks.operators import normalise, prepare
from siltworks.sources import files, session
from siltworks.streaming import clean


def rows(df):
    return [tuple(r) for r in df.collect()]


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


def test_separator_quotes_and_lines(spark, tmp_path):
    path = put(tmp_path, "semi.csv", 'a;b;c\n1;"x ""y"" \nz";2.5\n2;w;3\n')
    assert rows(files.read_dataset(spark, path)) == [(1, 'x "y" \nz', 2.5), (2, "w", 3.0)]


def test_two_lines_are_enough(spark, tmp_path):
    assert rows(files.read_dataset(spark, put(tmp_path, "two.csv", "a,b\n1,x\n"))) == [(1, "x")]


def test_ragged_rows(spark, tmp_path):
    path = put(tmp_path, "ragged.csv", "a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(ValueError, match="2 rows"):
        files.read_dataset(spark, path)
    assert rows(files.read_csv(spark, path, on_corrupt="drop")) == [(1, 2)]


def test_latin1(spark, tmp_path):
    path = put(tmp_path, "latin1.csv", "n,v\né,1\nü,2\n".encode("latin-1"))
    assert [r[0] for r in rows(files.read_dataset(spark, path))] == ["é", "ü"]


def test_separator_ties():
    assert files.sniff_separator("a,b;c") == ","
    assert files.sniff_separator("abc") == ","
    assert files.sniff_separator("a\tb\tc;d") == "\t"


def test_nested_records(spark, tmp_path):
    path = put(tmp_path, "records.json", json.dumps([{"a": {"b": 1, "c": [1, 2]}, "d": "x"}]))
    df = files.read_dataset(spark, path)
    assert df.columns == ["a.b", "a.c", "d"] and rows(df) == [(1, [1, 2], "x")]
    assert files.read_dataset(spark, path, flatten_nested=False).columns == ["a", "d"]


@pytest.mark.parametrize(
    ("layout", "content"),
    [
        ("split", {"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, None]]}),
        ("index", {"0": {"a": 1, "b": "x"}, "1": {"a": 2, "b": None}}),
        ("columns", {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}),
        ("values", [[1, "x"], [2, None]]),
    ],
)
def test_json_layouts(spark, tmp_path, layout, content):
    path = put(tmp_path, f"{layout}.json", json.dumps(content))
    out = sorted(rows(files.read_json(spark, path, layout=layout)))
    assert out == [(1, "x"), (2, None)]
    if layout != "index":  # an object of objects is read as columns unless told
        assert sorted(rows(files.read_json(spark, path))) == out


def test_json_lines(spark, tmp_path):
    path = put(tmp_path, "lines.json", '{"a": 1}\n{"a": 2}\n')
    assert sorted(rows(files.read_dataset(spark, path))) == [(1,), (2,)]


def orders_like(n):
    return "".join(f"{i},name {i}\n" for i in range(n))


def test_a_csv_can_be_counted(spark, tmp_path):
    path = put(tmp_path, "count.csv", "a,b\n1,x\n2,y\n")
    df = files.read_dataset(spark, path)
    assert df.count() == 2 and df.select("a").count() == 2 and files.dataset_card(df, "t", path)["row_count"] == 2
    ragged = files.read_csv(spark, put(tmp_path, "drop.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n"), on_corrupt="drop")
    # Whatever is read of the result, the same rows are left out.
    assert ragged.count() == 2 and rows(ragged.select("a")) == [(1,), (7,)] and rows(ragged.select("b")) == [(2,), (8,)]
    assert files.read_csv(spark, put(tmp_path, "empty.csv", "a,b\n")).count() == 0


def test_a_line_break_at_the_end_of_a_long_file(spark, tmp_path):
    path = put(tmp_path, "late.csv", "a,b\n" + orders_like(6000) + '6001,"first\nsecond, third"')
    df = files.read_dataset(spark, path)
    assert df.count() == 6001 and rows(df.filter("a = 6001")) == [(6001, "first\nsecond, third")]


@pytest.mark.parametrize(("encoding", "text"), [("latin-1", "é"), ("cp1252", "“€”"), ("utf-8", "é“日本"), ("utf-8-sig", "é"), ("utf-16", "é€"), ("utf-16-le", "é€日"), ("utf-16-be", "é€日")])
def test_encodings_told_by_the_last_line(spark, tmp_path, encoding, text):
    path = put(tmp_path, "late.csv", ("a,b\n" + orders_like(6000) + f"6001,{text}\n").encode(encoding))
    df = files.read_dataset(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 6001
    assert rows(df.filter("a = 6001")) == [(6001, text)]


def test_windows_names_and_quotes_in_values(spark, tmp_path):
    df = files.read_csv(spark, put(tmp_path, "w.csv", 'prix €,b\n"a ""b"" …",5" pipe\n'.encode("cp1252")))
    assert df.columns == ["prix €", "b"] and rows(df) == [('a "b" …', '5" pipe')]
    assert rows(files.read_csv(spark, put(tmp_path, "w2.csv", "a,b\n1,€\n".encode("cp1252")), encoding="cp1252")) == [(1, "€")]


def test_a_packed_file(spark, tmp_path):
    import gzip

    path = put(tmp_path, "p.csv.gz", gzip.compress("a;b\n1;é\n".encode("latin-1")))
    assert rows(files.read_csv(spark, path)) == [(1, "é")]


def test_json_lines_that_begin_with_an_object(spark, tmp_path):
    read = lambda text, **more: files.read_dataset(spark, put(tmp_path, "l.json", text), **more)
    assert sorted(rows(read('{"a":{"x":1},"t":5}\n{"a":{"x":2},"t":6}\n'))) == [(1, 5), (2, 6)]
    assert sorted(rows(read('{"a":{"x":1},"b":{"x":2}}\n{"a":{"x":3},"b":{"x":4}}\n'))) == [(1, 2), (3, 4)]
    assert sorted(rows(read('{"data":[1,2],"id":1}\n{"data":[3],"id":2}'))) == [([1, 2], 1), ([3], 2)]
    assert sorted(rows(read('{"columns":["a"],"data":[1,2]}'))) == [(["a"], [1, 2])]
    assert read('{"a":1}\n\n{"a":2}\n').count() == 2
    pretty = json.dumps({"a": {"x": 1}, "t": 5}, indent=1)
    assert rows(read(pretty)) == [(1, 5)]
    long = "".join(json.dumps({"a": {"x": i}, "b": {"x": "é"}}, ensure_ascii=False) + "\n" for i in range(5000))
    assert read(long).count() == 5000


def test_json_rows_by_name(spark, tmp_path):
    read = lambda content: files.read_json(spark, put(tmp_path, "n.json", json.dumps(content)))
    assert rows(read({"r1": {"a": 1}})) == [(1,)]
    assert sorted(rows(read({"r1": {"a": 1, "b": "x"}, "r2": {"a": 2, "b": None}}))) == [(1, "x"), (2, None)]
    assert sorted(rows(read({"a": {"0": 1, "1": 2}}))) == [(1,), (2,)]


def test_json_documents_in_a_folder(spark, tmp_path):
    for layout, content in {"split": {"columns": ["a", "b"], "data": [[1, "x"]]}, "values": [[1, "x"]], "index": {"r": {"a": 1, "b": "x"}}, "columns": {"a": {"0": 1}, "b": {"0": "x"}}}.items():
        (tmp_path / layout).mkdir()
        for i in range(3):
            (tmp_path / layout / f"{i}.json").write_text(json.dumps(content, indent=2))
        assert rows(files.read_json(spark, str(tmp_path / layout))) == [(1, "x")] * 3, layout


def test_json_encodings(spark, tmp_path):
    text = '{"a": "é€"}\n{"a": "x"}\n'
    for encoding in ("utf-8", "utf-8-sig", "cp1252"):
        assert sorted(rows(files.read_json(spark, put(tmp_path, f"{encoding}.json", text.encode(encoding))))) == [("x",), ("é€",)], encoding
    for encoding in ("utf-16", "latin-1"):
        path = put(tmp_path, f"{encoding}.json", '[{"a": "é"}, {"a": "x"}]'.encode(encoding))
        assert sorted(rows(files.read_json(spark, path))) == [("x",), ("é",)], encoding


def test_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        files.read_dataset(spark, "table.xlsx")
    df = spark.createDataFrame([(1, [1, 2])], "a int, l array<int>")
    files.write_dataset(df, str(tmp_path / "out"), "csv")
    assert rows(files.read_dataset(spark, str(tmp_path / "out"), "csv")) == [(1, "[1,2]")]
    card = files.dataset_card(df, "t")
    assert (card["row_count"], card["column_count"]) == (1, 2)


def test_markers_on_reading(spark, tmp_path):
    path = put(tmp_path, "m.csv", "a,b\nN/A,1\nx,2\n")
    assert rows(files.read_dataset(spark, path, markers=True)) == [(None, 1), ("x", 2)]


def test_preview(spark):
    df = spark.createDataFrame([("x" * 101, (1,)), (None, None)], "s string, t struct<a:int>")
    assert rows(normalise.preview(df)) == [("x" * 100 + "…", '{"a":1}'), (None, None)]
    assert len(normalise.adaptive_preview(df)) == 2
    assert len(normalise.adaptive_preview(df, json_bytes=150)) == 1
    assert normalise.adaptive_preview(df, json_bytes=10) is None
    assert normalise.marker_counts(spark.range(1)).count() == 0


def test_encodings(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert rows(prepare.one_hot(df, "k")) == [(0, 1), (1, 0), (0, 0)]
    assert rows(prepare.ordinal(df, "k")) == [(1,), (0,), (None,)]
    with pytest.raises(ValueError):
        prepare.categories(spark.range(5).select(F.col("id").cast("string").alias("k")), "k", limit=4)


def test_scalings(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 1.0), (None, 1.0)], "a double, b double")
    assert rows(prepare.scale_minmax(df, ["a", "b"])) == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert rows(prepare.scale_standard(df, ["a"]))[0][0] == -1.0
    assert rows(prepare.scale_robust(df, ["a"]))[1][0] == 1.0
    assert rows(prepare.normalize_l2(spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "a double, b double"), ["a", "b"])) == [(0.6, 0.8), (0.0, 0.0)]


def test_pca_keeps_the_variance(spark):
    df = spark.range(50).selectExpr("id", "cast(id as double) as a", "2.0D * id + (id % 3) as b", "cast(id % 2 as double) as c")
    out = prepare.pca(df, ["a", "b", "c"], 3)
    var = lambda d, names: sum(d.agg(*[F.var_pop(n) for n in names]).first())
    assert out.columns == ["id", "pc1", "pc2", "pc3"]
    assert var(out, ["pc1", "pc2", "pc3"]) == pytest.approx(var(df, ["a", "b", "c"]))
    with pytest.raises(ValueError):
        prepare.pca(df, ["a"], 2)


def test_stream(spark, tmp_path):
    source = spark.createDataFrame([(1, " NA ", 500.0), (2, "x", None)], "i int, s string, v double")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    cleaned = clean.clean_stream(stream, missing=[{"column": "s", "action": "constant", "value": "?"}], bounds={"v": (0, 9)})
    clean.write_stream(cleaned, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")))) == [(1, "?", 9.0), (2, "x", None)]
    with pytest.raises(ValueError):
        clean.clean_stream(stream, missing=[{"column": "v", "action": "mean"}])


def test_stream_windows(spark, tmp_path):
    source = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id) as t, if(id = 0, null, id) as v from range(5)")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = clean.completeness_stream(stream, "t", ["v"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.n_v for r in spark.table("windows").collect()) == 4 and spark.table("windows").count() == 5


def test_session_is_reused(spark):
    assert session.is_active() and session.session() is not None
