"""Readers and writers: CSV, JSON in five layouts, Parquet, and the dataset's card."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.columns import col
from siltworks.operators.normalise import flatten, marker_counts, normalize_markers

#: Separators that are looked for on a CSV's first line, in order of preference.
SEPARATORS = (",", ";", "\t")
#: Bytes of a file's head: its first line gives the separator, its marks and zeros the kind of UTF-16.
HEAD = 1 << 16
FORMATS = ("csv", "json", "parquet")
JSON_LAYOUTS = ("records", "split", "index", "columns", "values")
CORRUPT = "_corrupt_record"
ROW_NUMBER = "_index"
#: The name that Windows-1252 goes by; Spark reads it as ISO-8859-1, from which it differs in these bytes.
WINDOWS = "WINDOWS-1252"
_WINDOWS_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]


def _stored_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of a file, or of a folder's files, that are not empty; only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").filter("length > 0")


def head_bytes(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """The first bytes of a file, or of the first non-empty file of a folder, in any store that Spark reads; unpacked ones of a packed file."""
    first = _stored_files(spark, path).orderBy("path").limit(1).first()
    if first is None:
        return b""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(first["path"])
    stream = where.getFileSystem(conf).open(where)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


@dataclass(frozen=True)
class Evidence:
    """What all bytes of a file tell, line by line: no character of UTF-8 holds the byte that ends lines.

    ``odd_quotes`` counts lines with an odd number of quotes. A quoted value that holds a line break begins on such a
    line, as the quotes up to it are even; so without any no value does.
    """

    lines: int = 0
    odd_quotes: int = 0
    not_utf8: int = 0
    controls: int = 0
    undefined: int = 0
    zeros: int = 0
    not_objects: int = 0

    def encoding(self, head: bytes) -> str:
        """UTF-8 if all lines can be, else Windows-1252 where only that gives the bytes characters, else ISO-8859-1, which any bytes can be.

        UTF-16 by its mark, or by zero bytes, which no text of the others holds; the head's zeros tell its order.
        """
        if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return "UTF-16"
        if self.zeros and head:
            return "UTF-16LE" if head[1::2].count(0) > head[::2].count(0) else "UTF-16BE"
        if not self.not_utf8:
            return "UTF-8"
        return WINDOWS if self.controls and not self.undefined else "ISO-8859-1"


def evidence(spark: SparkSession, path: str, objects: bool = False) -> Evidence:
    """One parallel pass over all bytes of a file or folder; ``objects`` counts the lines that are no JSON objects, too."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("bytes"))
    quotes = F.length("bytes") - F.length(F.replace("bytes", F.lit('"'), F.lit("")))
    of = {
        "lines": F.count_if(F.trim("bytes") != ""),
        "odd_quotes": F.count_if(quotes % 2 == 1),
        "not_utf8": F.count_if(~F.is_valid_utf8("value")),
        "controls": F.count_if(F.col("bytes").rlike(r"[\x80-\x9F]")),
        "undefined": F.count_if(F.col("bytes").rlike("[" + "".join(f"\\x{b:02X}" for b in range(0x80, 0xA0) if b not in _WINDOWS_BYTES) + "]")),
        "zeros": F.count_if(F.col("bytes").contains("\x00")),
    }
    if objects:
        bare = F.regexp_replace("value", "^\ufeff", "")
        of["not_objects"] = F.count_if((F.trim("bytes") != "") & ~F.coalesce(F.schema_of_variant(F.try_parse_json(bare)).startswith("OBJECT"), F.lit(False)))
    return Evidence(**lines.agg(*[c.alias(n) for n, c in of.items()]).first().asDict())


def sniff_separator(line: str) -> str:
    """The separator that is most frequent on the line; ties and none go to the first."""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def format_of(path: str, fmt: str | None = None) -> str:
    kind = (fmt or path.rstrip("/").rpartition(".")[2]).lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; known: {', '.join(FORMATS)}")
    return kind


def _is_windows(encoding: str) -> bool:
    return encoding.upper() in (WINDOWS, "CP1252", "CP-1252")


def _from_windows(df: DataFrame) -> DataFrame:
    """Texts and names that were read as ISO-8859-1 as what their bytes are in Windows-1252."""
    as_read, meant = "".join(map(chr, _WINDOWS_BYTES)), bytes(_WINDOWS_BYTES).decode("cp1252")
    name = lambda c: c.translate(str.maketrans(as_read, meant))
    right = lambda f: F.translate(col(f.name), as_read, meant) if isinstance(f.dataType, T.StringType) else col(f.name)
    return df.select(*[right(f).alias(name(f.name)) for f in df.schema])


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, schema: T.StructType | None = None, on_corrupt: str = "raise", multi_line: bool | None = None) -> DataFrame:
    """A CSV with header, quoted by ``"`` (doubled inside).

    All bytes decide, in one pass, what is not given: the encoding (UTF-8, UTF-16 with mark or without, ISO-8859-1,
    Windows-1252) and whether values hold line breaks (``multi_line``), which makes a file one task. The separator is
    that of the first line. Rows with too few or too many values are counted and raise (``on_corrupt`` raise), or are left out
    (drop), whatever columns are used of the result.
    """
    if on_corrupt not in ("raise", "drop"):
        raise ValueError(f"on_corrupt must be raise or drop, not {on_corrupt}")
    head = head_bytes(spark, path) if sep is None or encoding is None else b""
    seen = evidence(spark, path) if encoding is None or multi_line is None else Evidence()
    encoding = encoding or seen.encoding(head)
    sep = sep or sniff_separator(head.decode(encoding, "replace").lstrip("\ufeff").partition("\n")[0])
    if multi_line is None:
        # Lines of UTF-16 can't be cut at bytes.
        multi_line = encoding.upper().startswith("UTF-16") or seen.odd_quotes > 0
    windows = _is_windows(encoding)
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "ISO-8859-1" if windows else encoding}
    if schema is None:
        schema = spark.read.options(**options, inferSchema=True).csv(path).schema
    # Rows are told to fit by all of their values, so none may be left unread.
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    checked = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False).schema(whole).csv(path)
    # Spark refuses a read of the corrupt record alone, so a length that is never negative asks for a value.
    fits = F.col(CORRUPT).isNull() & (F.length(F.concat_ws("", *[col(f.name).cast("string") for f in schema.fields[:1]])) >= 0)
    if on_corrupt == "drop":
        df = checked.filter(fits).drop(CORRUPT)
    else:
        if bad := checked.filter(~fits).count():
            raise ValueError(f"{bad} rows of {path} do not fit the {len(schema)} columns")
        df = spark.read.options(**options, mode="FAILFAST").schema(schema).csv(path)
    return _from_windows(df) if windows else df


_KEYED, _KEYED_TWICE = "map<string,variant>", "map<string,map<string,string>>"


def _document_layout(documents: DataFrame) -> str:
    """The layout of whole documents ``v``: the first that all of them have; split, values, columns, index, else records.

    An object of objects is columns where the keys inside are whole numbers, which are rows then, else rows by their name.
    """
    part = lambda path, kind: F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    inner = F.map_values(part("$", _KEYED))
    keyed = F.forall(inner, lambda x: F.try_variant_get(x, "$", _KEYED).isNotNull()) & (F.size(inner) > 0)
    keys = F.flatten(F.transform(inner, lambda x: F.map_keys(F.try_variant_get(x, "$", _KEYED))))
    rows = part("$", "array<variant>")
    lists = lambda some: F.forall(some, lambda r: F.try_variant_get(r, "$", "array<variant>").isNotNull())
    texts = lambda some: F.forall(some, lambda r: F.schema_of_variant(r) == "STRING")
    found = documents.agg(
        F.bool_and(F.coalesce(texts(part("$.columns", "array<variant>")) & lists(part("$.data", "array<variant>")), F.lit(False))).alias("split"),
        F.bool_and(F.coalesce(lists(rows) & (F.size(rows) > 0), F.lit(False))).alias("values"),
        F.bool_and(F.coalesce(keyed & F.forall(keys, lambda k: k.rlike(r"^-?\d+$")), F.lit(False))).alias("columns"),
        F.bool_and(F.coalesce(keyed, F.lit(False))).alias("index"),
    ).first()
    return next((n for n in ("split", "values", "columns", "index") if found[n]), "records")


def read_json(spark: SparkSession, path: str, layout: str | None = None, encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """JSON records (an array, or one object per line), or documents in the layout split, index, columns or values.

    All lines decide what is not given. Where each is an object, and there are more of them than files, they are records.
    Otherwise each file is one document, and the first layout holds that all documents have. A document has one reader,
    a folder as many as documents; built-in functions parse them and turn them to rows. Of documents only the names of
    their columns reach the driver.
    """
    if layout is not None and layout not in JSON_LAYOUTS:
        raise ValueError(f"unknown layout: {layout}; known: {', '.join(JSON_LAYOUTS)}")
    head = head_bytes(spark, path)
    wide_head = head[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\x00" in head
    object_first = not wide_head and head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{")
    seen = evidence(spark, path, objects=object_first and layout in (None, "records")) if encoding is None or object_first else Evidence()
    encoding = encoding or seen.encoding(head)
    windows = _is_windows(encoding)
    charset = "ISO-8859-1" if windows else encoding
    by_line = seen.lines > 1 and object_first and layout in (None, "records") and not seen.not_objects and seen.lines > _stored_files(spark, path).count()
    documents = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.decode(F.col("value").cast("binary"), charset).alias("value"))
    documents = documents.filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("document"), F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("v"))
    if layout is None:
        layout = "records" if by_line else _document_layout(documents)
    if layout == "records":
        reader = spark.read.options(multiLine=not by_line, encoding=charset, mode="FAILFAST", **({"lineSep": "\n"} if by_line else {}))
        df = (reader.schema(schema) if schema is not None else reader).json(path)
        return _from_windows(df) if windows else df
    if layout == "values":
        rows = documents.select(F.posexplode(F.expr("variant_get(v, '$', 'array<array<string>>')")).alias(ROW_NUMBER, "r"))
        width = rows.agg(F.max(F.size("r"))).first()[0] or 0
        wide = rows.select(*[F.get("r", F.lit(i)).alias(str(i)) for i in range(width)])
    elif layout == "split":
        # Of a column each document has its own place.
        names = documents.select(F.explode(F.expr("variant_get(v, '$.columns', 'array<string>')")).alias("n")).groupBy("n").count().collect()
        names_ = sorted(r.n for r in names)
        if (first := documents.select(F.expr("variant_get(v, '$.columns', 'array<string>')")).first()) is not None:
            names_ = [*first[0], *[n for n in names_ if n not in first[0]]]
        rows = documents.select(F.expr("variant_get(v, '$.columns', 'array<string>')").alias("c"), F.explode(F.expr("variant_get(v, '$.data', 'array<array<string>>')")).alias("r"))
        wide = rows.select(*[F.get("r", F.array_position("c", n).cast("int") - 1).alias(n) for n in names_])
    else:
        cells = documents.select("document", F.explode(F.expr(f"variant_get(v, '$', '{_KEYED_TWICE}')")).alias("outer", "inner")).select("document", "outer", F.explode("inner").alias("inner", "value"))
        row, name = ("inner", "outer") if layout == "columns" else ("outer", "inner")
        names_ = sorted(r[0] for r in cells.select(name).distinct().collect())
        wide = cells.groupBy("document", F.col(row).alias(ROW_NUMBER)).pivot(name, names_).agg(F.first("value")).drop("document", ROW_NUMBER)
    return _typed(_from_windows(wide) if windows else wide, schema)


def _typed(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """Text columns as numbers or booleans where all their values are; or as a given schema says."""
    if schema is not None:
        return df.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    kinds = ("bigint", "double", "boolean")
    seen = df.agg(*[F.count_if(col(c).isNotNull() & col(c).try_cast(k).isNull()).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in kinds]).first()
    chosen = [next((k for k in kinds if not seen[f"{k}{i}"]), "string") for i in range(len(df.columns))]
    return df.select(*[col(c).cast(k).alias(c) for c, k in zip(df.columns, chosen)])


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None, encoding: str | None = None, schema: T.StructType | None = None, flatten_nested: bool = True, markers: bool = False) -> DataFrame:
    """Read by format; nested objects become dotted columns, textual missing markers null if asked for."""
    kind = format_of(path, fmt)
    if kind == "csv":
        df = read_csv(spark, path, sep, encoding, schema)
    elif kind == "json":
        df = read_json(spark, path, None, encoding, schema)
    else:
        df = spark.read.parquet(path)
    df = flatten(df) if flatten_nested else df
    return normalize_markers(df) if markers else df


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write as Parquet, CSV (with header; nested columns as JSON) or JSON lines."""
    kind = format_of(path, fmt)
    if kind == "csv":
        nested = (T.StructType, T.ArrayType, T.MapType)
        df = df.select(*[F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name) for f in df.schema])
        df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
    else:
        getattr(df.write.mode(mode), kind)(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder, in any store that Spark reads; only names and sizes are read."""
    return _stored_files(spark, path).agg(F.sum("length")).first()[0] or 0


def dataset_card(df: DataFrame, name: str, path: str | None = None, markers: bool = False) -> dict:
    """Name, place, rows, columns, bytes (stored ones of ``path``, else the plan's estimate), time.

    ``markers`` adds how many missing markers of each text column loading would null, of ``df`` before that.
    """
    size = stored_bytes(df.sparkSession, path) if path else int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    card = {"name": name, "path": path, "row_count": df.count(), "column_count": len(df.columns), "size_bytes": size, "processed_at": datetime.now(UTC).isoformat(timespec="seconds")}
    if markers:
        card["replaced_markers"] = {r.column_name: r.replaced for r in marker_counts(df).collect()}
    return card
